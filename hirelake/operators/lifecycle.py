"""Status and liveness of postings: transitions, staleness, retention, queues, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hirelake.functions.vocab import PIPELINE_STATUSES, STICKY_STATUSES
from hirelake.plans.views import days_between


def computed_status(status: Column, expiry: Column, stale: Column) -> Column:
    """What a posting shows as: its own status if that one sticks, else expired, stale, or its status."""
    return (
        F.when(status.isin(*STICKY_STATUSES), status).when(F.coalesce(expiry == "expired", F.lit(False)), "expired")
        .when(F.coalesce(stale, F.lit(False)), "stale").otherwise(F.coalesce(status, F.lit("active")))
    )


def transitions(events: DataFrame) -> DataFrame:
    """Events that change a job's status: known status, different from the one before."""
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    known = events.where(F.col("to_status").isin(*PIPELINE_STATUSES))
    moved = known.withColumn("from_status", F.lag("to_status").over(order))
    return moved.where(~F.col("from_status").eqNullSafe(F.col("to_status")))


def staleness(jobs: DataFrame, as_of: Column, stale_days: int = 14, archive_days: int = 30) -> DataFrame:
    """action of each job that isn't pursued: archive, mark or keep."""
    age = days_between(as_of, F.col("first_seen"))
    passive = F.col("status").isin("discovered", "reviewing")
    action = F.when(passive & (age > archive_days), "archive").when(passive & (age > stale_days), "mark").otherwise("keep")
    return jobs.withColumn("action", action)


def newest_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= n)


def retained(events: DataFrame, as_of: Column, ttl: dict[str, int], default: int) -> DataFrame:
    """Events younger than the days their type is kept."""
    days = F.lit(default)
    for kind, n in ttl.items():
        days = F.when(F.col("event_type") == kind, n).otherwise(days)
    return events.where(days_between(as_of, F.col("ts")) <= days)


def streaks(rows: DataFrame, group: str, order: list[str], broken: Column, reset: Column) -> DataFrame:
    """rows with streak: broken rows since the last reset; rows that are neither change nothing."""
    w = Window.partitionBy(group).orderBy(*order)
    island = rows.withColumn("_reset", F.sum(reset.cast("int")).over(w))
    run = Window.partitionBy(group, "_reset").orderBy(*order)
    return island.withColumn("streak", F.sum(broken.cast("int")).over(run)).drop("_reset")


def sessions(rows: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """key, start, end and n of runs of rows no more than so many minutes apart."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    numbered = rows.withColumn("_new", (gap.isNull() | (gap > minutes * 60_000_000)).cast("int")).withColumn("_s", F.sum("_new").over(w))
    return numbered.groupBy(key, "_s").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n")).drop("_s")


def as_of_join(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """left with the value of right's latest row of the key that isn't later, by one sorted pass over both."""
    cols = left.columns
    a = left.select(*cols, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    b = right.select(*[F.col(c) if c in (key, ts) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.lit(0).alias("_side"), F.col(value).alias("_value"))
    w = Window.partitionBy(key).orderBy(ts, "_side", F.col("_value")).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("found", F.last("_value", ignorenulls=True).over(w)).where(F.col("_side") == 1).drop("_side", "_value")


def slot_gaps(slots: DataFrame, key: str, slot: str, cycle: int) -> DataFrame:
    """The distinct slots of each key with gap, the way to the next one; the last wraps round the cycle, and a single slot's gap is the whole cycle."""
    w = Window.partitionBy(key).orderBy(slot)
    first = F.min(slot).over(Window.partitionBy(key))
    return slots.select(key, slot).where(F.col(slot).isNotNull()).distinct().withColumn("gap", F.coalesce(F.lead(slot).over(w), first + cycle) - F.col(slot))


def confirming_events(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """dedup_key, status, event_id and ts of each job whose latest event names its present status; of equal times the greater event_id."""
    last = events.where(F.col("to_status").isNotNull()).groupBy("job_id").agg(F.max_by(F.struct("to_status", "event_id", "ts"), F.struct("ts", "event_id")).alias("x"))
    met = jobs.select("dedup_key", "status").join(last.select(F.col("job_id").alias("dedup_key"), "x.*"), "dedup_key")
    return met.where(F.col("status") == F.col("to_status")).drop("to_status")
