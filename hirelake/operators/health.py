"""Health checks: each is one row (signal, value, threshold, fired), so they can be united. Nulls never fire."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.content import error_kind
from hirelake.plans.views import days_between


def signal(name: str, df: DataFrame, value: Column, threshold: float, fired: Column | None = None) -> DataFrame:
    one = df.agg(value.cast("double").alias("value"))
    hit = F.col("value") > threshold if fired is None else fired
    return one.select(F.lit(name).alias("signal"), F.round("value", 6).alias("value"), F.lit(float(threshold)).alias("threshold"), F.coalesce(hit, F.lit(False)).alias("fired"))


def idle(events: DataFrame, as_of: Column, human: Column, days: float = 14) -> DataFrame:
    """Days since the last human event."""
    return signal("owner_idle", events.where(human), days_between(as_of, F.max("ts")), days)


def deadman(events: DataFrame, as_of: Column, source: str, window_days: float, factor: float = 2.0) -> DataFrame:
    """The longest silence of any source."""
    last = events.groupBy(source).agg(F.max("ts").alias("last"))
    return signal("source_deadman", last, F.max(days_between(as_of, F.col("last"))), window_days * factor)


def score_rot(rows: DataFrame, stored: str, derived: str, least: float = 0.01) -> DataFrame:
    """The part of classes that the rule would set otherwise; low signal doesn't count."""
    counted = rows.where(~F.col(stored).isin("low_signal") & F.col(derived).isNotNull())
    return signal("score_rot", counted, F.try_divide(F.count_if(F.col(stored) != F.col(derived)), F.count("*")), least)


def paid_leak(ledger: DataFrame, as_of: Column, free: tuple[str, ...], days: int = 7) -> DataFrame:
    """Spend with paid providers in the last days."""
    recent = ledger.where((days_between(as_of, F.col("ts")) < days) & ~F.col("provider").isin(*free))
    return signal("paid_leak", recent, F.coalesce(F.sum("cost"), F.lit(0)), 0)


def failure_burst(events: DataFrame, as_of: Column, failed: Column, least: int = 5) -> DataFrame:
    """Failures of the last day."""
    return signal("failure_burst", events.where(failed & (days_between(as_of, F.col("ts")) < 1)), F.count("*"), least - 1)


def heartbeat(*signals: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), signals)


def degraded(sources: DataFrame) -> DataFrame:
    """Sources that are degraded, the newest break first."""
    return sources.where("status = 'degraded'").orderBy(F.col("last_break").desc_nulls_last(), "source")


def needing_attention(sources: DataFrame) -> DataFrame:
    """Sources that are degraded or hold an error, with kind, by the newest of error, break and update."""
    kind = F.coalesce(error_kind(F.col("last_error")), F.lit("degraded"))
    own = sources.where((F.col("status") == "degraded") | F.col("last_error").isNotNull()).withColumn("kind", kind)
    return own.withColumn("at", F.coalesce("error_at", "last_break", "updated")).orderBy(F.col("at").desc_nulls_last(), "source")


def verdict(alive: Column, beat: Column, beat_status: Column, stale: Column, degraded_names: Column) -> Column:
    """struct(status, exit_code, reasons): down without a process or a heartbeat that can be read, else degraded for each cause, else ok."""
    down = F.when(~F.coalesce(alive, F.lit(False)), "no live process").when(F.coalesce(beat_status, F.lit("missing")) == "missing", "no heartbeat").when(beat_status == "unreadable", "heartbeat unreadable")
    causes = F.array_compact(F.array(
        F.when(stale, F.concat(F.lit("heartbeat stale: "), F.coalesce(beat, F.lit("")))), F.when(beat_status == "degraded", F.lit("heartbeat degraded")),
        F.when(F.size(degraded_names) > 0, F.concat(F.lit("degraded sources: "), F.array_join(degraded_names, ", "))),
    ))
    made = lambda s, code, reasons: F.struct(F.lit(s).alias("status"), F.lit(code).alias("exit_code"), reasons.alias("reasons"))
    return F.when(down.isNotNull(), made("down", 2, F.array(down))).when(F.size(causes) > 0, made("degraded", 1, causes)).otherwise(made("ok", 0, causes))
