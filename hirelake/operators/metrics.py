"""Dashboard figures over postings, their events and companies. Inputs and time are parameters; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions.vocab import HIDDEN_STATUSES, PROTECTED_STATUSES, STAGE_RANK, TERMINAL_STATUSES, rank
from hirelake.plans.views import days_between


def stat_cards(jobs: DataFrame, as_of: Column) -> DataFrame:
    """One row: all, new on the day of as_of, in review, open, and older than 30 days."""
    return jobs.agg(
        F.count("*").alias("total"),
        F.count_if(F.to_date("first_seen") == F.to_date(as_of)).alias("new_today"),
        F.count_if(F.col("status") == "reviewing").alias("reviewing"),
        F.count_if(~F.col("status").isin(*HIDDEN_STATUSES)).alias("open_jobs"),
        F.count_if(days_between(as_of, F.col("first_seen")) > 30).alias("old_jobs"),
    )


def status_rollup(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.coalesce("status", F.lit("discovered")).alias("status")).agg(F.count("*").alias("n"))


def last_stage(events: DataFrame) -> DataFrame:
    """job_id and the furthest stage it ever reached."""
    return events.groupBy("job_id").agg(F.max(rank(STAGE_RANK, F.col("to_status"))).alias("stage"))


def conversion(jobs: DataFrame, events: DataFrame, bands: DataFrame) -> DataFrame:
    """Per band: scored, applied, converted, and their rates; bands without jobs stay at zero."""
    joined = jobs.join(last_stage(events), jobs["dedup_key"] == F.col("job_id"), "left")
    counts = joined.groupBy("classification").agg(
        F.count("*").alias("scored"),
        F.count_if(F.col("stage") >= 1).alias("applied"),
        F.count_if(F.col("stage") >= 2).alias("converted"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return bands.join(counts, "classification", "left").select(
        "classification", zero("scored").alias("scored"), zero("applied").alias("applied"), zero("converted").alias("converted"),
        F.round(F.try_divide("applied", "scored"), 6).alias("application_rate"),
        F.round(F.try_divide("converted", "applied"), 6).alias("callback_rate"),
    )


def concentration(groups: DataFrame, key: str) -> DataFrame:
    """One row: groups, normalised Herfindahl index and entropy (bits, and of the most there could be) of the counts."""
    counts = groups.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("groups"))
    share = F.col("n") / F.col("total")
    sums = counts.crossJoin(F.broadcast(total)).groupBy("total", "groups").agg(  # one row of totals
        F.sum(share * share).alias("squares"), (-F.sum(share * F.log2(share))).alias("bits")
    )
    g = F.col("groups")
    return sums.select(
        g.alias("groups"),
        F.round(F.when(g == 1, 1.0).otherwise(F.try_divide(F.col("squares") - 1 / g, 1 - 1 / g)), 6).alias("hhi"),
        F.round(F.when(g > 1, F.col("bits")), 6).alias("entropy"),
        F.round(F.when(g > 1, F.try_divide("bits", F.log2(g.cast("double")))), 6).alias("evenness"),
    )


def latency(pairs: DataFrame, posted: str, seen: str, most_days: float = 30) -> DataFrame:
    """One row: nearest-rank p50, p95 and p99 of the days from posted to seen, and the part of rows that count."""
    days = days_between(F.col(seen), F.col(posted))
    usable = (F.col(seen) != F.col(posted)) & days.between(0, most_days)
    rows = pairs.select(F.when(usable, days).alias("d"))
    return rows.agg(
        F.count("d").alias("sample_n"),
        *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY d)").alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)],
        F.round(F.try_divide(F.count("d") * 100.0, F.count("*")), 1).alias("coverage"),
    )


def stage_age(jobs: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Whole days each job has been in its status: since the last event that led there, or since it was first seen."""
    entered = events.groupBy("job_id", "to_status").agg(F.max("ts").alias("entered"))
    at = jobs.join(entered, (jobs["dedup_key"] == F.col("job_id")) & (jobs["status"] == F.col("to_status")), "left")
    since = F.coalesce("entered", "first_seen")
    return at.select("dedup_key", "status", F.greatest(F.lit(0), F.floor(days_between(as_of, since))).cast("long").alias("days_in_stage"))


def ghosts(jobs: DataFrame, events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Open jobs older than `days` that no event ever took to a protected status."""
    pursued = events.where(F.col("to_status").isin(*PROTECTED_STATUSES)).select(F.col("job_id").alias("dedup_key")).distinct()
    old = jobs.where(~F.col("status").isin(*TERMINAL_STATUSES) & (days_between(as_of, F.col("first_seen")) > days))
    return old.join(pursued, "dedup_key", "left_anti")


def liveness(jobs: DataFrame, dead: Column, ended: Column) -> DataFrame:
    """One row: the part of jobs that live, and mean and median days that the dead ones lived."""
    age = F.when(dead, days_between(ended, F.col("first_seen")))
    return jobs.agg(
        F.round(F.try_divide(F.count_if(~dead), F.count("*")), 6).alias("live_share"),
        F.round(F.avg(age), 6).alias("mean_dead_age"),
        F.round(F.median(age), 6).alias("median_dead_age"),
    )


def miss_log(jobs: DataFrame, companies: DataFrame, reachable: tuple[str, ...], disabled: Column) -> DataFrame:
    """Off-platform jobs by whether their company's platform can be scanned."""
    joined = jobs.join(companies, "company_id", "left")
    bucket = (
        F.when(F.col("platform").isNull(), "untracked").when(~F.col("platform").isin(*reachable), "unsupported")
        .when(disabled, "scan_disabled").otherwise("reachable")
    )
    return joined.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def wilson(successes: Column, total: Column, z: float = 1.96) -> Column:
    """struct(low, high): the Wilson score interval, null for no trials."""
    p = F.try_divide(successes, total)
    centre, spread = p + z * z / (2 * total), z * F.sqrt(F.try_divide(p * (1 - p), total) + F.try_divide(F.lit(z * z), 4 * total * total))
    by = 1 + F.try_divide(F.lit(z * z), total)
    return F.struct(((centre - spread) / by).alias("low"), ((centre + spread) / by).alias("high"))
