"""Records beside the postings: applications, detections, runs, probes, sessions of work. Each operator returns the new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Hours until the next try, by tries that failed, and how a look at a detection may end.
BACKOFF_HOURS = (1, 4, 24)
RESOLUTIONS = ("confirmed", "dismissed")
ENDED = ("done", "error", "cancelled")


def packages(old: DataFrame, new: DataFrame) -> DataFrame:
    """job_id, status, created, resolved, content: a new package replaces the job's old one and is pending again; of several the latest."""
    fresh = new.groupBy("job_id").agg(F.max_by(F.struct("created", "content"), F.struct("created", "content")).alias("n"))
    both = old.select("job_id", F.struct("status", "created", "resolved", "content").alias("o")).join(fresh, "job_id", "full_outer")
    n, o = F.col("n"), F.col("o")
    return both.select(
        "job_id", F.when(n.isNotNull(), "pending").otherwise(o["status"]).alias("status"), F.coalesce(n["created"], o["created"]).alias("created"),
        F.when(n.isNull(), o["resolved"]).alias("resolved"), F.when(n.isNotNull(), n["content"]).otherwise(o["content"]).alias("content"),
    )


def resolved(detections: DataFrame, looks: DataFrame) -> DataFrame:
    """Detections with the latest valid look's status and time; looks (detection_id, resolution, at) of any other word change nothing."""
    valid = looks.where(F.col("resolution").isin(*RESOLUTIONS)).groupBy("detection_id").agg(F.max_by(F.struct("resolution", "at"), F.struct("at", "resolution")).alias("_l"))
    both = detections.join(valid, "detection_id", "left")
    return both.withColumns({"status": F.coalesce("_l.resolution", "status"), "resolved_at": F.coalesce("_l.at", "resolved_at")}).drop("_l")


def pending(detections: DataFrame, jobs: DataFrame) -> DataFrame:
    """Detections that wait, with what is known of their job; a job that is gone or null leaves nulls."""
    job = jobs.select(F.col("dedup_key").alias("job_id"), F.col("title").alias("job_title"), F.col("company").alias("job_company"), F.col("status").alias("job_status"))
    return detections.where("status = 'pending'").join(job, "job_id", "left")


def run_log(found: DataFrame, run: str, at: str, stage: str) -> DataFrame:
    """One row per run: when it began, how many were fetched and kept, and the funnel of stages as JSON (in order of name)."""
    each = found.groupBy(run, stage).agg(F.count("*").alias("n"), F.min(at).alias("at"))
    funnel = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(stage, "n")))))  # one entry a stage, not a row
    return each.groupBy(run).agg(F.min("at").alias("began"), F.sum("n").alias("fetched"), funnel.alias("funnel"))


def reaped(work: DataFrame, at: Column, reason: str = "interrupted") -> DataFrame:
    """Work that a dead process left unfinished ends in error; a message that is there stays. A null status is unfinished."""
    open_ = ~F.coalesce(F.col("status").isin(*ENDED), F.lit(False))
    return work.withColumns({
        "error": F.when(open_, F.coalesce("error", F.lit(reason))).otherwise(F.col("error")),
        "finished": F.when(open_, at).otherwise(F.col("finished")),
        "status": F.when(open_, "error").otherwise(F.col("status")),
    })


def retry_after(failed_at: Column, failures_before: Column) -> Column:
    """When to try again: the hours of BACKOFF_HOURS by the failures before this one; the last of them from then on."""
    hours = F.element_at(F.array(*map(F.lit, BACKOFF_HOURS)), F.least(failures_before, F.lit(len(BACKOFF_HOURS) - 1)).cast("int") + 1)
    return failed_at + F.make_dt_interval(F.lit(0), hours)


def retry_schedule(attempts: DataFrame, key: str, at: str, failed: Column, tie: str) -> DataFrame:
    """Of each key: failures since the last success, and when to try again (null after a success)."""
    order = Window.partitionBy(key).orderBy(at, tie)
    run = attempts.withColumn("_ok", (~F.coalesce(failed, F.lit(False))).cast("int")).withColumn("_run", F.sum("_ok").over(order))
    each = run.groupBy(key, "_run").agg((F.count("*") - F.sum("_ok")).alias("failures"), F.max(at).alias("last"))
    last = each.groupBy(key).agg(F.max_by(F.struct("failures", "last"), "_run").alias("x")).select(key, "x.*")
    return last.select(key, "failures", F.when(F.col("failures") > 0, retry_after(F.col("last"), F.col("failures") - 1)).alias("retry_after"))


def rolled_back(runs: DataFrame, key: str, order: list[str], wins: Column, least: int = 2) -> DataFrame:
    """Runs at which the shadow has won so often in a row that the override goes; the count begins anew after a run it didn't win."""
    w = Window.partitionBy(key).orderBy(*order)
    counted = runs.withColumn("_win", F.coalesce(wins, F.lit(False)).cast("int")).withColumn("_lost", F.sum(1 - F.col("_win")).over(w))
    streak = F.sum("_win").over(Window.partitionBy(key, "_lost").orderBy(*order))
    return counted.withColumn("wins", streak).where((F.col("wins") > 0) & (F.col("wins") % least == 0)).drop("_win", "_lost")


def not_too_old(rows: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    """Rows of at most so many days; a row without a time stays."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= as_of - F.make_dt_interval(F.lit(days))))


def fresh(rows: DataFrame, key: str, at: str, value: str, as_of: Column, hours: int) -> DataFrame:
    """key and the latest value that isn't older than so many hours."""
    young = rows.where(F.col(at) >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return young.groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias(value), F.max(at).alias(at))


def scoring_counters(rows: DataFrame, outcome: str, classification: str) -> DataFrame:
    """One row: how many were scored into each class but low_signal, and how many ended dead, without a body or in error."""
    scored = F.col(outcome) == "scored"
    classes = [F.count_if(scored & (F.col(classification) == c)).alias(c) for c in ("apply", "consider", "skip", "reject")]
    return rows.agg(*classes, F.count_if(F.col(outcome) == "dead").alias("dead"), F.count_if(F.col(outcome) == "no_jd").alias("no_jd"), F.count_if(F.col(outcome) == "error").alias("errors"))
