"""Plans that are repeated until nothing changes, with the state written between passes.

`until_stable` is the loop: a step makes the next state of a table and says which rows it changed;
the state is written to the shared folder, so a plan never grows with the passes and a lost
executor only repeats the last one. It ends when a pass changes nothing. Steps must move each row
in one direction only (what is taken back stays taken back), so the passes end; `most` is how many
a caller's rule allows, and one more raises instead of returning half a result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from hirelake.streaming.stateful import shared_folder

#: Roles with the same list from which on they move together.
MANY = 16


def written(df: DataFrame, name: str = "state") -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, and its size is known to the planner."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.written_to = folder
    return out


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """As written, in buckets by a key by which the rows are dealt into as many partitions: joins and groups by it don't shuffle the table."""
    folder = shared_folder(df.sparkSession, name)
    named = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(named)
    out = df.sparkSession.table(named)
    out.written_to, out.named = folder, named
    return out


def discard(table: DataFrame) -> None:
    """Removes a table that `written` or `bucketed` made."""
    spark = table.sparkSession
    if getattr(table, "named", None):
        spark.sql(f"DROP TABLE {table.named}")
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def until_stable(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], changed: Callable[[], Column], most: int) -> tuple[DataFrame, int]:
    """The state after as many passes as change something, and their number. step(state, pass) gives the next state; changed() is true for a row it changed."""
    state = written(state)
    for number in range(1, most + 2):
        before, state = state, written(step(state, number))
        discard(before)
        if state.where(changed()).isEmpty():
            return state, number - 1
        if number > most:
            break
    raise RuntimeError(f"still changing after {most} passes")


def reverted(jobs: DataFrame, events: DataFrame, detections: DataFrame, first: str = "discovered", movable: tuple[str, ...] = ("phone_screen", "applied"), most: int = 100) -> DataFrame:
    """Takes back promotions that a mail set off and that wouldn't be made any more, and then those below them.

    jobs: job_id, status. events: job_id, ts, from_status, to_status, auto (whether a detection made it).
    detections: detection_id, job_id, ts, valid. In each pass a job's newest automatic event into its status
    counts, with its newest detection not after it that isn't dismissed. A valid one keeps the job as it
    is; without any it stays too. An invalid one is dismissed and the job goes back to where it came from,
    which the next pass looks at. A pass dismisses a detection of each job that it moves, so there are at
    most as many passes as a job has detections, and one more that changes nothing; `most` bounds them.

    Result, a row a job: job_id, status, n_reverted, outcome (untouched, kept, no_detection, reverted)
    and dismissed (ids in the order they were dismissed). A null `from_status` is `first`; a job without a status is `first`.
    """
    none = F.array().cast("array<long>")
    state = jobs.select("job_id", F.coalesce("status", F.lit(first)).alias("status"), F.lit(0).alias("n_reverted"), F.lit("untouched").alias("outcome"), none.alias("dismissed"), F.lit(True).alias("moved"))
    if not movable:
        return state.drop("moved")
    # what no pass changes is worked out once: the newest step into each status, and the detections that may count from there
    steps = events.where("auto").where(F.col("to_status").isin(*movable)).groupBy("job_id", F.col("to_status").alias("status"))
    newest = written(steps.agg(F.max(F.struct("ts", F.coalesce("from_status", F.lit(first)).alias("prior"))).alias("e")), "newest")
    times = newest.groupBy("job_id").agg(*[F.max(F.when(F.col("status") == s, F.col("e.ts"))).alias(f"t{i}") for i, s in enumerate(movable)])
    told = detections.select("job_id", "detection_id", F.col("ts").alias("seen"), "valid").join(times, "job_id")
    at = F.struct("seen", "detection_id")
    # a valid one is never dismissed, so none before the newest valid one is looked at
    stops = told.where("valid").groupBy("job_id").agg(*[F.max(F.when(F.col("seen") <= F.col(f"t{i}"), at)).alias(f"v{i}") for i in range(len(movable))])
    may = [(F.col("seen") <= F.col(f"t{i}")) & (F.col(f"v{i}").isNull() | (at >= F.col(f"v{i}"))) for i in range(len(movable))]
    found = told.join(stops, "job_id", "left").where(reduce(or_, may, F.lit(False))).select("job_id", "detection_id", "seen", "valid")
    found = written(found, "detections")

    def step(now: DataFrame, number: int) -> DataFrame:
        open_ = now.where(F.col("moved") & F.col("status").isin(*movable))
        rest = now.where(~(F.col("moved") & F.col("status").isin(*movable))).withColumn("moved", F.lit(False))
        last = open_.join(newest, ["job_id", "status"], "left")
        may = (F.col("seen") <= F.col("e.ts")) & ~F.coalesce(F.array_contains("dismissed", F.col("detection_id")), F.lit(False))
        # one row a job: the newest detection that may count
        cause = last.join(found, "job_id", "left").groupBy(*now.columns, "e").agg(F.max(F.when(may, F.struct("seen", "detection_id", "valid"))).alias("d"))
        bad = F.col("d").isNotNull() & ~F.col("d.valid")
        outcome = F.when(F.col("e.ts").isNull(), F.col("outcome")).when(F.col("d").isNull(), "no_detection").when(bad, "reverted").otherwise("kept")
        after = cause.select(
            "job_id", F.when(bad, F.col("e.prior")).otherwise(F.col("status")).alias("status"), (F.col("n_reverted") + bad.cast("int")).alias("n_reverted"),
            outcome.alias("outcome"), F.when(bad, F.concat("dismissed", F.array("d.detection_id"))).otherwise(F.col("dismissed")).alias("dismissed"), bad.alias("moved"),
        )
        return after.unionByName(rest)

    done = until_stable(state, step, lambda: F.col("moved"), most)[0].drop("moved")
    discard(newest)
    discard(found)
    return done


def assigned(pairs: DataFrame, most: int = 10_000) -> DataFrame:
    """One job for each role as if roles chose in turn, each the best job that is still free.

    pairs: role, turn (a role's place among the roles), job, rank (how a role likes a job, lower first; ties
    go to the smaller job). Result: role, job, rank of those that got one.

    Instead of one role after another, all propose at once: a job holds the role with the earliest
    turn among those that ask, and the others ask their next one. Since all jobs agree on who comes
    first, this ends in what choosing in turn gives. Roles with the same list would ask in vain for
    what the ones before them take, so the n-th of them begins at its n-th job, and stays behind the
    one before it (where at least MANY share a list; the passes do it for fewer). Each pass moves at least one role
    forward, so passes end. A pass carries only the roles that it moved, and those of shared lists: a role that got its
    job rests, in buckets by job, until an earlier one asks for it. The lists lie in buckets by role. Neither is
    shuffled again, and a job's many askers are reduced before they are shuffled.

    Rows that repeat a role and job count once, with the best rank. Null roles and jobs are left out.
    """
    spark = pairs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by role once: counting, ordering and writing all keep to it
    dealt = pairs.where("role IS NOT NULL AND job IS NOT NULL").repartition(buckets, "role")
    once = dealt.groupBy("role", "job").agg(F.min("rank").alias("rank"), F.min("turn").alias("turn"))
    liked = Window.partitionBy("role").orderBy("rank", "job")
    lists = bucketed(once.withColumn("pos", F.row_number().over(liked)), "role", buckets, "lists")
    # a list's sign is a sum, so no list is gathered
    sign = F.sum(F.xxhash64("job", "pos").cast("decimal(38,0)"))
    own = lists.groupBy("role").agg(F.min("turn").alias("turn"), sign.alias("list"), F.max("pos").alias("n"))
    order = Window.partitionBy("list", "n").orderBy("turn", "role")
    alike = own.withColumn("nth", F.row_number().over(order))
    # a list that few roles have needs no sign: there the passes alone are as quick
    sizes = Window.partitionBy("list", "n")
    shared = F.when(F.max("nth").over(sizes) >= MANY, F.col("list"))
    # places are told apart after roles have met, so that the lists' buckets serve
    choices = lists.select(F.col("role").alias("_role"), F.col("pos").alias("_pos"), "job", "rank")
    kept = ["role", "turn", "list", "n", "nth", "pos"]
    one = F.struct("turn", "role")
    #: those that got a job in each pass; whoever of them comes earliest has it
    rested: list[DataFrame] = []

    def asking(at: DataFrame) -> DataFrame:
        """The roles with the job they ask for; those past the end of their list are left out."""
        return at.select(*kept).join(choices, (F.col("role") == F.col("_role")) & (F.col("pos") - F.col("_pos") == 0)).select(*kept, "job", "rank", F.lit(True).alias("moved"))

    def step(now: DataFrame, number: int) -> DataFrame:
        """now: roles that have moved on, and all of the lists that many share."""
        first = now.groupBy("job").agg(F.min(one).alias("first"))
        columns = [*kept, "job", "rank", "moved", "on"]
        if not rested:
            asked = now.join(first, "job").withColumn("on", (F.col("first.role") != F.col("role")).cast("int")).select(*columns)
            after = bucketed(asked, "job", buckets, "asked")
        else:
            met = reduce(DataFrame.unionByName, [r.join(first.select("job"), "job") for r in rested])
            holder = met.groupBy("job").agg(F.min(F.struct("turn", "role", "list", "n", "nth", "pos", "rank")).alias("h"))
            has = F.when(F.col("h").isNotNull(), F.struct("h.turn", "h.role"))
            contest = first.join(holder, "job", "left").withColumn("first", F.least("first", has))
            asked = now.join(contest.select("job", "first"), "job").withColumn("on", (F.col("first.role") != F.col("role")).cast("int")).select(*columns)
            # those of a shared list are among the asking ones anyway
            ousted = contest.where((F.col("h.role") != F.col("first.role")) & F.col("h.list").isNull()).select("job", "h.*", F.lit(True).alias("moved"), F.lit(1).alias("on"))
            after = written(asked.unionByName(ousted), "asked")
        rested.append(after.where("on = 0 AND moved"))
        alone = after.where("list IS NULL AND on = 1").withColumn("next", F.col("pos") + 1)
        # no role stands before one of the same list that comes earlier, or beside it
        behind = F.max(F.col("pos") + F.col("on") - F.col("nth")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("nth")
        alike = after.where("list IS NOT NULL").withColumn("next", behind)
        stay = alike.where(F.col("next") == F.col("pos")).select(*kept, "job", "rank", F.lit(False).alias("moved"))
        return stay.unionByName(asking(alone.unionByName(alike.where(F.col("next") != F.col("pos"))).withColumn("pos", F.col("next"))))

    start = asking(alike.select("role", "turn", shared.alias("list"), "n", "nth", F.col("nth").alias("pos")))
    done, _ = until_stable(start, step, lambda: F.col("moved"), most)
    discard(done)
    discard(lists)
    late = reduce(DataFrame.unionByName, rested[1:], rested[0].limit(0))
    last = late.groupBy("job").agg(F.min(F.struct("turn", "role", "rank")).alias("h")).select("h.role", "job", "h.rank")
    return rested[0].join(late.select("job"), "job", "left_anti").select("role", "job", "rank").unionByName(last)
