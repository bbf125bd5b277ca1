"""Rules with a version, and rows that are swept again when the rules have moved on.

Rows carry the version of the rules that they were last made by. A sweep reads only those with a
lower one, makes them anew and stamps them; a second sweep finds nothing to read. Steps are pure
functions of a row, so a sweep that broke off is simply run again.

As files: a table keeps its rows in folders by version and by the version they were swept from. A
sweep reads the folders of old versions and no other, and overwrites the folder
`version=<new>/origin=<old>` in one commit; from then on readers pass over `version=<old>`, which
`vacuum` removes later. No row is rewritten that isn't stale, and no moment shows a row twice.

Defined results: a null version is older than any. Rows of a version above the current one are left
alone. Null titles and bodies are left alone too, and stamped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hirelake.functions.content import CARD_TAIL, body_reject, body_verdict, title_reason
from hirelake.functions.names import title_key
from hirelake.functions.vocab import MERGE_STATUS_RANK, rank

#: Reasons that the title rules and the body rules give.
TITLE_CODES = ("title_invalid_shape", "title_non_posting")
BODY_CODES = ("jd_full_offsite", "jd_full_expired")
#: Version that stands for rows without one.
NEVER = -1


# tables of files

def append(rows: DataFrame, folder: str, version: int) -> None:
    """New rows, made by the rules of a version."""
    rows.write.mode("append").parquet(f"{folder}/version={version}/origin={version}")


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _folders(spark: SparkSession, folder: str) -> dict[tuple[int, int], str]:
    """The committed folders of the table by (version, origin), without those that a later sweep has replaced."""
    fs, path = _store(spark, folder)
    found = {}
    for status in fs.globStatus(path(f"{folder}/version=*/origin=*/_SUCCESS")) or []:
        at = status.getPath().getParent()
        found[int(at.getParent().getName().split("=")[1]), int(at.getName().split("=")[1])] = at.toString()
    gone = {origin for version, origin in found if origin < version}
    return {k: v for k, v in found.items() if k[0] not in gone}


def stored(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame | None:
    """The table's rows with their version; below: of older versions only. None if there is no such folder."""
    found = [at for (version, _), at in _folders(spark, folder).items() if below is None or version < below]
    return spark.read.option("basePath", folder).parquet(*found).drop("origin") if found else None


def resweep(spark: SparkSession, folder: str, current: int, step: Callable[[DataFrame], DataFrame]) -> int:
    """Sweeps the rows of older versions with `step` (rows to rows, without version); gives how many versions there were."""
    old = sorted({version for version, _ in _folders(spark, folder) if version < current})
    for version in old:
        rows = stored(spark, folder, below=current).where(F.col("version") == version).drop("version")
        step(rows).write.mode("overwrite").parquet(f"{folder}/version={current}/origin={version}")
    return len(old)


def vacuum(spark: SparkSession, folder: str) -> int:
    """Removes folders that a sweep has replaced; gives how many versions."""
    fs, path = _store(spark, folder)
    live = {version for version, _ in _folders(spark, folder)}
    dead = [s.getPath() for s in fs.globStatus(path(f"{folder}/version=*")) or [] if int(s.getPath().getName().split("=")[1]) not in live]
    for at in dead:
        fs.delete(at, True)
    return len(dead)


# steps

def _other(reasons: Column, codes: Sequence[str]) -> Column:
    return F.filter(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: ~r.isin(*codes))


def _has(reasons: Column, codes: Sequence[str]) -> Column:
    return F.coalesce(F.exists(reasons, lambda r: r.isin(*codes)), F.lit(False))


def _with(reasons: Column, code: Column) -> Column:
    return F.when(code.isNotNull(), F.array_append(reasons, code)).otherwise(reasons)


def retitled(rows: DataFrame, scores: Sequence[str] = ("classification",)) -> DataFrame:
    """Titles without a card's tail, and the title reasons made anew; other reasons stay.

    raw_title keeps the first title that was changed. Scores go where a row gets its first title
    reason or the title's normal form changed. Columns: title, raw_title, reasons (array) and the scores.
    """
    stripped = F.trim(F.regexp_replace("title", CARD_TAIL, ""))
    new = F.coalesce(F.nullif(stripped, F.lit("")), F.col("title"))
    staged = rows.withColumn("_new", new).withColumn("_reasons", _with(_other(F.col("reasons"), TITLE_CODES), title_reason(F.col("_new"))))
    changed = F.col("_new") != F.col("title")
    caught = ~_has(F.col("reasons"), TITLE_CODES) & _has(F.col("_reasons"), TITLE_CODES)
    unscored = F.col("title").isNotNull() & (caught | (changed & (title_key(F.col("_new")) != title_key(F.col("title")))))
    none = F.col("title").isNull()
    return staged.withColumns(
        {c: F.when(~unscored, F.col(c)) for c in scores}
        | {"raw_title": F.when(changed, F.coalesce("raw_title", "title")).otherwise(F.col("raw_title")), "title": F.when(none, F.col("title")).otherwise(F.col("_new")), "reasons": F.when(none, F.col("reasons")).otherwise(F.col("_reasons"))}
    ).drop("_new", "_reasons")


def rebodied(rows: DataFrame, scores: Sequence[str] = ("classification",)) -> DataFrame:
    """Bodies that the body rules reject go, with tier and scores, and leave their reason; rows with a body get their body reasons made anew."""
    own = F.coalesce(F.trim("body"), F.lit("")) != ""
    staged = rows.withColumn("_code", F.when(own, body_reject(F.col("body"), F.col("title"))["reason"]))
    bad = F.col("_code").isNotNull()
    return staged.withColumns(
        {c: F.when(~bad, F.col(c)) for c in scores}
        | {"reasons": F.when(own, _with(_other(F.col("reasons"), BODY_CODES), F.col("_code"))).otherwise(F.col("reasons")), "body": F.when(~bad, F.col("body")), "tier": F.when(~bad, F.col("tier"))}
    ).drop("_code")


def adjudicated(rows: DataFrame, current: int, answers: DataFrame | None = None) -> DataFrame:
    """Judges bodies that have no reason against them and weren't judged at the current version: adds `verdict`, null where nothing was owed.

    clean: stamped (judged = current). reject: body and tier go, with the reason. ambiguous: an
    answer (job_id, keep) decides likewise; without one the row stays open and is taken up again.
    """
    owed = (F.coalesce(F.trim("body"), F.lit("")) != "") & (F.size(F.coalesce("reasons", F.array().cast("array<string>"))) == 0) & (F.coalesce("judged", F.lit(NEVER)) < current)
    staged = rows.withColumn("verdict", F.when(owed, body_verdict(F.col("body"), F.col("title"))))
    if answers is None:
        staged = staged.withColumn("_keep", F.lit(None).cast("boolean"))
    else:
        staged = staged.join(answers.groupBy("job_id").agg(F.bool_and("keep").alias("_keep")), "job_id", "left")
    open_ = F.col("verdict") == "ambiguous"
    keep = (F.col("verdict") == "clean") | (open_ & F.col("_keep"))
    lose = (F.col("verdict") == "reject") | (open_ & ~F.col("_keep"))
    code = F.when(F.col("verdict") == "reject", body_reject(F.col("body"), F.col("title"))["reason"]).otherwise(BODY_CODES[0])
    flags = staged.withColumns({"_hold": F.coalesce(keep, F.lit(False)), "_lose": F.coalesce(lose, F.lit(False))}).withColumn("_code", F.when(F.col("_lose"), code))
    return flags.withColumns(
        {"judged": F.when(F.col("_hold"), F.lit(current)).otherwise(F.col("judged")), "reasons": _with(F.coalesce("reasons", F.array().cast("array<string>")), F.col("_code")), "body": F.when(~F.col("_lose"), F.col("body")), "tier": F.when(~F.col("_lose"), F.col("tier"))}
    ).drop("_keep", "_hold", "_lose", "_code")


def rekeyed(rows: DataFrame, current: int, key: Column, scores: Sequence[str] = ("classification",)) -> tuple[DataFrame, DataFrame]:
    """Keys of stale rows made anew, and rows that now share one merged: the rows, and the lineage (duplicate_id, canonical_id).

    Columns: job_id, key, version, first_seen, last_seen, status and the scores; others come from the
    canonical row, the one seen first. Only keys that a stale row now has are looked at again: rows
    of other keys pass by. A merged row is queued for scoring; a row that only got a new key keeps
    its scores. Statuses merge upwards, as in a retroactive merge.
    """
    stale = F.coalesce("version", F.lit(NEVER)) < current
    staged = rows.withColumn("_stale", stale).withColumn("key", F.when(F.col("_stale"), key).otherwise(F.col("key")))
    touched = staged.where("_stale").select("key").distinct()
    again, rest = staged.join(touched, "key", "left_semi"), staged.join(touched, "key", "left_anti")
    names = [c for c in rows.columns if c not in ("key", "version")]
    at = F.struct("first_seen", "job_id")
    top = F.max(rank(MERGE_STATUS_RANK, F.col("status")))
    best = F.max_by("status", F.struct(rank(MERGE_STATUS_RANK, F.col("status")), F.col("status")))
    sums = again.groupBy("key").agg(F.min_by(F.struct(*names), at).alias("r"), F.count("*").alias("n"), F.max("last_seen").alias("seen"), F.when(top >= 2, best).otherwise("discovered").alias("merged"))
    several = F.col("n") > 1

    def value(c: str) -> Column:
        if c in scores:
            return F.when(~several, F.col(f"r.{c}"))
        return {"last_seen": F.col("seen"), "status": F.when(several, F.col("merged")).otherwise(F.col("r.status"))}.get(c, F.col(f"r.{c}"))

    out = sums.select("key", F.lit(current).alias("version"), *(value(c).alias(c) for c in names))
    first = sums.where(several).select("key", F.col("r.job_id").alias("canonical_id"))
    gone = again.join(first, "key").where(F.col("job_id") != F.col("canonical_id")).select(F.col("job_id").alias("duplicate_id"), "canonical_id")
    whole = out.unionByName(rest.select("key", F.col("version").cast("int").alias("version"), *names))
    return whole.select(*rows.columns), gone
