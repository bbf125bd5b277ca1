"""Boards' payloads as files: one file a board's answer, read in parallel, kept as it was, and mapped to postings.

Answers too small for a file of their own lie together, a line each (opening a file costs more than reading some
thousand bytes). Files lie in `<folder>/platform=<name>/slug=<board>/`; asking for some platforms or boards reads only
their folders. A file's bytes stay in `raw` beside what was made of it. What can't be used becomes a
row of `rejected` with its reason, never a failed job: broken (no JSON), error (an error under a good
status), no_list (no list of postings where the platform keeps it), empty.

The postings of all platforms come out of one scan: each payload is read once and cut into objects,
and each platform's mapping is applied to its own objects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hirelake.sources import boards, feeds

#: Where payloads keep their list, tried in turn; the last is a payload that is the list.
LISTS = ("$.jobs", "$.results", "$.data", "$.postings", "$.offers", "$.content", "$.jobPostings", "$.opportunities", "$.requisitions", "$.items", "$")


def write(payloads: DataFrame, folder: str, payload: str = "payload", together: bool = False) -> None:
    """One file for each row, under its platform and slug; or, together, one line for each row, as many in a file as a task has of a board."""
    rows = payloads.select("platform", "slug", F.regexp_replace(payload, r"[\r\n]+", " ").alias("value"))
    if together:  # a board's rows come together, and Spark splits a large one
        rows.hint("rebalance", F.col("platform"), F.col("slug")).write.partitionBy("platform", "slug").mode("append").text(folder)
    else:
        rows.write.option("maxRecordsPerFile", 1).partitionBy("platform", "slug").mode("append").text(folder)


def captured(spark: SparkSession, folder: str, platforms: Sequence[str] = (), most_bytes: int = 64 << 20, together: bool = False) -> DataFrame:
    """platform, slug, file and raw of each file, or of each line of a file where answers lie together; those over most_bytes have a null raw, so that no task holds more at once."""
    rows = spark.read.schema("value string, platform string, slug string").option("wholetext", not together).text(folder)
    if platforms:
        rows = rows.where(F.col("platform").isin(*platforms))
    size = F.octet_length("value") if together else F.col("_metadata.file_size")
    return rows.select("platform", "slug", F.col("_metadata.file_path").alias("file"), F.when(size <= most_bytes, F.col("value")).alias("raw"))


def _list(raw: Column) -> Column:
    """The first list of objects in a payload, as texts; null without one."""
    found = [F.get_json_object(raw, p) for p in LISTS]
    return F.coalesce(*[F.when(F.startswith(F.ltrim(x), F.lit("[")), F.from_json(x, "array<string>")) for x in found])


def judged(captures: DataFrame) -> DataFrame:
    """The captures with their objects and the reason of those that can't be used."""
    broken = F.get_json_object("raw", "$").isNull()
    rows = captures.withColumn("objects", F.when(~broken, _list(F.col("raw"))))
    reason = (
        F.when(F.coalesce(F.trim("raw"), F.lit("")) == "", "empty").when(broken, "broken")
        .when(F.coalesce(feeds.is_error(F.col("raw")), F.lit(False)), "error").when(F.col("objects").isNull(), "no_list")
    )
    return rows.withColumn("reason", reason)


def rejected(captures: DataFrame) -> DataFrame:
    """platform, slug, file, reason and raw of what can't be used."""
    return judged(captures).where(F.col("reason").isNotNull()).select("platform", "slug", "file", "reason", "raw")


def postings(captures: DataFrame, wanted: tuple[str, ...] = (), unwanted: tuple[str, ...] = ()) -> DataFrame:
    """One row for each object that its platform's mapping can read and whose title passes: platform, slug, file, payload and the fields of `boards.record`.

    A platform's name looks up its mapping row by row, so a scan over all of them is one pass and one plan; platforms without a mapping give no rows.
    """
    known = judged(captures).where(F.col("reason").isNull() & F.col("platform").isin(*boards.RULES))
    rows = known.select("platform", "slug", "file", F.explode("objects").alias("payload"))
    mapped = rows.withColumn("r", boards.record_of(F.col("payload"), F.col("platform"), F.col("slug"))).select("platform", "slug", "file", "payload", "r.*").where(F.col("title").isNotNull() & F.col("url").isNotNull())
    return mapped.where(boards.title_passes(F.col("title"), wanted, unwanted)) if wanted or unwanted else mapped
