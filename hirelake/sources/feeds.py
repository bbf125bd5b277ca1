"""Sources and sinks: board feeds, ATS payloads, sitemaps, event logs, mail. All read through Spark's own readers.

Fields are found by alias lists, first one that isn't empty. Rows that can't be read go to `_bad`
instead of failing a load.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hirelake.sources.recipes import Aliases

#: Names under which feeds and boards keep a field.
ALIASES = {
    "title": ("title", "name", "text", "position", "job_title", "jobTitle"),
    "company": ("company", "company_name", "companyName", "organization"),
    "location": ("location", "candidate_required_location", "jobGeo", "city"),
    "url": ("url", "jobUrl", "absolute_url", "hostedUrl", "link", "apply_url"),
    "body": ("description", "descriptionPlain", "content", "jobDescription", "snippet"),
    "posted": ("publication_date", "pubDate", "first_published", "publishedAt", "createdAt", "releasedDate", "date"),
    "source_id": ("id", "requisition_id", "reqId", "slug"),
}
#: Keys of payloads that say an error came with a good status.
ERROR_KEYS = ("error", "errors", "error_message", "message")
RECORD = "title string, company string, location string, url string, body string, posted string, source_id string"


def field(payload: Column, names: Sequence[str], keys: Column | None = None) -> Column:
    """The first of the names whose value isn't empty, of a JSON object in text. keys: the object's, so that only names it has are looked for (paths always are)."""
    has = lambda n: F.lit(f"$.{n}") if keys is None or not re.fullmatch(r"\w+", n) else F.when(F.array_contains(keys, n), f"$.{n}")
    found = F.transform(F.array_compact(F.array(*map(has, names))), lambda path: F.trim(F.call_function("get_json_object", payload, path)))
    return F.get(F.filter(found, lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))


def is_error(payload: Column) -> Column:
    """An object with an error key and no list of results."""
    error = F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in ERROR_KEYS])
    return error.isNotNull() & F.coalesce(F.get_json_object(payload, "$.results"), F.get_json_object(payload, "$.jobs")).isNull()


def postings(payloads: DataFrame, column: str = "payload", more: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One record per JSON object; without title or company it is left out. more: further names of fields, tried after the known ones."""
    names_of = {name: (*names, *(n for n in (more or {}).get(name, ()) if n not in names)) for name, names in ALIASES.items()}

    def read(p: Column) -> Column:
        return F.struct(p.alias("payload"), F.json_object_keys(p).alias("keys"))

    def told(r: Column) -> Column:
        payload, keys = r["payload"], r["keys"]
        error = F.when(F.arrays_overlap(keys, F.array(*map(F.lit, ERROR_KEYS))), is_error(payload))
        return F.struct(F.coalesce(error, F.lit(False)).alias("_error"), *[field(payload, names, keys).alias(name) for name, names in names_of.items()])

    # generated, so that no filter makes the payload and its fields a second time
    out = payloads.select("*", F.inline_outer(F.transform(F.transform(F.array(column), read), told)))
    out = out.where(~F.col("_error") & F.col("title").isNotNull() & F.col("company").isNotNull()).drop("_error")
    return out.withColumn("location", F.coalesce("location", F.lit("Remote")))


#: Where payloads keep their list of postings, tried in turn.
LISTS = ("$.jobs", "$.results", "$.data", "$.postings", "$")


def aliased(documents: DataFrame, recipe: Aliases, column: str = "doc") -> DataFrame:
    """Postings of payloads of a source whose names a recipe of aliases adds to the known ones; its lists are looked for after the known ones."""
    found = objects(documents, column, (*LISTS[:-1], *(f"$.{n}" for n in recipe.arrays), LISTS[-1]))
    return postings(found, more={"title": recipe.title, "url": recipe.url})


def objects(documents: DataFrame, column: str, paths: Sequence[str] = LISTS) -> DataFrame:
    """The objects of the first path that holds an array, one row each, as payload."""
    arrays = [F.from_json(F.get_json_object(column, p), "array<string>") for p in paths]
    return documents.select("*", F.explode(F.coalesce(*arrays)).alias("payload"))


def json_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(folder)


def sitemap(spark: SparkSession, folder: str) -> DataFrame:
    """loc and lastmod of the url entries."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(folder)


def first_seen_urls(rows: DataFrame, url: str, order: Sequence[str]) -> DataFrame:
    """The first row of each URL in the order; rows without one all stay."""
    blank = F.coalesce(F.trim(url), F.lit("")) == ""
    firsts = rows.where(~blank).groupBy(url).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
    return firsts.unionByName(rows.where(blank))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def append(rows: DataFrame, folder: str, by: Sequence[str] = ()) -> None:
    """Rows added to a table of Parquet files."""
    rows.write.mode("append").partitionBy(*by).parquet(folder)


def append_log(events: DataFrame, folder: str) -> None:
    events.write.mode("append").json(folder)


_BLOCK = r"\n-{10,}\n"


def mail_postings(mail: DataFrame, body: str = "body") -> DataFrame:
    """Postings of alert mail: blocks set apart by dashes, with a job link; title, company and place are its first lines."""
    blocks = mail.select("*", F.posexplode(F.split(F.col(body), _BLOCK)).alias("block_no", "block"))
    link = F.regexp_extract("block", r"View job:\s*(\S+)", 1)
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("View job:")))
    rows = blocks.withColumn("url", link).withColumn("lines", lines).where((F.col("url") != "") & (F.size("lines") >= 2))
    return rows.withColumn("title", F.get("lines", 0)).withColumn("company", F.get("lines", 1)).withColumn("location", F.coalesce(F.get("lines", 2), F.lit("Unknown"))).drop("lines", "block")


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """link and text of the anchors of each page, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = pages.select("*", F.posexplode(found).alias("place", "anchor"))
    text = F.trim(F.regexp_replace(F.regexp_replace("anchor", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.withColumn("link", F.regexp_extract("anchor", r'(?is)href="([^"]*)"', 1)).withColumn("text", text).drop("anchor")


def embedded_json(pages: DataFrame, html: str = "html") -> DataFrame:
    """Payloads of script elements that hold JSON, one row each."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?is)<script[^>]*type="application/(?:ld\+)?json"[^>]*>(.*?)</script>'), F.lit(1))
    return pages.select("*", F.explode(found).alias("payload"))
