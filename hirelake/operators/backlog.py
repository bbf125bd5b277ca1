"""What waits for work, and small records of it: batches, eligible counts, gold rows, direct links, notes, costs, tallies and the funnel's alarm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hirelake.functions.names import title_passes

#: Probe results of companies whose platform is still to be found, and outcomes of a judged pair.
UNSETTLED = ("miss", "error", "pending")
VERDICTS = ("A", "B", "tie")


def quartiles(rows: DataFrame, key: str, score: str, buckets: int = 4) -> DataFrame:
    """key and quartile: NTILE over all rows by score (nulls first) and key; rows without a score are then in bucket 0.

    The place of a row is the number of rows of lower scores, from a histogram, and its place among
    equal ones, so no single task orders everything; scores are few different values.
    """
    own = rows.select(key, score)
    counts = own.groupBy(score).agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.col(score).asc_nulls_first())
    places = counts.select(F.col(score).alias("_s"), F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    inside = F.row_number().over(Window.partitionBy(score).orderBy(key)) - 1
    at = own.withColumn("_i", inside).join(places, F.col(score).eqNullSafe(F.col("_s"))).withColumn("_at", F.col("_before") + F.col("_i"))
    each, more = F.floor(F.col("_all") / buckets), F.col("_all") % buckets
    wide = more * (each + 1)
    tile = F.when(F.col("_at") < wide, F.floor(F.col("_at") / (each + 1)) + 1).otherwise(F.floor((F.col("_at") - wide) / F.greatest(each, F.lit(1))) + more + 1)
    return at.select(key, F.when(F.col(score).isNull(), 0).otherwise(tile.cast("int")).alias("quartile"))


def bucket_batch(bucketed: DataFrame, key: str, bucket: str, size: int, seed: int = 42) -> DataFrame:
    """Rows of a batch: as many of each bucket that has any as share the size, rounded up, in an order that a hash of seed and key gives."""
    n = bucketed.select(bucket).distinct().count()
    each = max(1, -(-size // n)) if n else 0
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    ranked = bucketed.withColumn("_rn", F.row_number().over(Window.partitionBy(bucket).orderBy(draw, key)))
    return ranked.where(F.col("_rn") <= each).drop("_rn")


def gold_rows(rows: DataFrame, key: str, gold: str = "gold_classification") -> DataFrame:
    """Rows that people have labelled, by key."""
    return rows.where(F.col(gold).isNotNull()).orderBy(key)


def promotion_batch(companies: DataFrame, key: str, most: int) -> DataFrame:
    """The first companies that are scanned and whose platform isn't settled."""
    return companies.where(F.col("probe").isin(*UNSETTLED) & F.col("enabled")).orderBy(key).limit(most)


def phase_counts(companies: DataFrame, may: Column, now: Column, no_scanner: Sequence[str] = (), browser: Sequence[str] = ()) -> DataFrame:
    """How many companies each scan phase may take. Columns: probe, platform, homepage, enabled, retry_after.

    a: hits, and errors whose time to try again has come, on platforms without a browser. c: misses
    and errors, and hits on platforms that no scanner reads, with a homepage. may: the gate on their history.
    """
    platform = F.coalesce("platform", F.lit(""))
    ready = (F.col("probe") == "hit") | ((F.col("probe") == "error") & (F.col("retry_after").isNull() | (F.col("retry_after") < now)))
    a = F.col("enabled") & may & ready & ~platform.isin(*browser)
    c = F.col("enabled") & may & F.col("homepage").isNotNull() & (F.col("probe").isin("miss", "error") | ((F.col("probe") == "hit") & platform.isin(*no_scanner)))
    return companies.agg(F.count_if(a).alias("a"), F.count_if(c).alias("c"))


def extraction_backlog(jobs: DataFrame, least: int = 200, tag: str = "location_missing") -> DataFrame:
    """Jobs without a location, with a body to find it in, that weren't tried in vain before."""
    empty = F.coalesce("location", F.lit("")) == ""
    return jobs.where(empty & (F.length("body") >= least) & ~F.array_contains(F.coalesce("reasons", F.array().cast("array<string>")), tag))


def candidates(found: DataFrame, page: str, place: str, title: str, url: str, wanted: tuple[str, ...], unwanted: tuple[str, ...] = ()) -> DataFrame:
    """Candidates whose title passes; of those with one url on a page the first. Titles are looked at first, so a link that fails claims no url."""
    fit = found.where(title_passes(F.col(title), wanted, unwanted))
    blank = F.coalesce(F.col(url), F.lit("")) == ""
    first = F.row_number().over(Window.partitionBy(page, url).orderBy(place)) == 1
    return fit.where(~blank).withColumn("_first", first).where("_first").drop("_first").unionByName(fit.where(blank))


def with_direct_links(jobs: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """jobs with direct_url and confidence, where precedence lets a link (key, url, confidence) in.

    Only strict and loose links with a url count. A strict one replaces a loose one or none, a loose
    one only none; a strict one stays. Of several, strict first, then the least url.
    """
    good = links.where((F.coalesce("url", F.lit("")) != "") & F.col("confidence").isin("strict", "loose"))
    best = good.groupBy(key).agg(F.min(F.struct((F.col("confidence") != "strict").alias("c"), "url", "confidence")).alias("_l"))
    both = jobs.join(best, key, "left")
    may = F.col("_l").isNotNull() & (F.col("direct_confidence").isNull() | ((F.col("_l.confidence") == "strict") & (F.col("direct_confidence") != "strict")))
    return both.withColumns({"direct_url": F.when(may, F.col("_l.url")).otherwise(F.col("direct_url")), "direct_confidence": F.when(may, F.col("_l.confidence")).otherwise(F.col("direct_confidence"))}).drop("_l")


def with_notes(jobs: DataFrame, notes: DataFrame, key: str, at: str) -> DataFrame:
    """jobs with the newest note (key, note, at) of each that has one; an empty note clears."""
    last = notes.groupBy(key).agg(F.max_by(F.struct(F.nullif(F.trim("note"), F.lit("")).alias("note")), F.struct(at, "note")).alias("_n"))
    return jobs.join(last, key, "left").withColumn("note", F.when(F.col("_n").isNotNull(), F.col("_n.note")).otherwise(F.col("note"))).drop("_n")


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls (provider, model, tokens_in, tokens_out) with their cost, by prices a million tokens in and out; a model without a price, or a free provider, costs nothing."""
    both = calls.join(prices.groupBy("provider", "model").agg(F.max("price_in").alias("_i"), F.max("price_out").alias("_o")), ["provider", "model"], "left")
    cost = (F.coalesce("tokens_in", F.lit(0)) * F.coalesce("_i", F.lit(0.0)) + F.coalesce("tokens_out", F.lit(0)) * F.coalesce("_o", F.lit(0.0))) / 1_000_000
    return both.withColumn("cost", F.round(cost, 6)).drop("_i", "_o")


def verdict_tallies(judged: DataFrame, by: Sequence[str], verdict: str = "verdict", confidence: str = "confidence") -> DataFrame:
    """n, the share of each verdict and the mean confidence of each group; other verdicts count in n only."""
    v = F.col(verdict)
    shares = [F.round(F.avg((v == name).cast("double")), 6).alias(f"share_{name.lower()}") for name in VERDICTS]
    return judged.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *shares, F.round(F.avg(confidence), 6).alias("confidence"))


def funnel_alarm(runs: DataFrame, most: int = 0, source: str = "ingestion", by: Sequence[str] = ()) -> DataFrame:
    """How many rows the newest run of the source (of each group) can't explain, if they are more than `most` (below 0: never). Metadata that isn't a number of them gives none."""
    newest = runs.where((F.col("source") == source) & F.col("metadata").isNotNull()).groupBy(*by).agg(F.max_by("metadata", "ts").alias("m"))
    n = F.get_json_object("m", "$.unexplained")
    return newest.select(*by, F.when(F.regexp_like(n, F.lit(r"^-?\d+$")), n.cast("long")).alias("unexplained")).where((F.col("unexplained") > most) & F.lit(most >= 0))


def inbox_activity(log: DataFrame, now: Column, hours: int, at: str = "processed_at", found: str = "jobs_found") -> DataFrame:
    """How many mails were read in the last hours, and how many jobs they held."""
    since = now - F.make_interval(hours=F.lit(hours))
    return log.where(F.col(at) >= since).agg(F.count("*").alias("emails"), F.coalesce(F.sum(found), F.lit(0)).alias("jobs"))
