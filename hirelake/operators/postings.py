"""Field-level merging of postings into a snapshot, and the guarded writes of single fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions import locations as L, salary as S
from hirelake.functions.content import is_junk_body
from hirelake.functions.vocab import PRECISION_RANK, PROVENANCE_RANK, rank
from hirelake.operators.merge import merged_places, merged_text

#: Columns of a snapshot, beside the key.
FIELDS = (
    "company_id", "source_id", "title", "company", "sources", "source_urls", "locations_raw", "locations", "description", "body", "salary_min", "salary_max", "salary_provenance",
    "posted_date", "posted_precision", "workplace_type", "country_code", "first_seen", "last_seen", "status", "is_stale", "expired_at",
)
#: Columns whose change makes a posting updated.
CANONICAL = ("locations_raw", "locations", "description", "body", "salary_min", "salary_max", "posted_date")


def folded(new: DataFrame, key: str = "dedup_key", seen: str = "last_seen") -> DataFrame:
    """One row per key: of each field the latest value that isn't null, of lists all values in order of time."""
    order = F.struct(F.col(seen), F.xxhash64(*[c for c in new.columns if c != key]))
    lists = {"sources", "source_urls"}

    def one(name: str) -> Column:
        if name in lists:
            every = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.coalesce(name, F.array().cast(new.schema[name].dataType)).alias("v"))))
            return F.array_distinct(F.flatten(F.transform(every, lambda x: x["v"]))).alias(name)
        if name == "salary_min":  # the pair is one value
            return F.max_by(F.struct("salary_min", "salary_max", "salary_provenance"), F.when(F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull(), order)).alias("_pay")
        return F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias(name)

    every = [one(c) for c in new.columns if c not in (key, "salary_max", "salary_provenance")]
    out = new.groupBy(key).agg(*every)
    return out.select("*", "_pay.*").drop("_pay") if "salary_min" in new.columns else out


def matched(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows under the key of the old row they belong to: by key, else by company and its own id."""
    keys = old.select("dedup_key").withColumn("_known", F.lit(True))
    own = old.where(F.col("source_id").isNotNull() & F.col("company_id").isNotNull()).groupBy("company_id", "source_id").agg(F.min("dedup_key").alias("_other"))
    both = new.join(keys, "dedup_key", "left").join(own, ["company_id", "source_id"], "left")
    key = F.when(F.col("_known"), F.col("dedup_key")).otherwise(F.coalesce("_other", "dedup_key"))
    return both.withColumn("dedup_key", key).drop("_known", "_other")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The snapshot with the new postings merged in, and kind (inserted, updated, touched, unchanged) and reopened.

    Both have dedup_key and FIELDS. Title, company, first_seen and source_id of a known posting never
    change; a null company_id or country is filled; a date gives way to one of higher precision only;
    an archived posting that is seen again is discovered anew. A row of the snapshot without a new
    one is unchanged.
    """
    fresh = folded(matched(old, new))
    both = old.select("dedup_key", F.struct(*FIELDS).alias("o")).join(fresh.select("dedup_key", F.struct(*FIELDS).alias("n")), "dedup_key", "full_outer")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    is_new, seen = F.col("o").isNull(), F.col("n").isNotNull()
    union = lambda c: F.array_distinct(F.concat(F.coalesce(o(c), F.array().cast("array<string>")), F.coalesce(n(c), F.array().cast("array<string>"))))
    either = lambda c, merged: F.when(o(c).isNotNull() | n(c).isNotNull(), merged)
    precision = lambda x: F.coalesce(rank(PRECISION_RANK, x("posted_precision")), F.lit(0)) + F.when(x("posted_date").isNotNull() & x("posted_precision").isNull(), PRECISION_RANK["proxy"]).otherwise(0)
    pair = lambda x: F.struct(x("salary_min").cast("double").alias("salary_min"), x("salary_max").cast("double").alias("salary_max"))
    pay = S.reconciled(S.ordered(pair(n)["salary_min"], pair(n)["salary_max"]), pair(o), rank(PROVENANCE_RANK, n("salary_provenance")), rank(PROVENANCE_RANK, o("salary_provenance")))
    newer = is_new | (seen & n("posted_date").isNotNull() & (precision(n) > precision(o)))
    archived = seen & (o("status") == "archived")
    first = F.coalesce(o("first_seen"), n("first_seen"), n("posted_date"), n("last_seen"))
    dated = F.when(newer, n("posted_date")).otherwise(o("posted_date"))
    marker = F.when(newer, F.when(n("posted_date").isNotNull(), F.coalesce(n("posted_precision"), F.lit("proxy")))).otherwise(o("posted_precision"))
    body = F.coalesce(F.nullif(F.trim(o("body")), F.lit("")), F.when(~F.coalesce(is_junk_body(n("body")), F.lit(True)), n("body")), o("body"))
    values = {
        "company_id": F.coalesce(n("company_id"), o("company_id")), "source_id": F.when(is_new, n("source_id")).otherwise(o("source_id")), "title": F.when(is_new, n("title")).otherwise(o("title")),
        "company": F.when(is_new, n("company")).otherwise(o("company")), "sources": union("sources"), "source_urls": union("source_urls"), "locations_raw": either("locations_raw", merged_places(o("locations_raw"), n("locations_raw"))),
        "locations": either("locations", L.merged(o("locations"), n("locations"))), "description": F.nullif(merged_text(o("description"), n("description")), F.lit("")), "body": body,
        "salary_min": pay["salary_min"], "salary_max": pay["salary_max"],
        "salary_provenance": F.when(pay.eqNullSafe(pair(o)) & ~is_new, o("salary_provenance")).otherwise(F.coalesce(n("salary_provenance"), o("salary_provenance"))),
        "posted_date": dated, "posted_precision": marker,
        "workplace_type": F.coalesce(F.nullif(n("workplace_type"), F.lit("UNSPECIFIED")), o("workplace_type"), F.lit("UNSPECIFIED")), "country_code": F.coalesce(n("country_code"), o("country_code")),
        "first_seen": first, "last_seen": F.greatest(o("last_seen"), n("last_seen")), "status": F.when(is_new | archived, F.lit("discovered")).otherwise(o("status")),
        "is_stale": F.when(is_new | archived, F.lit(False)).otherwise(o("is_stale")), "expired_at": F.when(~archived, o("expired_at")),
    }
    out = both.select("dedup_key", "o", "n", *(v.cast(old.schema[c].dataType).alias(c) for c, v in values.items()))
    changed = ~(F.struct(*CANONICAL).eqNullSafe(F.struct(*(o(c).alias(c) for c in CANONICAL))))
    grew = (F.size("sources") > F.size(o("sources"))) | (F.size("source_urls") > F.size(o("source_urls")))
    kind = F.when(is_new, "inserted").when(~seen, "unchanged").when(changed, "updated").when(F.coalesce(grew, F.lit(False)), "touched").otherwise("unchanged")
    return out.withColumn("kind", kind).withColumn("reopened", F.coalesce(archived, F.lit(False))).drop("o", "n")


def merged_observations(old: Column, new: Column, keep: int = 20) -> Column:
    """Both logs in order, each observation once, the last `keep` of them."""
    once = F.array_distinct(F.concat(F.coalesce(old, F.slice(new, 1, 0)), F.coalesce(new, F.slice(old, 1, 0))))
    return F.when(F.size(once) > keep, F.slice(once, -keep, keep)).otherwise(once)


def guarded_side(value: Column, other: Column, ratio: int = 10) -> Column:
    """A salary bound that is written alone: null where it contradicts the stored other bound by more than the ratio."""
    far = (F.greatest(value, other) > F.least(value, other) * ratio) & value.isNotNull() & other.isNotNull()
    return F.when(~F.coalesce(far, F.lit(False)), value)


def unscored(rows: DataFrame, when: Column, scores: tuple[str, ...]) -> DataFrame:
    """Scores go where the condition holds."""
    return rows.withColumns({c: F.when(~F.coalesce(when, F.lit(False)), F.col(c)) for c in scores})


def with_bodies(rows: DataFrame, bodies: DataFrame, key: str, scores: tuple[str, ...], body: str = "body") -> DataFrame:
    """Rows with new bodies that pass the gate; a body that changes takes the scores with it."""
    new = bodies.select(key, F.col(body).alias("_new")).where(~F.coalesce(is_junk_body(F.col("_new")), F.lit(True))).groupBy(key).agg(F.max_by("_new", F.struct(F.length("_new"), "_new")).alias("_new"))
    both = rows.join(new, key, "left")
    changed = F.col("_new").isNotNull() & ~F.col(body).eqNullSafe(F.col("_new"))
    return unscored(both.withColumn("_changed", changed), F.col("_changed"), scores).withColumn(body, F.coalesce("_new", body)).drop("_new", "_changed")


def without_bodies(rows: DataFrame, when: Column, scores: tuple[str, ...], body: str = "body") -> DataFrame:
    """Bodies that the condition takes back, and the scores with them."""
    return unscored(rows, when, scores).withColumn(body, F.when(~F.coalesce(when, F.lit(False)), F.col(body)))


def stamped_attempts(rows: DataFrame, tried: DataFrame, key: str, at: Column) -> DataFrame:
    """attempts and checked_at of the rows tried, one more each time they were."""
    n = tried.groupBy(key).agg(F.count("*").alias("_n"))
    both = rows.join(n, key, "left")
    return both.withColumns({"attempts": F.coalesce("attempts", F.lit(0)) + F.coalesce("_n", F.lit(0)), "checked_at": F.when(F.col("_n").isNotNull(), at).otherwise(F.col("checked_at"))}).drop("_n")


def may_try(attempts: Column, checked_at: Column, as_of: Column, most: int = 3, days: int = 30) -> Column:
    """Fewer than `most` attempts, or the last so many days ago."""
    return (F.coalesce(attempts, F.lit(0)) < most) | F.coalesce(checked_at < as_of - F.make_dt_interval(F.lit(days)), F.lit(False))


def with_source_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """source_id of rows without one, where no other row of the company has it and one row alone asks for it."""
    taken = rows.where(F.col("source_id").isNotNull()).select("company_id", F.col("source_id").alias("_id")).distinct()
    asked = rows.where(F.col("source_id").isNull()).select("dedup_key", "company_id").join(ids.select("dedup_key", F.col("source_id").alias("_id")), "dedup_key").join(taken, ["company_id", "_id"], "left_anti")
    alone = asked.groupBy("company_id", "_id").agg(F.min("dedup_key").alias("dedup_key"))
    return rows.join(alone.select("dedup_key", "_id"), "dedup_key", "left").withColumn("source_id", F.coalesce("source_id", "_id")).drop("_id")


def without_denied(jobs: DataFrame, companies: DataFrame, denied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs whose denied company is null, and the companies that stay. denied: company_id."""
    out = denied.select("company_id").distinct().withColumn("_denied", F.lit(True))
    kept = jobs.join(out, "company_id", "left").withColumn("company_id", F.when(F.col("_denied").isNull(), F.col("company_id"))).drop("_denied")
    return kept, companies.join(out.select("company_id"), "company_id", "left_anti")
