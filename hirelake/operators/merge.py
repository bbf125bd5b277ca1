"""Merging of postings: upserts into a snapshot, retroactive merges, clusters of companies, reconciliation.

Snapshots are never changed in place: each operator returns the new rows. Folds run in an explicit
order, so the result doesn't depend on how rows were dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hirelake.functions.vocab import MERGE_STATUS_RANK, rank


def upsert(old: DataFrame, new: DataFrame, key: str, value: str, seen: str) -> DataFrame:
    """One row per key: the value (a new one that isn't null wins), first and last seen, and kind.

    kind: inserted, updated (the value changed), touched (only seen again) or unchanged. Several new
    rows of a key are folded first: the latest value that isn't null.
    """
    order = F.struct(F.col(seen), F.col(value))
    fresh = new.groupBy(key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), order)).alias("n_value"), F.min(seen).alias("n_first"), F.max(seen).alias("n_last"))
    base = old.select(F.col(key), F.col(value).alias("o_value"), F.col(seen).alias("o_seen"))
    both = base.join(fresh, key, "full_outer")
    kind = (
        F.when(F.col("o_seen").isNull(), "inserted").when(F.col("n_last").isNull(), "unchanged")
        .when(F.col("n_value").isNotNull() & ~F.col("n_value").eqNullSafe(F.col("o_value")), "updated").otherwise("touched")
    )
    return both.select(
        key, F.coalesce("n_value", "o_value").alias(value), F.coalesce("o_seen", "n_first").alias("first_seen"),
        F.greatest("o_seen", "n_last").alias("last_seen"), kind.alias("kind"),
    )


def canonical(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """rows with canonical (bool): the first of each key in the order."""
    return rows.withColumn("canonical", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def retroactive(rows: DataFrame, key: list[str], ident: str, seen: str, low: str, status: str) -> DataFrame:
    """One row per key: the id seen first, how many went into it, the first value that isn't null, and the status that ranks highest (at least discovered)."""
    at = F.struct(F.col(seen), F.col(ident))
    best = F.max_by(status, F.struct(rank(MERGE_STATUS_RANK, F.col(status)), F.col(status)))
    top = F.max(rank(MERGE_STATUS_RANK, F.col(status)))
    return rows.groupBy(*key).agg(
        F.min_by(ident, at).alias("canonical_id"),
        (F.count("*") - 1).alias("duplicates"),
        F.min_by(low, F.when(F.col(low).isNotNull(), at)).alias("value"),
        F.when(top >= 2, best).otherwise("discovered").alias("status"),
        F.max(seen).alias("last_seen"),
    )


def lineage(rows: DataFrame, key: list[str], ident: str, seen: str) -> DataFrame:
    """One row per duplicate: its id and the canonical one. The key's first row is found by aggregation, then joined."""
    first = rows.groupBy(*key).agg(F.min_by(ident, F.struct(F.col(seen), F.col(ident))).alias("canonical_id"))
    return rows.join(first, key).where(F.col(ident) != F.col("canonical_id")).select(F.col(ident).alias("duplicate_id"), "canonical_id")


def cluster_winners(rows: DataFrame, key: str, ident: str, *scores: Column) -> DataFrame:
    """The winner of each cluster: largest scores in order, then the least id."""
    return rows.groupBy(key).agg(F.max_by(ident, F.struct(*scores, -F.col(ident))).alias("winner"), F.count("*").alias("members"))


def reconciled(tracked: DataFrame, live: DataFrame, key: str, complete: Column) -> DataFrame:
    """verdict of each tracked row: live, expired, or unknown where its board wasn't read completely."""
    seen = live.select(key).distinct().withColumn("_live", F.lit(True))
    return tracked.join(seen, key, "left").withColumn(
        "verdict", F.when(F.col("_live"), "live").when(complete, "expired").otherwise("unknown")
    ).drop("_live")


def merged_places(old: Column, new: Column) -> Column:
    """Union without regard to case, in order; a new Remote or Hybrid goes to the front, the last one first."""

    def add(have: Column, x: Column) -> Column:
        known = F.exists(have, lambda h: F.lower(h) == F.lower(x))
        front = F.lower(x).isin("remote", "hybrid")
        return F.when(known, have).when(front, F.concat(F.array(x), have)).otherwise(F.concat(have, F.array(x)))

    empty = F.array().cast("array<string>")
    return F.aggregate(F.coalesce(new, empty), F.coalesce(old, empty), add)


def merged_text(old: Column, new: Column) -> Column:
    """The longer one where one holds the other, else both with a line between."""
    a, b = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    return F.when(b == "", a).when(a == "", b).when(F.contains(a, b), a).when(F.contains(b, a), b).otherwise(F.concat(a, F.lit("\n\n---\n\n"), b))


def direct_duplicates(rows: DataFrame, key: list[str], ident: str) -> DataFrame:
    """Groups of several ids, with the ids in order. A group is as large as its copies; ids only."""
    ids = F.array_sort(F.collect_set(ident))
    return rows.groupBy(*key).agg(F.count("*").alias("n"), ids.alias("ids")).where(F.col("n") > 1)
