"""The intake contract: integrity codes of stored rows, and routing of raw ones into clean, quarantined and dropped.

Every rule is one column; reasons keep the rules' order. A null input never breaks a rule by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hirelake.functions import content
from hirelake.functions.vocab import PRECISION_RANK, WORKPLACE_TYPES

#: Currencies and periods a stored salary may have.
CURRENCIES = ("USD", "CAD", "EUR", "GBP", "AUD", "SGD", "INR", "unknown")
COLUMN_PERIODS = ("annual", "hourly", "monthly", "unknown")


def rules(columns: list[str], as_of: Column) -> dict[str, Column]:
    """Codes and what breaks them, for the rules whose columns are there."""
    c = F.col
    every = {
        "I-01": (("salary_min",), lambda: c("salary_min") <= 0),
        "I-02": (("salary_min", "salary_max"), lambda: c("salary_min") > c("salary_max")),
        "I-06": (("workplace_type",), lambda: ~c("workplace_type").isin(*WORKPLACE_TYPES)),
        "I-12": (("posted_date",), lambda: c("posted_date").cast("timestamp") > as_of.cast("timestamp") + F.expr("INTERVAL 1 DAY")),
        "I-13": (("body",), lambda: c("body").isNotNull() & content.is_junk_body(c("body"))),
        "I-14": (("posted_date", "precision"), lambda: (c("posted_date").isNull() != c("precision").isNull()) | ~F.coalesce(c("precision").isin(*PRECISION_RANK), F.lit(True))),
        "currency": (("currency",), lambda: ~c("currency").isin(*CURRENCIES)),
        "period": (("period",), lambda: ~c("period").isin(*COLUMN_PERIODS)),
    }
    return {code: test() for code, (needs, test) in every.items() if set(needs) <= set(columns)}


def violations(df: DataFrame, as_of: Column) -> DataFrame:
    """df with violations: the codes each row breaks, in order."""
    found = [F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules(df.columns, as_of).items()]
    return df.withColumn("violations", F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))


def routed(raw: DataFrame, denied: DataFrame | None = None, title: str = "title", body: str = "body", company: str = "company") -> DataFrame:
    """raw with route (clean, quarantined, dropped) and reasons; a body that fails its gate is emptied.

    Listing tiles and denied companies are dropped; `denied` is a table of company names, joined by
    equality.
    """
    t, b = F.col(title), F.col(body)
    blob = content.is_metadata_blob(t)
    junk = b.isNotNull() & content.is_junk_body(b)
    reject = content.body_reject(b, t)
    reasons = F.array_compact(
        F.array(
            F.when(blob, "title_metadata_blob"),
            F.when(~blob, content.title_reason(t)),
            F.when(junk, "jd_full_junk"),
            F.when(~junk, reject["reason"]),
        )
    )
    rows = raw
    if denied is not None:
        names = denied.select(F.lower(denied.columns[0]).alias("_denied")).distinct()
        rows = raw.join(names, F.lower(company) == F.col("_denied"), "left")
    gone = content.is_listing_tile(t) | (F.col("_denied").isNotNull() if denied is not None else F.lit(False))
    out = rows.withColumn("reasons", reasons).withColumn("route", F.when(gone, "dropped").when(F.size("reasons") > 0, "quarantined").otherwise("clean"))
    return out.withColumn(body, F.when(~(junk | reject.isNotNull()), b)).drop("_denied")


def funnel(rows: DataFrame, stage: str) -> DataFrame:
    """Counts of each stage, and what the stages leave unexplained against all: zero when every row has one."""
    return rows.groupBy(F.coalesce(stage, F.lit("unexplained")).alias("stage")).agg(F.count("*").alias("n"))
