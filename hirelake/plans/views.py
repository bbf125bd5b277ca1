"""The posting domain laid over the star-schema tables, in Spark and as SQL common table expressions.

Each view of VIEWS is SQL that Spark and DuckDB read alike except for the functions it names, so the
Spark side is written apart, with the DataFrame API. `as_of` is the newest time of the table, never
the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CLASS_OF = {"1-URGENT": "apply", "2-HIGH": "consider", "3-MEDIUM": "skip", "4-NOT SPECIFIED": "reject", "5-LOW": "low_signal"}
STAGE_OF = {"view": "discovered", "click": "reviewing", "signup": "applied", "purchase": "offer", "error": "rejected"}
DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(key: str | Column, names: dict[str, str], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for name, value in names.items():
        out = F.when((F.col(key) if isinstance(key, str) else key) == name, value).otherwise(out)
    return out


def newest(df: DataFrame, column: str) -> Column:
    """The newest time of a table, as a literal."""
    return F.lit(df.agg(F.max(column)).first()[0])


def days_between(later: Column, earlier: Column) -> Column:
    """Days with their fraction."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(DAY)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("dedup_key"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("first_seen"),
        F.col("o_totalprice").alias("salary"),
        mapped("o_orderstatus", {"O": "discovered", "P": "reviewing", "F": "applied"}).alias("status"),
        mapped("o_orderpriority", CLASS_OF).alias("classification"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("platform"),
        F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation_id"),
    )


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.expr("event_id div 2").alias("job_id"), "ts", mapped("event_type", STAGE_OF).alias("to_status"), "value", "user_id", "event_type", "props"
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("purpose"),
        F.col("l_linestatus").alias("provider"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("tokens"),
        (F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))).cast("decimal(18,4)").alias("cost"),
    )


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sub-scores from 1 to 5 by arithmetic on the key, of the jobs."""
    return jobs(spark, sf_dir).select("*", *[((F.col("dedup_key") * k + F.expr(f"dedup_key div {k}")) % 5 + 1).cast("int").alias(f"s{i}") for i, k in enumerate((1, 2, 3, 5, 7, 11))])


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "conv_id", "turn", "role", F.col("text").alias("body"))


AXES = [f"s{i}" for i in range(6)]


def _case(key: str, names: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + " END"


VIEWS = {
    "v_jobs": f"""SELECT o_orderkey AS dedup_key, o_custkey AS company_id, o_orderdate AS first_seen, o_totalprice AS salary,
        {_case("o_orderstatus", {"O": "discovered", "P": "reviewing", "F": "applied"})} AS status,
        {_case("o_orderpriority", CLASS_OF)} AS classification FROM orders""",
    "v_companies": "SELECT c_custkey AS company_id, c_name AS company, c_mktsegment AS platform, c_acctbal AS balance, c_nationkey AS nation_id FROM customer",
    "v_events": f"""SELECT event_id, event_id // 2 AS job_id, ts, {_case("event_type", STAGE_OF)} AS to_status, value, user_id, event_type, props FROM events""",
    "v_ledger": """SELECT l_orderkey AS job_id, l_linenumber AS line, l_returnflag AS purpose, l_linestatus AS provider, l_shipdate AS ts, l_quantity AS tokens,
        (l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DECIMAL(18,4) AS cost FROM lineitem""",
    "v_axes": "SELECT *, " + ", ".join(f"((dedup_key * {k} + dedup_key // {k}) % 5 + 1)::INTEGER AS s{i}" for i, k in enumerate((1, 2, 3, 5, 7, 11))) + " FROM v_jobs",
    "v_mail": "SELECT conv_id * 1000 + turn AS message_id, conv_id, turn, role, text AS body FROM conversations",
}


def sql(body: str) -> str:
    """SQL with the views it names put before it."""
    needed = [name for name in VIEWS if name in body or (name == "v_jobs" and "v_axes" in body)]
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    text = body.strip()
    if not views:
        return text
    return f"WITH {views}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {views}\n{text}"


Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with its SQL where there is some."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            if query.__name__ in self.queries:
                raise ValueError(f"two queries of the name {query.__name__}")
            self.queries[query.__name__] = query
            if oracle is not None:
                self.oracle[query.__name__] = sql(oracle)
            return query

        return keep


def whole(*parts: dict) -> dict:
    """All entries of the parts; a name that two of them have raises."""
    out: dict = {}
    for part in parts:
        if clash := out.keys() & part.keys():
            raise ValueError(f"names that are used twice: {sorted(clash)}")
        out |= part
    return out
