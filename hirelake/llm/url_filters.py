"""URL filters: host-suffix and path-prefix expressions against a rule list, by hashed equi-joins.

DataFrame operations only. Each URL is expanded into every host suffix at a label border times
every path prefix whose length occurs among the rules' paths, so no depth is capped. The short
hash prefix finds candidate rules, the full digest confirms them, and the longest rule wins.

Defined cases: a null URL, or one without "://", has an empty host and path and fits no rule.
Repeated rows each get their own result row. Ties of equal length: the rule with the longer host,
then a block. Rules with a null host are dropped, a null path counts as empty. Other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Letters of the digest that make up the join key (four bytes).
SHORT = 8
#: Rules up to this number are broadcast; a longer list is joined by shuffle with salted copies.
BROADCAST_RULES = 100_000
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.translate(F.regexp_replace(after, r"(?s)[/?#].*$", ""), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.regexp_replace(F.regexp_replace(after, r"(?s)^[^/?#]*", ""), r"(?s)[?#].*$", ""), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]; of an empty host, none."""
    labels = F.split(host, r"\.")
    every = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


def rule_table(rules: DataFrame) -> DataFrame:
    """host, path, verdict -> one row per rule text with its digest; of one text, a block goes before an allow."""
    return (
        rules.where(F.col("host").isNotNull())
        .select(
            F.translate("host", _UPPER, _LOWER).alias("rule_host"),
            F.coalesce("path", F.lit("")).alias("rule_path"),
            F.col("verdict").alias("rule_verdict"),
        )
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))  # block > allow
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("digest", F.sha2(F.concat_ws("\u0000", "rule_host", "rule_path"), 256))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )


def judge(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """key, host, path, rule (host + path of the rule that won, or null) and verdict of each row."""
    table = rule_table(rules)
    facts = table.agg(F.count("*").alias("n"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    lengths = sorted(facts["lengths"])
    urls = (
        pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
        .groupBy("key", "host", "path")
        .agg(F.count("*").alias("copies"))
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substr(F.col("path"), F.lit(1), n),
    )
    expressions = urls.withColumn("suffix", F.explode_outer(host_suffixes(F.col("host")))).withColumn(
        "prefix", F.explode_outer(prefixes)
    )
    expressions = expressions.withColumn(
        "full", F.sha2(F.concat_ws("\u0000", F.col("suffix"), F.col("prefix")), 256)
    ).withColumn("cut", F.substring("full", 1, SHORT))
    on = (F.col("cut") == F.col("short")) & F.col("suffix").isNotNull() & F.col("prefix").isNotNull()
    confirmed = F.col("full") == F.col("digest")  # short digests only say who may fit
    if facts["n"] <= broadcast_rules:
        table = F.broadcast(table)
    else:
        table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        expressions = expressions.withColumn("dealt", F.pmod(F.xxhash64("key", "path"), F.lit(SALTS)).cast("int"))
        on &= F.col("dealt") == F.col("salt")
    rank = F.struct(
        F.length("rule").alias("n"), F.length("rule_host").alias("h"), F.col("rule_verdict").alias("v"), F.col("rule")
    )
    best = (
        expressions.join(table, on, "left")
        .groupBy("key", "host", "path")
        .agg(F.first("copies").alias("copies"), F.max(F.when(confirmed, rank)).alias("best"))
    )
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.v", F.lit(default)).alias("verdict"),
    )
