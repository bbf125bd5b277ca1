"""Quality rules by cross-document line frequency, with the usual repetition counts of each text.

DataFrame operations only. Lines are normalised (small letters, digits as 0, white space trimmed
and merged), hashed, and counted over the distinct texts of each host; lines found in more than
`max_texts` texts of one host are removed, and a document that loses more than `max_removed` of
its words is rejected. Exact copies of one text count once, so being copied rejects nobody.

Defined cases: a null text has no words or lines; it and texts under `min_words` fail the base
rules. A null host is a host of its own. Repeated rows each get their own result row. Equal
hashes of different lines or windows (64 bits) count as equal. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: White space by contract.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window that must not repeat within a text.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line in more than this many distinct texts of one host is boilerplate there.
MAX_TEXTS = 100
#: A document that loses more than this part of its words is depleted.
MAX_REMOVED = 0.5

_SPACES = r"[\x20\x09-\x0D]+"


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def with_repeated_words(rows: DataFrame, hashes: str, size: int = WINDOW) -> DataFrame:
    """Adds n_repeat_words: the words in windows that occur more than once, from each window's hash.

    Each step is a column of its own: an expression inside a lambda is computed for every element.
    """

    def shared(x: Column, i: Column) -> Column:
        before, after = F.get("_placed", i - 1), F.get("_placed", i + 1)
        return F.coalesce(x["h"] == before["h"], F.lit(False)) | F.coalesce(x["h"] == after["h"], F.lit(False))

    unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return (
        rows.withColumn("_placed", F.when(~unique, placed))
        .withColumn("_at", F.sort_array(F.transform(F.filter("_placed", shared), lambda x: x["p"])))
        .withColumn("_gaps", F.transform("_at", lambda p, i: F.least(F.lit(size), F.coalesce(F.get("_at", i + 1) - p, F.lit(size)))))
        .withColumn(
            "n_repeat_words", F.coalesce(F.aggregate("_gaps", F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
        )
        .drop("_placed", "_at", "_gaps")
    )


def line_table(text: Column) -> Column:
    """struct(h, n) of each line with a word: the hash of its normal form, and its words."""
    plain = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, _SPACES, " ")))
    return F.transform(
        F.filter(plain, lambda x: x != ""),
        lambda x: F.struct(
            F.xxhash64(F.regexp_replace(F.lower(x), "[0-9]", "0")).alias("h"),
            (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"),
        ),
    )


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    hashes = F.transform(
        F.sequence(F.lit(1), F.col("n_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))
    )
    rows = (
        documents.withColumn("_words", word_list(t))
        .withColumn("n_words", F.size("_words"))
        .withColumn("_hashes", F.when(F.col("n_words") > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_lines", lines)
        .withColumn("word_chars", F.length(F.translate(t, SPACE, "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_words", F.col("n_words").cast("long"))
        .drop("_words", "_lines")
    )
    return with_repeated_words(rows, "_hashes").drop("_hashes")


def removed_lines(
    documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_texts: int = MAX_TEXTS
) -> DataFrame:
    """_id, _host, _text_hash -> words removed, for each distinct row that loses a line."""
    rows = documents.select(
        F.col(key).alias("_id"),
        F.col(host).alias("_host"),
        F.xxhash64(text).alias("_text_hash"),
        line_table(F.col(text)).alias("_lines"),
    )
    seen = rows.select("_host", "_text_hash", F.explode(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("h"))
    frequent = (
        seen.groupBy("_host", "h", "_text_hash")
        .agg(F.lit(1).alias("one"))
        .groupBy("_host", "h")
        .agg(F.count("*").alias("n_texts"))
        .where(F.col("n_texts") > max_texts)
    )
    lines = rows.select("_id", "_host", "_text_hash", F.posexplode("_lines").alias("pos", "line")).select(
        "_id", "_host", "_text_hash", "pos", F.col("line.h").alias("h"), F.col("line.n").alias("n")
    )
    hits = lines.alias("l").join(
        frequent.alias("f"), F.col("l._host").eqNullSafe(F.col("f._host")) & (F.col("l.h") == F.col("f.h"))
    )
    return (
        hits.groupBy("l._id", "l._host", "l._text_hash", "l.pos")
        .agg(F.max("l.n").alias("n"))
        .groupBy("_id", "_host", "_text_hash")
        .agg(F.sum("n").alias("n_removed_words"))
    )


def judge(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_texts: int = MAX_TEXTS,
    max_removed: float = MAX_REMOVED,
) -> DataFrame:
    """key, the counts, base_failed, n_removed_words and kept of each row."""
    own = documents.select(
        F.col(key).alias(key), F.col(host).alias("_host"), F.xxhash64(text).alias("_text_hash"), F.col(text).alias("_text")
    )
    base = measured(own, "_text").drop("_text")
    lost = removed_lines(documents, key, text, host, max_texts)
    both = base.alias("b").join(
        lost.alias("r"),
        F.col(f"b.{key}").eqNullSafe(F.col("r._id"))
        & F.col("b._host").eqNullSafe(F.col("r._host"))
        & (F.col("b._text_hash") == F.col("r._text_hash")),
        "left",
    )
    removed = F.coalesce("n_removed_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return both.select(
        f"b.{key}",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        removed.alias("n_removed_words"),
        (~failed & (removed <= max_removed * F.col("n_words"))).alias("kept"),
    )
