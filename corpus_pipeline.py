"""From raw documents to packed training sequences: five stages, each applied to all that the one before kept.

toxicity drops texts that score as toxic; near_duplicates keeps one document of each group;
decontamination drops documents that hold a window of a benchmark item; secrets masks what looks
like a secret in the texts that stay; packing cuts the texts into token sequences.

Every stage but the last returns the columns of documents. An empty table stays empty, null texts
are empty texts, and other columns pass through. SQL can't express the stages (a trained model, a
random field, packing), so ORACLE_SQL is None and the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hirelake.llm import decontaminate, ngram_join, packing, secrets, toxicity
from hirelake.llm.shared import small_batches, written

#: Takes the place of each secret.
MARK = "<secret>"

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    masked = secrets.masked(docs, secrets.train(docs), MARK)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(packing.pieces(docs, with_ids=False), groups=packing.groups_for(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
