"""Stateful behaviours as Structured Streaming: exactly-once intake, break streaks, rollups, sessions.

Every function takes and returns a DataFrame and works on a stream or a batch alike, except where
it says so. Times are TIMESTAMP: cast NTZ columns first.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def source(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, with ts as a time with zone."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def exactly_once(rows: DataFrame, key: str, ts: str = "ts", ttl: str = "14 days") -> DataFrame:
    """The first row of each key; a key is forgotten when the watermark is past its time to live."""
    if rows.isStreaming:
        return rows.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])
    every = F.struct(*(f"`{c}`" for c in rows.columns))
    return rows.groupBy(key).agg(F.min_by(every, F.struct(F.col(ts), F.xxhash64(every))).alias("first")).select("first.*")


def daily(rows: DataFrame, *keys: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Count and sum of value per day and keys."""
    kept = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return kept.groupBy(F.window(ts, "1 day"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), *keys, "n", "total")


def sliding(rows: DataFrame, *keys: str, ts: str = "ts", size: str = "24 hours", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    kept = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return kept.groupBy(F.window(ts, size, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(rows: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    kept = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return kept.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n")


class BreakCounter(StatefulProcessor):
    """Counts broken runs of a source; tells once per streak when the threshold is reached."""

    def __init__(self, threshold: int = 3) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "count int, fired boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        count, fired = self.state.get() if self.state.exists() else (0, False)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():  # a key's rows of one trigger may come in several chunks
            count, fired = (count + 1, fired) if r.broken else (0, False) if r.good else (count, fired)
            if count >= self.threshold and not fired:
                fired = True
                out.append((key[0], r.ts, count))
        self.state.update((int(count), bool(fired)))
        yield pd.DataFrame(out, columns=["source", "ts", "streak"]).astype({"streak": "int32"})


def break_alerts(rows: DataFrame, key: str, broken: Column, good: Column, threshold: int = 3) -> DataFrame:
    """source, ts and streak whenever a source reaches the threshold anew. A stream only; order holds within a trigger."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the runner on the driver doesn't see files added to the session
    marked = rows.select(F.col(key).alias("source"), "event_id", "ts", broken.alias("broken"), good.alias("good"))
    return marked.groupBy("source").transformWithStateInPandas(
        statefulProcessor=BreakCounter(threshold), outputStructType="source string, ts timestamp, streak int", outputMode="Append", timeMode="None"
    )


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; where that is unset, in a temporary one of a local session."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="hirelake-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, name: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Everything there is, as Parquet files in the shared folder, with the checkpoint beside them. State is kept in RocksDB, as custom state asks for.

    append: by the file sink. update: each micro-batch's rows under its number, which a repeated
    batch overwrites; of rows with equal keys the newest batch counts.
    """
    spark = stream.sparkSession
    folder, before = shared_folder(spark, name), spark.conf.get(_PROVIDER)
    out = f"{folder}/rows"
    spark.conf.set(_PROVIDER, ROCKSDB)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    try:
        writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
        query = (writer.format("parquet").start(out) if mode == "append" else writer.foreachBatch(keep).start())
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    kind = stream.schema
    if mode == "append":
        return spark.read.schema(kind).parquet(out)
    rows = spark.read.schema(T.StructType([*kind.fields, T.StructField("batch", T.LongType())])).parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kind.names), "batch").alias("last")).select("last.*")


def into_snapshot(stream: DataFrame, apply: object, checkpoint: str) -> object:
    """Each micro-batch handed to `apply(batch, id)` once; the id lets a repeated batch be told."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
