"""Token counts by a separator scan over flat token files.

A flat file is nothing but little-endian token ids, documents ended by one id, with no index. It
is read as fixed-size blocks (file, block, bytes) that cut documents anywhere: `file_blocks` cuts
files, `token_blocks` makes blocks from texts. Each block is searched at once for the end id; a
prefix scan over one summary row per block (its size and last end) carries the last end before
it, which gives the first document of each block its start. The scan has two levels, runs of RUN
blocks and then one row per run, so one file, however large, is no single task.

The end id is 50256. The texts' own "<|endoftext|>" is ordinary text here, so no text ends early.

Defined cases: ids behind the last end of a file form a document without end (ended false). Two
ends in a row are a document of 0 tokens. An empty file has no documents. A null or empty text is
a document of 0 tokens. Blocks may be empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from hirelake.llm.packing import encoder
from hirelake.llm.shared import written

#: End-of-document id of the vocabulary, which ordinary text never gets.
END_ID = 50256
BLOCK_BYTES = 1 << 18
#: Blocks of a run in the scan.
RUN = 4096
TOKEN = np.dtype("<u2")

BLOCKS = "file int, block long, bytes binary"


def token_blocks(
    documents: DataFrame, text: str = "text", end_id: int = END_ID, block_bytes: int = BLOCK_BYTES, ranks_path: str | None = None
) -> DataFrame:
    """The texts' ids as flat files, one for each input partition, in blocks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, block, rest = encoder(ranks_path, added=False), TaskContext.get().partitionId(), 0, b""

        def row(data: bytes, k: int) -> pa.RecordBatch:
            columns = [pa.array([file], pa.int32()), pa.array([k], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "bytes"])

        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                ids = encode(t).astype(TOKEN) if t else np.zeros(0, TOKEN)
                rest += ids.tobytes() + np.array([end_id], TOKEN).tobytes()
                while len(rest) >= block_bytes:
                    yield row(rest[:block_bytes], block)
                    rest, block = rest[block_bytes:], block + 1
        if rest:
            yield row(rest, block)

    return documents.select(text).mapInArrow(write, BLOCKS)


def _scan(end_id: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, sizes = [], []
            for data in batch.column("bytes"):
                ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", dtype=TOKEN)
                ends.append(np.flatnonzero(ids == end_id).astype(np.int32))
                sizes.append(len(ids))
            columns = [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "size", "ends"])

    return scan


def file_blocks(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of the flat files in a folder, with their paths; one file is what a task holds."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select(F.col("path").alias("file"), "length", "content")
    last = F.floor((F.col("length") - 1) / block_bytes)
    cut = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return cut.select("file", "block", F.substring("content", (F.col("block") * block_bytes + 1).cast("int"), F.lit(block_bytes)).alias("bytes"))


def carried(found: DataFrame, run: int = RUN) -> DataFrame:
    """file and block with first (the file's ids before the block), carried (the start that its first end closes) and final (whether it is the last)."""
    inside = Window.partitionBy("file", "run").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = found.select("file", "block", "size", "last", F.floor(F.col("block") / run).alias("run"))
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("stop", F.col("at") + F.col("last") + 1)
    rows = rows.withColumn("own", F.max("stop").over(before))
    runs = rows.groupBy("file", "run").agg(F.sum("size").alias("size"), F.max("stop").alias("stop"), F.max("block").alias("end"))
    order = Window.partitionBy("file").orderBy("run")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    runs = runs.withColumn("from", F.coalesce(F.max(F.col("base") + F.col("stop")).over(earlier), F.lit(0)))
    runs = runs.withColumn("end", F.when(F.lead("run").over(order).isNull(), F.col("end"))).select("file", "run", "base", "from", "end")
    both = rows.join(runs, ["file", "run"])
    return both.select(
        "file", "block", (F.col("base") + F.col("at")).alias("first"), F.coalesce(F.col("base") + F.col("own"), F.col("from")).alias("carried"), F.coalesce(F.col("block") == F.col("end"), F.lit(False)).alias("final")
    )


def count(blocks: DataFrame, end_id: int = END_ID, run: int = RUN) -> DataFrame:
    """file, start, n_tokens and ended of each document in the blocks; start is its first id's place in the file."""
    kind = StructType([blocks.schema["file"], StructField("block", LongType()), StructField("size", LongType()), StructField("ends", ArrayType(IntegerType()))])
    found = blocks.select("file", F.col("block").cast("long").alias("block"), "bytes").mapInArrow(_scan(end_id), kind)
    found = written(found.withColumn("last", F.when(F.size("ends") > 0, F.element_at("ends", -1))), "ends")
    placed = found.join(carried(found, run), ["file", "block"])
    last = F.col("first") + F.col("last") + 1
    inside = F.transform(
        "ends",
        lambda e, i: F.struct(
            F.when(i == 0, F.col("carried")).otherwise(F.col("first") + F.get("ends", i - 1) + 1).alias("start"),
            (F.col("first") + e).alias("end"),
            F.lit(True).alias("ended"),
        ),
    )
    stop = F.col("first") + F.col("size")
    tail = F.struct(F.coalesce(last, F.col("carried")).alias("start"), stop.alias("end"), F.lit(False).alias("ended"))
    whole = F.when(F.col("final") & (F.coalesce(last, F.col("carried")) < stop), F.concat(inside, F.array(tail))).otherwise(inside)
    return placed.select("file", F.explode(whole).alias("d")).select(
        "file", F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.col("d.ended").alias("ended")
    )
