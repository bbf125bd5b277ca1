"""Importance resampling toward a target: documents that look like the benchmark's texts are drawn, by weights and noise.

Features of a text are its words and pairs of neighbouring words, hashed to buckets by CRC-32. Two
histograms, of all documents and of all target texts, give each bucket a gain (a scaled log ratio);
a document's weight is the floored mean of its features' gains, looked up in an array. Its score
adds Gumbel noise from a hash of its id, so the highest scores are a sample without replacement.

How it runs. Two passes over the texts: one for the histogram (a task sends one row a bucket that
it has seen), one for the weights; both hash all words of a slice at once, byte position by byte
position, since a CRC runs on from a word over the space into the next. Only the bucket table
(its size is a parameter) reaches the driver. Scores are whole numbers in a range that the logs
of 64-bit counts bound (under 200,000 values whatever the corpus), so ranks need no global sort:
a histogram of the scores, summed from the top, gives each score the rank that it begins at and
shows the last one drawn; rows below it are never sorted, and row_number by id runs within each
score that survives. Noise spreads equal weights over thousands of scores; rows that repeat an id
share a score, so they are numbered in the parts they were scored in, and moved on by the counts
of the parts before.

Defined results: a null text has no words; no features weigh 0. Documents with fewer words than
`least_words` get weight and score but no rank. A null id has the noise of an empty one and comes
before other ids of its score. Rows that repeat an id each get a rank, in no fixed order. An empty
table gives no rows; with an empty target all T and t are 0. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hirelake.llm import text as tx
from hirelake.llm.shared import fresh, written

BUCKETS = 10_000
SCALE = 1000
#: A document needs as many words to be drawn.
LEAST_WORDS = 20
PERCENT = 25
SEED = 7

#: Longer words are hashed one by one.
_LONG = 48
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, np.uint32(0xEDB88320) ^ (_TABLE >> 1), _TABLE >> 1).astype(np.uint32)


def _run_on(raw: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Each CRC-32 carried on over the bytes from start to end."""
    size, state = end - start, ~crc
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")  # longest first, so each step takes a prefix
    at, left = start[order], np.minimum(size, _LONG + 1)[order]
    long = int(np.searchsorted(-left, -_LONG, side="left"))
    state, begun = state[order], crc[order[:long]]
    alive = np.searchsorted(-left, -np.arange(1, _LONG + 1), side="right")
    for k in range(int(left[long]) if long < len(left) else 0):
        n = int(alive[k])
        part = state[long:n]
        state[long:n] = _TABLE[(part ^ raw[at[long:n] + k]) & 0xFF] ^ (part >> np.uint32(8))
    out = np.empty(len(start), np.uint32)
    out[order] = ~state
    for j in range(long):
        i = order[j]
        out[i] = zlib.crc32(raw[start[i] : end[i]], int(begun[j]))
    return out


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of each word and pair of words of lower-cased texts, its row, and each row's number of words."""
    start, end, row = tx.words(raw, offsets, tx.ALNUM_WORDS)
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    if not len(start):
        return np.zeros(0, np.uint32), row, n_words
    one = _run_on(raw, start, end, np.zeros(len(start), np.uint32))
    first = np.flatnonzero(row[1:] == row[:-1])
    spaced = ~one[first]
    spaced = ~(_TABLE[(spaced ^ 0x20) & 0xFF] ^ (spaced >> np.uint32(8)))
    two = _run_on(raw, start[first + 1], end[first + 1], spaced)
    return np.concatenate([one, two]), np.concatenate([row, row[first]]), n_words


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = tx.buffers(texts)
    for a, b in tx.slices(offsets):
        at = offsets[a : b + 1]
        yield a, b, tx.LOWER[raw[at[0] : at[-1]]], at - at[0]


def histogram(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of the first column's texts fall into each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, offsets in _slices(batch.column(0)):
                total += np.bincount(features(raw, offsets)[0] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "n": total[at]})

    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, of two histograms."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    rows = source.select("bucket", "n", F.lit(0).alias("of")).union(target.select("bucket", "n", F.lit(1).alias("of")))
    for r in rows.collect():  # at most two rows a bucket
        (s, t)[r.of][r.bucket] = r.n
    s_all, t_all = float(s.sum()), float(t.sum())
    return np.floor(SCALE * np.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features and weight of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, number, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, b, raw, offsets in _slices(batch.column(1)):
                crc, row, n = features(raw, offsets)
                words[a:b], number[a:b] = n, np.bincount(row, minlength=b - a)
                # a float sum of whole numbers below 2**53 is exact
                total[a:b] = np.bincount(row, weights=gain[crc % np.uint32(len(gain))], minlength=b - a)
            columns = [batch.column(0), pa.array(words), pa.array(number), pa.array(total // np.maximum(number, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "n_features", "weight"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(key: str = "doc_id", seed: int = SEED) -> Column:
    """Scaled Gumbel noise of a hash of the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, key: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds the rank of each drawn row of a written table with key, n_words and score; null for the others."""
    part, above, n, before, turn = fresh(scored, "part", "above", "n", "before", "turn")
    own = scored.withColumn(part, F.spark_partition_id())
    may = F.col("n_words") >= least_words
    counts = written(own.where(may).groupBy("score").agg(F.count("*").alias(n)), "scores")  # bounded, see above
    draw = (counts.agg(F.sum(n)).first()[0] or 0) * percent // 100
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    survive = counts.select("score", F.coalesce(F.sum(n).over(higher), F.lit(0)).alias(above)).where(F.col(above) < draw)
    survive = written(survive, "surviving")
    cutoff = survive.agg(F.min("score")).first()[0]
    drawn = may & (F.col("score") >= (2**62 if cutoff is None else cutoff))
    group = written(own.where(drawn), "drawn")
    inside = Window.partitionBy("score", key, part).orderBy(F.lit(0))
    runs = group.groupBy("score", key, part).agg(F.count("*").alias(n))
    by_key = Window.partitionBy("score").orderBy(F.col(key).asc_nulls_first(), part)
    runs = runs.withColumn(before, F.sum(n).over(by_key) - F.col(n)).drop(n)
    runs = runs.join(F.broadcast(survive), "score").select(F.col("score").alias("s"), F.col(key).alias("k"), F.col(part).alias("p"), (F.col(before) + F.col(above)).alias(before))
    numbered = group.withColumn(turn, F.row_number().over(inside))
    same = (F.col("score") == F.col("s")) & F.col(key).eqNullSafe(F.col("k")) & (F.col(part) == F.col("p"))
    rank = F.col(before) + F.col(turn)
    numbered = numbered.join(runs, same).withColumn("rank", F.when(rank <= draw, rank)).select(*scored.columns, "rank")
    rest = own.where(~drawn).select(*scored.columns, F.lit(None).cast("long").alias("rank"))
    return numbered.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """key, n_words, n_features, weight, score and rank (null: not drawn) of each row."""
    gain = gains(histogram(docs.select(text), buckets), histogram(target.select(target_text), buckets), buckets)
    scored = weighed(docs, gain, key, text).withColumn("score", F.col("weight") + noise(key, seed))
    return ranked(written(scored, "scored"), key, least_words, percent)
