"""Benchmark decontamination by a prefix-filtered set join on item-sized windows.

Every window of an item is a set of placed words that must be contained whole, so with words
ordered by rarity over the corpus its prefix is one word: the rarest. A document's words meet the
windows on that word; the offset of the word in the window bounds the position, the window's
length bounds the end; the words between are then compared one by one.

Defined cases: a null text has no words; an item without words has no window; a null item id
marks words as hit but isn't listed; repeated item ids count once; repeated documents each get
their own row. Word hashes have 64 bits. Other columns are ignored, or pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from hirelake.llm import text as tx
from hirelake.llm.shared import written

WINDOW = 10
#: Benchmark text that is broadcast at once, in bytes; a larger benchmark is joined in blocks.
BLOCK_BYTES = 16 << 20


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: first row, rows, the word hashes and where each row's words begin."""
    raw, offsets = tx.buffers(column)
    for first, last in tx.slices(offsets):
        part = tx.LOWER[raw[offsets[first] : offsets[last]]]
        start, end, row = tx.words(part, offsets[first : last + 1] - offsets[first], tx.ALNUM_WORDS)
        bounds = np.searchsorted(row, np.arange(last - first + 1))
        yield first, last - first, tx.word_hashes(part, start, end), bounds


def item_windows(ids: list, texts: list, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes of all items in turn, and of each window where it begins among them, its length and its item's place in ids."""
    flat, starts, lengths, items, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for first, n, hashes, bounds in words_of(pa.array(texts, pa.large_string())):
        own = np.diff(bounds)
        many = np.where(own > 0, np.maximum(own - size + 1, 1), 0)
        which = np.repeat(np.arange(n), many)
        flat.append(hashes)
        starts.append(at + bounds[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many))
        lengths.append(np.minimum(own[which], size))
        items.append(first + which)
        at += len(hashes)
    return np.concatenate(flat), np.concatenate(starts), np.concatenate(lengths), np.concatenate(items)


def word_counts(documents: DataFrame, text: str, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word hash of the sorted vocabulary occurs in all texts."""
    known = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), np.int64)
        for batch in batches:
            for _, _, hashes, _ in words_of(batch.column(0)):
                at = np.minimum(np.searchsorted(known.value, hashes), len(total) - 1)
                total += np.bincount(at[known.value[at] == hashes], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["word", "n"])

    rows = documents.select(text).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary), np.int64)
    for word, n in rows.collect():  # at most one row for each word of a block of the benchmark
        out[word] = n
    return out


class Index:
    """Windows by their rarest word. A window is a place among the items' words, so it takes some bytes, not ten hashes."""

    def __init__(self, windows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ids: list, vocabulary: np.ndarray, counts: np.ndarray, size: int = WINDOW) -> None:
        """windows: of item_windows; vocabulary: the words of the items, sorted; counts: how often each occurs in the texts."""
        self.flat, start, length, item = windows
        used = counts[np.searchsorted(vocabulary, self.flat)] if len(vocabulary) else np.zeros(0, np.int64)
        offset = np.zeros(len(start), np.int8)
        for k in range(0, len(start), 1 << 16):
            own = slice(k, k + (1 << 16))
            at = start[own, None] + np.arange(size)
            inside = np.arange(size) < length[own, None]
            offset[own] = np.where(inside, used[np.minimum(at, len(used) - 1)], np.iinfo(np.int64).max).argmin(axis=1)
        prefix = self.flat[start + offset]
        order = np.argsort(prefix, kind="stable")
        self.start, self.offset, self.length, self.item = start[order].astype(np.int32), offset[order], length[order].astype(np.int8), item[order].astype(np.int32)
        self.ids, self.size = ids, size
        self.prefix, self.first = np.unique(prefix[order], return_index=True)
        self.last = np.append(self.first[1:], len(start))

    def occurrences(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start word and window of every occurrence in the texts whose words begin at bounds."""
        if not len(self.prefix) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.prefix, hashes), len(self.prefix) - 1)
        place = np.flatnonzero(self.prefix[at] == hashes)
        first, many = self.first[at[place]], (self.last - self.first)[at[place]]
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(int(many.max(initial=0))):  # the k-th window of each word: bounded by the benchmark
            place, first, many = place[many > k], first[many > k], many[many > k]
            window = first + k
            start = place - self.offset[window]
            row = np.searchsorted(bounds, place, side="right") - 1
            fits = (start >= bounds[row]) & (start + self.length[window] <= bounds[row + 1])
            start, window = start[fits], window[fits]
            same = np.ones(len(start), bool)
            for i in range(self.size):
                inside = i < self.length[window]
                same &= ~inside | (hashes[np.minimum(start + i, len(hashes) - 1)] == self.flat[np.minimum(self.start[window] + i, len(self.flat) - 1)])
            starts.append(start[same])
            found.append(window[same])
        return np.concatenate(starts), np.concatenate(found)


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[list, list]:
    """The union of the spans, as spans that don't touch."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new].tolist(), ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)].tolist()


_KINDS = {"n_words": pa.int64(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "items": pa.list_(pa.string())}
_SPANS = StructType([StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType())), StructField("items", ArrayType(StringType()))])


def _find(index, hits_only: bool):
    """The first column with the words, spans and items of the second, a text; hits_only: of texts with any."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _KINDS}
            for _, n, hashes, bounds in words_of(batch.column(1)):
                start, window = index.value.occurrences(hashes, bounds)
                row = np.searchsorted(bounds, start, side="right") - 1
                order = np.argsort(row, kind="stable")
                start, window, row = start[order], window[order], row[order]
                cut = np.searchsorted(row, np.arange(n + 1))
                for k in range(n):
                    s, w = start[cut[k] : cut[k + 1]], window[cut[k] : cut[k + 1]]
                    a, b = _merge(s - bounds[k], s - bounds[k] + index.value.length[w]) if len(s) else ([], [])
                    out["starts"].append(a)
                    out["ends"].append(b)
                    out["items"].append(sorted({index.value.ids[i] for i in np.unique(index.value.item[w]).tolist()} - {None}))
                out["n_words"] += np.diff(bounds).tolist()
            found = pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], t) for k, t in _KINDS.items())], names=["row", *_KINDS])
            yield found.filter(pa.array([bool(x) for x in out["starts"]], pa.bool_())) if hits_only else found

    return find


def _index(documents: DataFrame, text: str, items: DataFrame, size: int) -> Index:
    """Of one block of the benchmark, which the driver holds."""
    rows = items.collect()  # a block of the benchmark, of block_bytes on average
    windows = item_windows([r.i for r in rows], [r.t for r in rows], size)
    vocabulary = np.unique(windows[0])
    counts = word_counts(documents, text, vocabulary) if len(vocabulary) else np.zeros(0, np.int64)
    return Index(windows, [r.i for r in rows], vocabulary, counts, size)


def found_rows(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (a struct of all columns) with n_words, the hit word spans (starts, ends) and items.

    A benchmark of several blocks is searched block by block over numbered rows, written once; only
    what is found is shuffled, by the row's number.
    """
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.coalesce(item_text, F.lit("")).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    share = documents.sparkSession.sparkContext.broadcast
    source = documents.select(F.struct(*(f"`{c}`" for c in documents.columns)).alias("row"), F.col(text).alias("text"))
    whole = StructType([source.schema["row"], StructField("n_words", LongType()), *_SPANS.fields])
    if blocks == 1:
        return source.mapInArrow(_find(share(_index(documents, text, items, size)), False), whole)
    numbered = written(source.select(F.monotonically_increasing_id().alias("n"), "row", "text"), "numbered")
    parts = None
    for b in range(blocks):
        index = _index(documents, text, items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b), size)
        hits = numbered.select(F.col("n").alias("row"), "text").mapInArrow(_find(share(index), True), StructType([StructField("row", LongType()), *whole.fields[1:]]))
        parts = hits if parts is None else parts.unionByName(hits)
    parts = parts.groupBy("row").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merge(np.array(s), np.array(e)) for s, e in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
            columns = [batch.column("row"), *(pa.array([x[k] for x in spans], pa.list_(pa.int32())) for k in range(2)), batch.column("items")]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *_SPANS.names])

    merged = parts.mapInArrow(merge, StructType([StructField("row", LongType()), *_SPANS.fields])).withColumnRenamed("row", "n")
    counted = numbered.select("n", "row", "text").mapInArrow(_counted, StructType([StructField("n", LongType()), source.schema["row"], StructField("n_words", LongType())]))
    none = [F.coalesce(x.name, F.array().cast(x.dataType)).alias(x.name) for x in _SPANS.fields]
    return counted.join(merged, "n", "left").select("row", "n_words", *none)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        many = [int(x) for _, _, _, bounds in words_of(batch.column(2)) for x in np.diff(bounds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(many, pa.int64())], names=["n", "row", "n_words"])


def find(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key with n_words, the hit word spans (starts, ends) and items of each row."""
    own = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return found_rows(own, benchmark, "text", **options).select(F.col("row.key").alias(key), "n_words", *_SPANS.names)


def n_hit(starts: str = "starts", ends: str = "ends"):
    return F.aggregate(F.zip_with(ends, starts, lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any hit word, with all their columns."""
    found = found_rows(documents, benchmark, text, **options)
    return found.where(F.size("starts") == 0).select("row.*")


def items_digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
