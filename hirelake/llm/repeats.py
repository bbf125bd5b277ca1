"""Which hashed parts of texts occur elsewhere in the corpus, with 4 bytes of each part shuffled.

A task hashes its rows' parts in batches. Parts that repeat inside a batch are known there: they are
passed on, and their bucket gets one mark; the others go to buckets as 32 bits each. So a part that
a third of all rows share sends one mark a batch and never fills a bucket. Equal texts of a batch
count once, under the least id of them. A part is told from others by 32 bits and its bucket.

Buckets grow in number with the corpus and have one size. Up to GROUPS of them a task deals its
parts straight to buckets; beyond that it deals them to GROUPS groups of neighbouring buckets first,
and tasks that each hold many parts of a few groups deal those on. So an entry never holds just a
few parts, and what a task does for a million parts doesn't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hirelake.llm import text as tx

#: Parts of a bucket, and of a batch that a task holds at once, about.
BUCKET, BATCH = 2_000_000, 1_000_000
#: Places that a task deals parts to at most.
GROUPS = 2048

_ENTRY = pa.schema({"bucket": pa.int32(), "kind": pa.int32(), "ids": pa.binary(), "counts": pa.binary(), "keys": pa.binary(), "places": pa.binary()})
_ENTRIES = "bucket int, kind int, ids binary, counts binary, keys binary, places binary"
_SINGLE, _MARK, _PASSED = range(3)

#: Parts of some rows: first row, rows, hashes and row of each part (in order of rows), its place or None, a digest of each row or None.
Parts = tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None, list | None]


def heads(found: list) -> np.ndarray:
    """The first 64 bits of each digest."""
    return np.frombuffer(b"".join(x[:8] for x in found), ">i8").astype(np.int64)


def _starts(rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)


def _pack(out: dict[str, list], kind: int, parts: np.ndarray, rows: np.ndarray, places: np.ndarray | None, ids: np.ndarray, each: int) -> None:
    """An entry for each bucket, or group of `each` buckets, that any of the parts is in: a loop over what there is. Groups keep the whole parts."""
    to = (parts >> np.uint64(32)).astype(np.int64) // each
    order = np.lexsort((rows, to))
    for at in np.split(order, _starts(to[order])[1:]) if len(order) else []:
        new = _starts(rows[at])
        counts = np.diff(np.append(new, len(at))).astype(np.uint32)
        keys = parts[at] if each > 1 else parts[at].astype(np.uint32)
        mark = kind == _MARK
        found = (int(to[at[0]]), kind, b"" if mark else ids[rows[at[new]]].tobytes(), b"" if mark else counts.tobytes(), keys.tobytes(), b"" if places is None else places[at].tobytes())
        for name, value in zip(out, found, strict=True):
            out[name].append(value)


def _flush(buckets: int, hashes: np.ndarray, rows: np.ndarray, places: np.ndarray | None, ids: np.ndarray, each: int = 1) -> pa.RecordBatch:
    where = (hashes >> np.uint64(32)) % np.uint64(buckets)
    parts = (where << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
    order = np.argsort(parts, kind="stable")  # rows stay in order within a part
    parts, rows = parts[order], rows[order]
    places = None if places is None else places[order]
    same = parts[1:] == parts[:-1]
    repeated = np.append(False, same) | np.append(same, False) if len(parts) else np.zeros(0, bool)
    out: dict[str, list] = {k: [] for k in _ENTRY.names}
    single, marks = np.flatnonzero(~repeated), np.unique(parts[repeated])
    _pack(out, _SINGLE, parts[single], rows[single], None if places is None else places[single], ids, each)
    _pack(out, _MARK, marks, np.zeros(len(marks), np.int64), None, ids, each)
    again = np.flatnonzero(repeated)
    groups = max(1, len(again) // 500_000)
    for p in range(groups):
        at = again[rows[again] % groups == p]
        if len(at):  # any group will do, as long as few share it: these are only passed on
            salt = np.sum(tx.mix(ids[np.unique(rows[at])].view(np.uint64)), dtype=np.uint64, keepdims=True)
            at = at[np.argsort(rows[at], kind="stable")]
            new = _starts(rows[at])
            counts = np.diff(np.append(new, len(at))).astype(np.uint32)
            own = (parts[at].view(np.int64) if places is None else places[at]).astype(np.int64)
            found = (-1 - (int(tx.mix(salt)[0]) >> 34), _PASSED, ids[rows[at[new]]].tobytes(), counts.tobytes(), b"", own.tobytes())
            for name, value in zip(out, found, strict=True):
                out[name].append(value)
    return pa.RecordBatch.from_pydict(out, _ENTRY)


def _split(most: int):
    """Deals the parts of groups on to their buckets, as many at once as a task may hold."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {_SINGLE: [], _MARK: []}

        def ready() -> pa.RecordBatch:
            out: dict[str, list] = {k: [] for k in _ENTRY.names}
            for kind, entries in held.items():
                if entries:
                    ids, parts, rows, places = ([e[k] for e in entries] for k in range(4))
                    shift = np.cumsum([0, *(len(i) for i in ids[:-1])])
                    row = np.concatenate([r + n for r, n in zip(rows, shift, strict=True)])
                    own = None if places[0] is None else np.concatenate(places)
                    _pack(out, kind, np.concatenate(parts), row, own, np.concatenate(ids), 1)
                entries.clear()
            return pa.RecordBatch.from_pydict(out, _ENTRY)

        n = 0
        for batch in batches:
            passed = np.array(batch.column(1)) == _PASSED
            yield batch.filter(pa.array(passed))
            for _, kind, i, c, k, p in zip(*(batch.filter(pa.array(~passed)).column(name).to_pylist() for name in _ENTRY.names), strict=True):
                ids, parts = np.frombuffer(i, np.int64), np.frombuffer(k, np.uint64)
                rows = np.zeros(len(parts), np.int64) if kind == _MARK else np.repeat(np.arange(len(ids)), np.frombuffer(c, np.uint32))
                held[kind].append((ids, parts, rows, np.frombuffer(p, np.uint32) if p else None))
                n += len(parts)
                if n >= most:
                    yield ready()
                    n = 0
        yield ready()

    return split


def _entries(parts_of: Callable[[pa.RecordBatch], Iterator[Parts]], buckets: int, most: int, by_digest: bool, each: int = 1):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = rows = 0
        seen: dict[bytes, tuple[np.ndarray, int]] = {}  # where the id of a text is: that of its copy with the least one

        def ready() -> Iterator[pa.RecordBatch]:
            if n:
                places = None if held[0][2] is None else np.concatenate([h[2] for h in held])
                yield _flush(buckets, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), places, np.concatenate([h[3] for h in held]), each)

        for batch in batches:
            ids = np.array(batch.column(0), dtype=np.int64)
            for first, many, hashes, row, places, found in parts_of(batch):
                own_ids = ids[first : first + many]
                if by_digest:
                    own_ids = own_ids ^ heads(found)
                fresh = np.zeros(many, bool)
                for k in np.unique(row).tolist():
                    kept, place = seen.setdefault(found[k], (own_ids, k))
                    fresh[k] = kept is own_ids and place == k
                    kept[place] = min(kept[place], own_ids[k])
                keep = fresh[row]
                held.append((hashes[keep], row[keep] + rows, None if places is None else places[keep], own_ids))
                n, rows = n + int(keep.sum()), rows + many
                if n >= most:
                    yield from ready()
                    held, n, rows, seen = [], 0, 0, {}
        yield from ready()

    return entries


_GROUP = pa.schema({"group": pa.int32(), "ids": pa.binary(), "counts": pa.binary(), "places": pa.binary()})


def _grouped(ids: np.ndarray, counts: np.ndarray, places: np.ndarray, groups: int, out: dict[str, list]) -> None:
    """Rows (id, so many places) dealt by id to groups, each group packed into one row."""
    where = (tx.mix(ids.view(np.uint64).copy()) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    by = np.argsort(np.repeat(where, counts), kind="stable")  # a row's places stay together and in order
    places, ids, counts, where = places[by], ids[order], counts[order], where[order]
    bounds = np.searchsorted(where, np.arange(groups + 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    for g in np.unique(where).tolist():
        a, b = bounds[g], bounds[g + 1]
        for name, value in zip(out, (g, ids[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes(), places[ends[a] : ends[b]].tobytes()), strict=True):
            out[name].append(value)


def _shared(groups: int):
    def shared(table: pa.Table) -> pa.Table:
        return _shared_of(table, groups)

    return shared


def _shared_of(table: pa.Table, groups: int) -> pa.Table:
    """The parts of each row of one bucket that occur elsewhere too, packed by group of ids."""
    ids, counts, keys, places, marks = [], [], [], [], []
    out: dict[str, list] = {k: [] for k in _GROUP.names}
    bucket = 0
    for b, kind, i, c, k, p in zip(*(table.column(n).to_pylist() for n in _ENTRY.names), strict=True):
        if kind == _PASSED:
            _grouped(np.frombuffer(i, np.int64), np.frombuffer(c, np.uint32).astype(np.int64), np.frombuffer(p, np.int64), groups, out)
        elif kind == _MARK:
            marks.append(np.frombuffer(k, np.uint32))
        else:
            bucket = b
            ids.append(np.frombuffer(i, np.int64))
            counts.append(np.frombuffer(c, np.uint32))
            keys.append(np.frombuffer(k, np.uint32))
            places.append(np.frombuffer(p, np.uint32))
    if keys:
        key, row = np.concatenate(keys), np.repeat(np.arange(sum(map(len, ids)), dtype=np.int32), np.concatenate(counts))
        del keys
        known = np.unique(np.concatenate(marks)) if marks else key[:0]
        every = np.sort(np.concatenate([key, known]))
        often = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        if len(often):
            hit = np.isin(key, often)
            place = np.concatenate(places)
            value = place[hit].astype(np.int64) if len(place) else (np.int64(bucket) << np.int64(32)) | key[hit].astype(np.int64)
            row, every_id = row[hit], np.concatenate(ids)
            new = _starts(row)
            _grouped(every_id[row[new]], np.diff(np.append(new, len(row))), value, groups, out)
    return pa.Table.from_pydict(out, _GROUP)


def _by_id(table: pa.Table) -> pa.Table:
    """The places of each id of one group, in order."""
    ids, places = [], []
    for i, c, p in zip(*(table.column(n).to_pylist() for n in _GROUP.names[1:]), strict=True):
        ids.append(np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.uint32)))
        places.append(np.frombuffer(p, np.int64))
    ids, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, places))
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (places[1:] != places[:-1])) if len(ids) else np.zeros(0, bool)
    ids, places = ids[new], places[new]
    first = _starts(ids)
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int64()), pa.array(places, pa.int64()))
    return pa.table({"id": pa.array(ids[first], pa.int64()), "places": lists.cast(pa.list_(pa.int64()))})


def repeated(
    rows: DataFrame, parts_of: Callable[[pa.RecordBatch], Iterator[Parts]], total: int, bucket: int = BUCKET, batch: int = BATCH, by_digest: bool = False
) -> DataFrame:
    """id and places of the parts that occur elsewhere, in order; rows' first column is their id (long).

    total: about how many parts there are. Without places, the parts themselves are returned, as
    numbers that are equal for equal parts. by_digest: an id becomes the exclusive or of itself and
    the head of its text's digest, so rows with one id and different texts are apart.
    """
    buckets = max(1, -(-total // bucket))
    each = -(-buckets // GROUPS)
    entries = rows.mapInArrow(_entries(parts_of, buckets, batch, by_digest, each), _ENTRIES)
    if each > 1:
        turns = max(1, total // GROUPS // (8 * batch))  # tasks that share a group
        dealt = entries.repartition(F.col("bucket"), F.pmod(F.spark_partition_id(), F.lit(turns))).sortWithinPartitions("bucket")
        entries = dealt.mapInArrow(_split(batch), _ENTRIES)
    partitions = max(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = entries.repartition(partitions, "bucket").groupBy("bucket").applyInArrow(_shared(partitions), "group int, ids binary, counts binary, places binary")
    return found.repartition(partitions, "group").groupBy("group").applyInArrow(_by_id, "id long, places array<long>")
