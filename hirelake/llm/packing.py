"""Best-fit packing by the sum-of-squares rule.

Documents become token ids plus an end id; only those over the capacity are cut. Pieces are dealt
to groups by hash; inside a group, which holds lengths only, each piece goes where the sum over
gaps of (open bins with that gap) squared becomes smallest, counting a new bin as a choice.

Defined cases: a null or empty text is the end id alone. Repeated rows are packed once each; they
share doc_id and piece. Placement inside a group follows (length, id, piece), so a task that runs
again places alike. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CAPACITY = 2048
END_ID = 0
#: Text of a group that is packed apart, in bytes; its lengths are what a task holds.
GROUP_BYTES = 32 << 20
#: Fixed names of the vocabulary: as merges, and the same tokens as ranks, which give the same ids in a third of the time.
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed values of the vocabulary: its one added token.
ADDED = {"<|endoftext|>": 50256}

_encoders: dict[str, object] = {}


def encoder(ranks_path: str | None = None, added: bool = True):
    """text -> uint32 ids, those of the merges file with its defaults: the added token's text gets its id. Not added: it is ordinary text."""
    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path(RANKS)
    if path not in _encoders:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    encode, allowed = _encoders[path].encode_to_numpy, set(ADDED) if added else set()
    return lambda text: encode(text, allowed_special=allowed, disallowed_special=()).astype(np.uint32, copy=False)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens: the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = True,
    ranks_path: str | None = None,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32 and, with_ids, the ids."""
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(ranks_path), np.array([end_id], np.uint32)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                at, rows, ids = [], [], []
                for k, t in enumerate(part.column(1).to_pylist()):
                    own = np.concatenate([encode(t), end]) if t else end
                    for p, (s, n) in enumerate(cuts(len(own), capacity)):
                        at.append(k)
                        rows.append((p, s, n, zlib.crc32(own[s : s + n].astype("<u4", copy=False).data)))
                        if with_ids:
                            ids.append(own[s : s + n].astype(np.int32))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                names = [key, "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), *columns], names=names)

    return documents.select(key, text).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the order given."""
    counts = np.zeros(capacity + 1, np.int64)  # open bins by gap; gaps 0 and capacity aren't counted
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        # a bin of gap g becomes one of gap g - n: the sum changes by 2 (N[g - n] - N[g] + 1); a filled bin no longer counts
        change = 2 * (counts[: capacity - n + 1] - counts[n:]) + 2
        change[0] = 1 - 2 * counts[n]
        change[-1] = 2 * counts[capacity - n] + 1 if n < capacity else 0
        change[:-1][counts[n:-1] == 0] = np.iinfo(np.int64).max
        g = int(change.argmin()) + n
        if g == capacity:
            b, opened = opened, opened + 1
        else:
            b = stacks[g].pop()
            counts[g] -= 1
        left = g - n
        bins[i], offsets[i] = b, capacity - g
        if left:
            counts[left] += 1
            stacks[left].append(b)
    return bins, offsets


def groups_for(documents: DataFrame, text: str = "text", group_bytes: int = GROUP_BYTES) -> int:
    """How many groups to pack apart: by the bytes of text, so a group has enough pieces to fill its sequences."""
    total = documents.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(1, total // group_bytes)


def pack(cut: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, groups: int | None = None) -> DataFrame:
    """The pieces with sequence_id and offset. groups: how many are packed apart; if none is given, as many as shuffle partitions."""
    n = groups or int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.withColumn("__group", F.pmod(F.xxhash64(key, "piece", "length", "ids_crc32", F.monotonically_increasing_id()), F.lit(n)))  # the number deals out rows that repeat
    full = dealt.columns

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", key, "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        group["sequence_id"] = group["__group"].to_numpy() * (1 << 40) + bins
        group["offset"] = offsets
        return group[[c for c in full if c != "__group"] + ["sequence_id", "offset"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.groupBy("__group").applyInPandas(place, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per sequence: its pieces in order, as (key, piece, start, length, offset), and its length."""
    inside = F.sort_array(F.collect_list(F.struct("offset", key, "piece", "start", "length")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), inside.alias("pieces"))
