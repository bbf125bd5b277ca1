"""Removal of repeated byte strings by suffix arrays over the places that can repeat.

A byte is removed when a string of `span` bytes over it also starts earlier in the corpus: in a
document that comes before, or earlier in the same one. Strings never cross documents.

1. Equal texts are one text; of each, the copy that comes first is looked at, the others go whole.
2. Winnowing gives every string one fingerprint: the least hash of the grams in it. Equal strings
   have equal fingerprints, so only fingerprints that occur twice matter, and only the texts that
   have some are read again.
3. A fingerprint's context is the text under the strings it stands for. Equal contexts are one,
   kept for the first place; at all other places those strings start earlier.
4. What is left, different contexts of one fingerprint, is dealt to shards. Each shard is cut into
   parts; each part gets a suffix array (Larsson-Sadakane refinement: groups of equal prefixes are
   split by the rank of what follows, doubling the compared length) and common
   prefixes (Kasai), and the parts' sorted strings are merged by binary search. The strings of a
   fingerprint with more than `block` contexts meet by their hashes instead, so no shard grows with it.

Defined cases: a null text is empty; texts under the span lose nothing. Keys have any type that
is ordered (all but integers are numbered in their order first); a null key comes last. Rows that repeat a key and text are one document, each with its own result row;
different texts of one key come in a fixed order of their own. Fingerprints, contexts and texts are
compared by hashes (64, 64 and 128 bits), strings of a hot fingerprint by 64 bits and that. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from hirelake.llm import repeats, text as tx
from hirelake.llm.merkle import placed
from hirelake.llm.shared import discard, fresh, new_folder, written

SPAN = 100
GRAM = 32
#: Bytes of contexts in a shard and in a part of it, about.
SHARD_BYTES, PART_BYTES = 2 << 20, 1 << 20
#: Contexts of one fingerprint that meet in one shard; the strings of more meet by hashes.
BLOCK = 4000
_LAST = (1 << 63) - 1
_PARTITIONS = "spark.sql.shuffle.partitions"


def winnow(raw: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Fingerprints of the texts between the offsets: hash, place, first and last start of the strings each stands for, row."""
    windows, width = len(raw) - span + 1, span - gram + 1
    found = [[np.zeros(0, np.uint64)], *([np.zeros(0, np.int64)] for _ in range(4))]
    if windows > 0:
        valid = np.zeros(windows + 1, np.int64)
        long = np.flatnonzero(np.diff(offsets) >= span)
        np.add.at(valid, offsets[long], 1)
        np.add.at(valid, offsets[long + 1] - span + 1, -1)
        valid = np.cumsum(valid[:-1]) > 0
        step = 1 << 21
        for low in range(0, windows, step):
            high = min(low + step, windows)
            part = raw[low : high + span - 1]
            n = len(part) - gram + 1
            up, down = tx.powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
            h = tx.mix((total[gram:] - total[:n]) * down[:n])
            mask = np.uint64((1 << 22) - 1)
            least = (h & ~mask) | (mask - np.arange(n, dtype=np.uint64))  # of equal ones the last is taken
            reach = 1
            while 2 * reach <= width:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            if reach < width:
                least = np.minimum(least[: n - width + 1], least[width - reach : width - reach + n - width + 1])
            start = np.flatnonzero(valid[low:high])
            if not len(start):
                continue
            place = (mask - (least[start] & mask)).astype(np.int64)
            new = np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))
            first, last = start[new], start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
            place = place[new]
            row = np.searchsorted(offsets, first + low, side="right") - 1
            for out, x in zip(found, (h[place], place + low, first + low, last + low, row), strict=True):
                out.append(x)
    return tuple(np.concatenate(x) for x in found)


def suffix_array(t: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the first 8 bytes at each place as a number (so many places past the end are zeros)."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(span + 16, np.uint8)])
    word = np.zeros(n + span + 8, np.uint64)
    for k in range(8):
        word |= padded[k : k + len(word)].astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.argsort(word[:n], kind="stable")
    sorted_word = word[order]
    new = np.append(True, sorted_word[1:] != sorted_word[:-1]) if n else np.zeros(0, bool)
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    at = np.flatnonzero(~(new & np.append(new[1:], True))) if n else np.zeros(0, np.int64)  # places in groups of several
    h = 8
    while len(at):  # whole suffixes differ, if only in length; Kasai's rule needs their full order
        own = order[at]
        group = rank[own]
        key = group * (n + 1) + rank[np.minimum(own + h, n)] + 1
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[at] = own
        new = np.append(True, key[1:] != key[:-1])
        rank[own] = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        at = at[~(new & np.append(new[1:], True))]
        h *= 2
    return order, word


def common_prefixes(order: np.ndarray, word: np.ndarray, most: int = SPAN, lanes: int = 32) -> np.ndarray:
    """The bytes, up to `most`, that each suffix in the order shares with the one before it.

    Kasai's rule (what follows a place shares at most one byte less) is applied along lanes: the
    text is read from every 32nd place at once, each lane going on from its own last result.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    last = np.zeros(-(-n // lanes), np.int64)
    for lane in range(lanes):
        place = np.arange(lane, n, lanes)
        own = np.maximum(last[: len(place)] - 1, 0)
        live = np.flatnonzero((before[place] >= 0) & (own < most))
        own[before[place] < 0] = 0
        while len(live):
            p = place[live]
            differ = word[p + own[live]] ^ word[before[p] + own[live]]
            same = differ == 0
            own[live[same]] += 8
            rest, bits = live[~same], differ[~same]
            byte = np.zeros(len(rest), np.int64)
            for k in range(1, 8):
                byte += (bits >> np.uint64(64 - 8 * k)) == 0
            own[rest] += byte
            live = live[same]
            live = live[own[live] < most]
        last = np.minimum(own, most)
        shared[place] = last
    return shared[order]


def _part(t: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings at the starts in order: the first start of each different one, and the group of each start."""
    order, word = suffix_array(t, span)
    group_of = np.zeros(len(t), np.int64)
    group_of[order] = np.cumsum(common_prefixes(order, word, span) < span)
    names, first, inverse = np.unique(group_of[starts], return_index=True, return_inverse=True)
    return starts[first], inverse


def earliest(t: np.ndarray, contexts: np.ndarray, starts: np.ndarray, turn: np.ndarray, span: int = SPAN, part_bytes: int = PART_BYTES) -> np.ndarray:
    """The least turn among the starts with the same string of `span` bytes, for each start.

    contexts: where each begins in t; parts are cut there. starts: sorted.
    """
    t = np.where(t == 0, np.uint8(0xFE), t)  # numpy ends strings at zeros, and no text has this byte
    cuts, at = [0], 0
    while at < len(t):
        nxt = int(np.searchsorted(contexts, at + part_bytes, side="left"))
        at = int(contexts[nxt]) if nxt < len(contexts) else len(t)
        cuts.append(at)
    every: list[tuple[slice, np.ndarray, np.ndarray]] = []
    keys = least = None
    for low, high in zip(cuts, cuts[1:], strict=False):
        own = slice(int(np.searchsorted(starts, low)), int(np.searchsorted(starts, high)))
        if own.start == own.stop:
            continue
        first, group = _part(t[low:high], starts[own] - low, span)
        best = np.full(len(first), _LAST)
        np.minimum.at(best, group, turn[own])
        strings = np.lib.stride_tricks.sliding_window_view(t[low:high], span)[first].copy().view(f"S{span}").ravel()
        every.append((own, group, strings))
        if keys is None:
            keys, least = strings, best
            continue
        place = np.searchsorted(keys, strings)
        known = keys[np.minimum(place, len(keys) - 1)] == strings
        least[place[known]] = np.minimum(least[place[known]], best[known])
        keys, least = np.insert(keys, place[~known], strings[~known]), np.insert(least, place[~known], best[~known])
    out = np.zeros(len(starts), np.int64)
    for own, group, strings in every:
        out[own] = (least if len(every) == 1 else least[np.searchsorted(keys, strings)])[group]
    return out


def _resolve(span: int, part_bytes: int):
    def resolve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        raw, offsets = tx.buffers(table.column("context").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
        o, ident, a = (np.asarray(table.column(n)) for n in ("o", "id", "a"))
        many = np.diff(offsets) - span + 1
        row = np.repeat(np.arange(len(many)), many)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        place = a[row] + inside
        turn = np.empty(len(row), np.int64)
        turn[np.lexsort((place, ident[row], o[row]))] = np.arange(len(row))
        gone = earliest(raw, offsets[:-1], offsets[:-1][row] + inside, turn, span, part_bytes) < turn
        row, place = row[gone], place[gone]
        new = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)) if len(row) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(row) - 1) if len(first) else first
        return pa.table({"id": ident[row[first]], "s": place[first], "e": place[last] + span})

    return resolve


def _parts(span: int, gram: int):
    def parts(batch: pa.RecordBatch) -> Iterator[repeats.Parts]:
        digests = batch.column(1).to_pylist()
        raw, offsets = tx.buffers(batch.column(2))
        for first, last in tx.slices(offsets):
            own = offsets[first : last + 1]
            h, place, _, _, row = winnow(raw[own[0] : own[-1]], own - own[0], span, gram)
            yield first, last - first, h, row, (place - (own - own[0])[row]).astype(np.uint32), digests[first:last]

    return parts


def _known(part: np.ndarray, offsets: np.ndarray, places: pa.Array, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """The fingerprints of the texts at the given places of each."""
    found = winnow(part, offsets, span, gram)
    place, row = found[1], found[4]
    lengths = np.asarray(places.value_lengths(), dtype=np.int64)
    at = np.asarray(places.flatten()) + np.repeat(offsets[:-1], lengths)
    keep = np.isin(place, at)  # places of different texts can't be mixed up: all are places in the slice
    return tuple(x[keep] for x in found)


def _occurrences(span: int, gram: int):
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tx.buffers(batch.column("text"))
            ids, o, places = np.asarray(batch.column("id")), np.asarray(batch.column("o")), batch.column("places")
            for low, high in tx.slices(offsets):
                own = offsets[low : high + 1]
                part, own = raw[own[0] : own[-1]], own - own[0]
                h, place, first, last, row = _known(part, own, places.slice(low, high - low), span, gram)
                end = last + span
                same = tx.mix(tx.word_hashes(part, first, end) + (place - first).astype(np.uint64))
                columns = [h.view(np.int64), same.view(np.int64), o[low + row], ids[low + row], first - own[row], end - own[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["fp", "same", "o", "id", "a", "e"])

    return occurrences


_OCCURRENCE = "fp long, same long, o long, id long, a long, e long"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts wanted of each text."""
    for batch in batches:
        raw, offsets = tx.buffers(batch.column("text"))
        wanted = batch.column("wanted")
        row = np.repeat(np.arange(batch.num_rows), np.asarray(wanted.value_lengths(), dtype=np.int64))
        shard, a, e = (np.asarray(wanted.flatten().field(n)) for n in ("shard", "a", "e"))
        data = raw.tobytes()
        at = offsets[row]
        own = [data[x:y] for x, y in zip((at + a).tolist(), (at + e).tolist(), strict=True)]
        o, ids = (np.asarray(batch.column(n))[row] for n in ("o", "id"))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (shard, o, ids, a)), pa.array(own, pa.binary())], names=["shard", "o", "id", "a", "context"])


def _cut(span: int, gram: int):
    """The spans to remove and the digest of the rest, of each text that loses bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct({"s": pa.int64(), "e": pa.int64()}))
        for batch in batches:
            raw, offsets = tx.buffers(batch.column("text"))
            out: dict[str, list] = {"id": [], "spans": [], "kept_sha256": []}
            ids, firsts, ranges = batch.column("id").to_pylist(), batch.column("firsts"), batch.column("ranges")
            for low, high in tx.slices(offsets):
                own = offsets[low : high + 1]
                part, own = raw[own[0] : own[-1]], own - own[0]
                _, _, first, last, row = _known(part, own, batch.column("places").slice(low, high - low), span, gram)
                bounds = np.searchsorted(row, np.arange(high - low + 1))
                for k in range(high - low):
                    a, e = (x[bounds[k] : bounds[k + 1]] - own[k] for x in (first, last + span))
                    if firsts[low + k].is_valid:
                        later = ~np.isin(a, np.asarray(firsts[low + k].values))
                        a, e = a[later], e[later]
                    if ranges[low + k].is_valid:
                        a, e = (np.append(x, np.asarray(ranges[low + k].values.field(n))) for x, n in ((a, "s"), (e, "e")))
                    if not len(a):
                        continue
                    order = np.argsort(a, kind="stable")
                    a, e = a[order], np.maximum.accumulate(e[order])
                    new = np.append(True, a[1:] > e[:-1])
                    a, e = a[new].tolist(), e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)].tolist()
                    data = part[own[k] : own[k + 1]].tobytes()
                    kept = b"".join(data[x:y] for x, y in zip([0, *e], [*a, len(data)], strict=True))
                    out["id"].append(ids[low + k])
                    out["spans"].append([{"s": x, "e": y} for x, y in zip(a, e, strict=True)])
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_pydict(out, pa.schema({"id": pa.int64(), "spans": kind, "kept_sha256": pa.string()}))

    return cut


def _rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.encode(body, "UTF-8")))
    place = F.col(key)
    if not isinstance(documents.schema[key].dataType, IntegralType):  # other keys count by their place among all of them
        own, name = fresh(documents, "own", "place")
        keys = documents.where(F.col(key).isNotNull()).select(F.lit("").alias("tree"), F.col(key).alias(own)).distinct()
        documents = documents.join(placed(keys, [own]).select(own, F.col("place").alias(name)), F.col(key) == F.col(own), "left")
        place = F.col(name)
    o = F.coalesce(place.cast("long"), F.lit(_LAST))
    return documents.select(F.col(key).alias("key"), o.alias("o"), digest.alias("digest"), body.alias("text")).withColumn("id", F.xxhash64("o", "digest"))


def dealt_contexts(firsts: DataFrame, block: int, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """shard, id, a and e of the contexts whose fingerprint has several, each once; fp, id, a and e where it has more than `block`."""
    many = firsts.groupBy("fp").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    several = firsts.join(many, "fp")
    few = several.where(F.col("m") <= block)
    total = few.agg(F.coalesce(F.sum(F.col("e") - F.col("a")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    return few.select(F.pmod(F.xxhash64("fp"), F.lit(shards)).alias("shard"), "id", "a", "e"), several.where(F.col("m") > block).select("fp", "id", "a", "e")


def _strings(span: int):
    """Fingerprint and hash of each string in the contexts wanted of each text."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tx.buffers(batch.column("text"))
            wanted, o, ids = batch.column("wanted"), np.asarray(batch.column("o")), np.asarray(batch.column("id"))
            for low, high in tx.slices(offsets):
                own = wanted.slice(low, high - low)
                row = np.repeat(np.arange(low, high), np.asarray(own.value_lengths(), dtype=np.int64))
                fp, a, e = (np.asarray(own.flatten().field(n)) for n in ("fp", "a", "e"))
                many = e - a - span + 1
                s = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                row, fp = np.repeat(row, many), np.repeat(fp, many)
                at = offsets[row] - offsets[low] + s
                h = tx.word_hashes(raw[offsets[low] : offsets[high]], at, at + span).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (fp, h, o[row], ids[row], s)], names=["fp", "h", "o", "id", "s"])

    return strings


def hot_ranges(texts: DataFrame, hot: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """id, s and e of the strings of hot fingerprints that start earlier, and the table they are read from.

    Strings meet by fingerprint and hash, so only equal ones do, however many contexts there are;
    a common string is reduced to its first place before it meets its copies.
    """
    wanted = hot.groupBy("id").agg(F.collect_set(F.struct("fp", "a", "e")).alias("wanted"))
    strings = texts.select("id", "o", "text").join(wanted, "id").mapInArrow(_strings(span), "fp long, h long, o long, id long, s long")
    strings = written(strings, "strings")
    first = strings.groupBy("fp", "h").agg(F.min(F.struct("o", "id", "s")).alias("f"), F.count("*").alias("n")).where(F.col("n") > 1)
    later = strings.join(first, ["fp", "h"]).where(F.struct("o", "id", "s") != F.col("f"))
    return later.select("id", "s", (F.col("s") + span).alias("e")), strings


def candidates(rows: DataFrame, facts: DataFrame, span: int, gram: int) -> DataFrame:
    """id, o, text and places of the first copies that share a fingerprint, one row of each id, as a table bucketed by id.

    Later steps join small tables to it by id, so the texts are shuffled once. Rows that repeat a key
    and text become one before the shuffle and after it, however many they are.
    """
    spark = rows.sparkSession
    first = facts.groupBy("digest").agg(F.min("o").alias("o"), F.min("id").alias("named")).select("named", F.xxhash64("o", "digest").alias("first"))
    size = facts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    # the least id of a text's copies names it, as every batch with that copy sees it; texts that share a key are apart
    found = repeats.repeated(rows.select("id", "digest", "text"), _parts(span, gram), size * 2 // (span - gram + 2))
    places = found.join(first, found["id"] == first["named"]).select(F.col("first").alias("id"), "places")
    n = max(int(spark.conf.get(_PARTITIONS)), -(-size // (32 << 20)))
    texts = rows.select("id", "o", "text").dropDuplicates(["id"]).join(places, "id")
    name, folder = f"candidates_{uuid.uuid4().hex}", new_folder(spark, "candidates")
    before = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, n)  # the shuffle that drops repeated rows deals them to their buckets
    try:
        texts.write.bucketBy(n, "id").option("path", folder).saveAsTable(name)
    finally:
        spark.conf.set(_PARTITIONS, before)
    out = spark.table(name)
    out.written_to, out.named = folder, name
    return out


def dedup(
    documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, block: int = BLOCK, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """key, n_bytes, spans (removed, as s and e in bytes) and kept_sha256 of each row."""
    rows = _rows(documents, key, text)
    facts = rows.select("key", "o", "digest", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    facts = written(facts, "facts")
    texts = candidates(rows, facts, span, gram)
    seen = texts.select("id", "o", "text", "places").mapInArrow(_occurrences(span, gram), _OCCURRENCE)
    firsts = written(seen.groupBy("fp", "same").agg(F.min(F.struct("o", "id", "a", "e")).alias("f")).select("fp", "same", "f.id", "f.a", "f.e"), "firsts")
    few, hot = dealt_contexts(firsts, block, shard_bytes)
    wanted = few.groupBy("id").agg(F.collect_set(F.struct("shard", "a", "e")).alias("wanted"))
    contexts = texts.select("id", "o", "text").join(wanted, "id").mapInArrow(_contexts, "shard long, o long, id long, a long, context binary")
    parts = contexts.groupBy("shard").applyInArrow(_resolve(span, part_bytes), "id long, s long, e long")
    ranges, *strings = hot_ranges(texts, hot, span)
    parts = parts.unionByName(ranges)
    own = parts.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    first_places = firsts.groupBy("id").agg(F.collect_list("a").alias("firsts"))
    joined = texts.select("id", "text", "places").join(first_places, "id", "left").join(own, "id", "left")
    cut = written(joined.mapInArrow(_cut(span, gram), "id long, spans array<struct<s:long,e:long>>, kept_sha256 string"), "cut")
    documents.sparkSession.sql(f"DROP TABLE {texts.named}")
    discard(texts, firsts, *strings)
    first = facts.groupBy("digest").agg(F.min("o").alias("first"))
    copy = (F.col("o") > F.col("first")) & (F.col("n_bytes") >= span)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e")))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    both = facts.join(first, "digest").join(cut, "id", "left")
    spans = F.when(copy, whole).otherwise(F.coalesce("spans", none))
    kept = F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha256"))
    return both.select(F.col("key").alias(key), "n_bytes", spans.alias("spans"), kept.alias("kept_sha256"))


def n_removed(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
