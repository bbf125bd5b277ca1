"""Language identification by rank order: a text's most frequent n-grams against the profile of each language.

A profile is the list of a language's most frequent n-grams of one to three letters, most frequent
first, with a space at each end of a word. A text has such a list too. Its out-of-place distance to
a profile adds up, for each of its n-grams, how far the ranks lie apart; one that the profile lacks
counts as the longest way there is. The nearest language wins, the smaller name at ties, and the
score is how near it is: 1 for equal lists, 0 if no n-gram is shared.

How it runs. Letters are code points, lower-cased; each takes ten bits (code points below 768
themselves, others by a hash into the 256 codes above), so an n-gram is a 32-bit number, and a
slice of texts is counted by one sort. Profiles count every whole text that may be learned from: a
task adds up its n-grams a language and sends each once, Spark sums them and keeps the first
`LENGTH` of each language. Only the profiles reach the driver, LENGTH rows a language; over
MOST_LANGUAGES languages it raises, as the column then holds something else. Scoring is one pass.

Defined results: a text that is null, empty or has no letter is `und` with score 0, and so is every
text where nothing could be learned. Rows with a null language or no letter teach nothing; a
language of which only such rows exist isn't learned. A null id counts as learnable, as its CRC is
null. Rows may repeat; each is scored alone and each is counted. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hirelake.llm import text as tx
from hirelake.llm.shared import fresh

#: N-grams of a profile, and of a text's list.
LENGTH = 300
#: Languages are few; more are a fault in the data.
MOST_LANGUAGES = 10_000
UNDETERMINED = "und"

_BITS, _DIRECT = 10, 768
_codes: list[np.ndarray] = []


def codes() -> np.ndarray:
    """The ten-bit code of each code point: 0 for what isn't a letter, 32 stays free for the ends of words."""
    if not _codes:
        points = np.arange(0x110000, dtype=np.uint32)
        letter = np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        spread = _DIRECT + ((points * np.uint32(2654435761)) >> np.uint32(24))
        _codes.append(np.where(letter, np.where(points < _DIRECT, points, spread), 0).astype(np.uint32))
    return _codes[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts in turn, and where those of each text begin (one more at the end)."""
    lower = [t.lower() for t in texts]
    ends = np.cumsum([0, *(len(t) + 1 for t in lower)])
    code = codes()[np.frombuffer(("\n".join([*lower, ""])).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    inside = code > 0
    # one end between two words, however many marks stand there
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    place = np.flatnonzero(keep)
    code, letter = np.where(inside, code, 32)[place], inside[place]
    at = np.searchsorted(place, ends)
    if not len(code):
        return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
    before = np.concatenate([[np.uint32(32)], code[:-1]]).astype(np.uint32)  # a text begins behind the end of the one before
    after = np.concatenate([code[1:], [np.uint32(32)]]).astype(np.uint32)
    one = code | np.uint32(1 << 30)
    two = (before << np.uint32(_BITS)) | code | np.uint32(2 << 30)
    three = (((before << np.uint32(_BITS)) | code) << np.uint32(_BITS)) | after | np.uint32(3 << 30)
    every = np.stack([one, two, three], axis=1)
    valid = np.stack([letter, letter | (before != 32), letter], axis=1)
    n = np.concatenate([[0], np.cumsum(valid.sum(axis=1))])
    return every[valid], n[at]


def counted(sorted_grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.concatenate([[True], sorted_grams[1:] != sorted_grams[:-1]])) if len(sorted_grams) else np.zeros(0, np.int64)
    return sorted_grams[new], np.diff(np.append(new, len(sorted_grams)))


def ranking(own: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first, the smaller number at ties."""
    gram, n = counted(np.sort(own))
    order = (n.astype(np.uint64) << np.uint64(32)) | (~gram).astype(np.uint64)
    if len(order) > length:
        order = np.partition(order, len(order) - length)[-length:]
    return ~(np.sort(order)[::-1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Slices of texts, and the row that each begins at."""
    _, offsets = tx.buffers(column)
    for a, b in tx.slices(offsets):
        yield a, [t or "" for t in column.slice(a, b - a).to_pylist()]


def learnable(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 != 2, F.lit(True))


def counts(docs: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """lang, gram, n over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(gram, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(gram[order]) != 0]))
            return gram[order][first], np.add.reduceat(n[order], first)

        def full(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
            return [summed(parts)] if len(parts) > 16 else parts

        for batch in batches:
            names = batch.column(1).to_pylist()
            for a, texts in _texts(batch.column(0)):
                found, at = grams(texts)
                rows: dict[str, list[int]] = {}
                for i in range(len(texts)):
                    if at[i + 1] > at[i]:
                        rows.setdefault(names[a + i], []).append(i)
                for name, own in rows.items():
                    parts = total.setdefault(name, [])
                    parts.append(counted(np.sort(np.concatenate([found[at[i] : at[i + 1]] for i in own]))))
                    total[name] = full(parts)
        for name, parts in total.items():
            gram, n = summed(parts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(gram), pa.string()), "gram": gram.astype(np.int64), "n": n.astype(np.int64)})

    rows = docs.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(text, F.col(language).cast("string"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", language: str = "lang", length: int = LENGTH) -> dict[str, list[int]]:
    """The profile of each language, from all rows of docs."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    first = counts(docs, text, language).withColumn("place", F.row_number().over(order)).where(F.col("place") <= length)
    lists = first.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "gram"))).alias("grams"))
    found = lists.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is {language} a language?")
    return {r.lang: [g.gram for g in r.grams] for r in found}


def distances(own: np.ndarray, gram: np.ndarray, ranks: np.ndarray, length: int) -> np.ndarray:
    """The out-of-place distance of a ranking to each profile. gram: all n-grams of profiles, sorted; ranks: theirs in each, or -1."""
    at = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
    there = np.where((gram[at] == own)[:, None], ranks[at], -1)
    away = np.abs(there - np.arange(len(own))[:, None])
    return np.where(there < 0, length, away).sum(axis=0)


def predict(docs: DataFrame, model: dict[str, list[int]], key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The key, lang_pred and score of each row."""
    names = sorted(model, key=lambda x: x.encode())
    gram = np.unique(np.array([g for x in names for g in model[x]], dtype=np.uint32))
    ranks = np.full((len(gram), len(names)), -1, np.int32)
    for j, x in enumerate(names):
        ranks[np.searchsorted(gram, np.array(model[x], dtype=np.uint32)), j] = np.arange(len(model[x]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            for a, texts in _texts(batch.column(1)):
                found, at = grams(texts)
                for i in range(len(texts) if names else 0):
                    if at[i + 1] > at[i]:
                        own = ranking(found[at[i] : at[i + 1]], length)
                        away = distances(own, gram, ranks, length)
                        j = int(np.argmin(away))
                        best[a + i], score[a + i] = names[j], 1 - away[j] / (length * len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score)], names=[key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def tagged(docs: DataFrame, model: dict[str, list[int]], text: str = "text") -> DataFrame:
    """All rows and columns of docs, and a struct `language` (lang_pred, score) as the last; its name gets underscores if docs has one."""
    (out,) = fresh(docs, "language")
    whole = docs.select(F.struct(*docs.columns).alias("row"), text)
    rows = predict(whole.withColumnRenamed(text, "text"), model, key="row")
    return rows.select("row.*", F.struct("lang_pred", "score").alias(out))
