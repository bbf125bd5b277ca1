"""Toxicity by a support vector machine on a subsequence string kernel with Nystrom landmarks.

Strings are tokens: runs without white space, and runs of single letters set apart by spaces. The
kernel of two tokens sums over the letter triples both hold in order, each with DECAY to the power
of the stretch it spans, so letters may be left out or put between; marks between letters don't
count, and some digits stand for letters. Each token is divided by the norm of its
triples, and the kernel sharpened to exp(SHARP * (k - 1)), so near misses count little. Nystrom
features are the kernel against landmark tokens, whitened; a linear machine on them is folded back
into one weight per landmark, which is what scores tokens.

A sentence's margin is that of its worst token, a text's that of its worst sentence; a logistic curve
over it and the number and part of tokens over SURE makes the score. The machine is trained on sentences with their text's label, in rounds:
of a toxic text the sentence with the worst token counts, of the others every sentence's worst.

Defined cases: null and empty texts, and texts without a letter triple, get the margin EMPTY, the least there is.
Tokens over LONG bytes are read in overlapping windows, so nothing is left out. A key's texts train once
(the least of them); of a text over TRAIN_BYTES a window trains, its place chosen by a hash. Without toxic
rows to learn from, every score is 0. Repeated rows get equal scores; label rows that repeat a key and
label count once; a null label counts as not toxic. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hirelake.llm import text as tx
from hirelake.llm.shared import fresh

DECAY = 0.6
#: Letters of a triple lie within so many bytes of the first.
REACH = 7
LONG, STRIDE = 24, 12
LANDMARKS = 96
#: The kernel is sharpened to exp(SHARP * (k - 1)).
SHARP = 5.0
#: Labelled texts of each label that train, and the length of what of them trains.
TRAIN_ROWS, TRAIN_BYTES = 2500, 20_000
ROUNDS = 2
SURE = 0.25
EMPTY = -5.0
THRESHOLD = 0.3
_SIDE = 32
_DIM = _SIDE**3

#: Code of each byte: letters 1 to 26 (both cases), other marks 27, bytes of other scripts 28 to 31.
_CODES = np.full(256, 27, np.uint8)
_CODES[0x41:0x5B] = _CODES[0x61:0x7B] = np.arange(1, 27)
_CODES[0x80:] = 28 + (np.arange(0x80, 0x100) & 3)
for _mark, _letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.items():
    _CODES[ord(_mark)] = ord(_letter) - 96
_MARK = 27

_STEPS = [(a, b) for a in range(1, REACH) for b in range(1, REACH - a + 1)]


def _matrices(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of codes without marks, padded with 0, for tokens of like length, and which token each row is of."""
    codes_of = _CODES[raw]
    kept = codes_of != _MARK
    place = np.concatenate([[0], np.cumsum(kept)])
    packed, start, end = codes_of[kept], place[start], place[end]
    n = end - start
    extra = np.maximum(0, -(-(n - LONG) // STRIDE))
    which = np.repeat(np.arange(len(n)), extra + 1)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
    first = start[which] + turn * STRIDE
    length = np.minimum(end[which] - first, LONG)
    low = 2
    for high in (5, 7, 9, 12, 16, LONG):
        mine = np.flatnonzero((length > low) & (length <= high))
        low = high
        for k in range(0, len(mine), 1 << 15):
            own = mine[k : k + (1 << 15)]
            at = np.arange(high)
            inside = at < length[own][:, None]
            codes = np.where(inside, packed[np.minimum(first[own][:, None] + at, len(packed) - 1)], 0)
            yield codes.astype(np.int32), which[own]


def _triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Number of each triple, whether it counts, and its weight, for each pair of steps."""
    wide, part = codes.shape[1], codes > 0
    for a, b in _STEPS:
        if a + b < wide:
            x, y, z = slice(0, wide - a - b), slice(a, wide - b), slice(a + b, wide)
            yield (codes[:, x] * _SIDE + codes[:, y]) * _SIDE + codes[:, z], part[:, x] & part[:, y] & part[:, z], DECAY ** (a + b)


@dataclass
class Machine:
    """triples: of which triple which row of landmarks is; landmarks: their vectors by triple; alpha: weight of each."""

    triples: np.ndarray
    landmarks: np.ndarray
    alpha: np.ndarray
    bias: float = 0.0

    @classmethod
    def of(cls, landmarks: list[str]) -> Machine:
        base = vectors(landmarks)
        columns = np.flatnonzero(base.any(axis=0))
        triples = np.full(_DIM, len(columns), np.int32)
        triples[columns] = np.arange(len(columns))
        table = np.concatenate([base[:, columns].T, np.zeros((1, len(base)), np.float32)])
        return cls(triples, np.ascontiguousarray(table, np.float32), np.zeros(len(base), np.float32))

    def _kernels(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Kernels of windows against the landmarks, and the token of each window."""
        nothing = len(self.landmarks) - 1
        for codes, which in _matrices(raw, start, end):
            total, norm = np.zeros((len(codes), self.landmarks.shape[1]), np.float32), np.zeros(len(codes), np.float32)
            for number, counts, weight in _triples(codes):
                norm += weight * weight * counts.sum(axis=1)
                row = np.where(counts, self.triples[number], nothing)
                for k in range(row.shape[1]):
                    some = np.flatnonzero(row[:, k] != nothing)
                    total[some] += weight * self.landmarks[row[some, k]]
            some = norm > 0
            near = total[some] / np.sqrt(norm[some])[:, None]
            yield np.exp(SHARP * np.minimum(near - 1, 0)), which[some]

    def features(self, tokens: list[str]) -> np.ndarray:
        """Kernels of short tokens; of a longer one, its windows' largest."""
        raw, offsets = tx.buffers(pa.array(tokens, pa.large_string()))
        out = np.zeros((len(tokens), self.landmarks.shape[1]), np.float32)
        for near, which in self._kernels(raw, offsets[:-1], offsets[1:]):
            np.maximum.at(out, which, near)
        return out

    def margins(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The margin of each token; of a long token, its worst window's. Without a triple: EMPTY."""
        out = np.full(len(start), EMPTY, np.float32)
        for near, which in self._kernels(raw, start, end):
            np.maximum.at(out, which, near @ self.alpha + np.float32(self.bias))
        return out


def vectors(tokens: list[str]) -> np.ndarray:
    """Triple vectors of a few tokens, divided by their norms, as dense rows."""
    raw, offsets = tx.buffers(pa.array(tokens, pa.large_string()))
    out, norms = np.zeros((len(tokens), _DIM), np.float32), np.zeros(len(tokens))
    for codes, which in _matrices(raw, offsets[:-1], offsets[1:]):
        for number, counts, weight in _triples(codes):
            norms += weight * weight * np.bincount(which, counts.sum(axis=1), len(tokens))
            np.add.at(out, (np.broadcast_to(which[:, None], number.shape)[counts], number[counts]), weight)
    return out / np.sqrt(np.maximum(norms, 1e-9)).astype(np.float32)[:, None]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, shrink: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], shrink)
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + (ridge * w * w).sum())

    for _ in range(60):
        active = y * (x @ w) < 1
        xa = x[active] * weight[active, None]
        step = np.linalg.solve(xa.T @ x[active] + np.diag(ridge), xa.T @ y[active]) - w
        while loss(w + step) > loss(w) and abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """A text's score is the logistic of its summary times the slopes."""

    machine: Machine
    slopes: np.ndarray

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.slopes, -30, 30)))


def summaries(worst: np.ndarray, hits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Of each text: the worst margin, how many tokens are over SURE, how many of all, and 1."""
    return np.stack([np.maximum(worst, -1), np.log1p(hits), np.sqrt(hits / np.maximum(tokens, 1)), np.ones(len(worst))], axis=1)


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each token; runs of three or more single bytes are tokens too."""
    start, end, row = tx.words(raw, offsets, tx.SPACE_WORDS)
    single = end - start == 1
    if len(start) > 2 and single.any():
        joined = np.append(False, single[1:] & single[:-1] & (row[1:] == row[:-1]) & (start[1:] - end[:-1] <= 2))
        run = np.cumsum(~joined)
        first = np.flatnonzero(~joined)
        size = np.bincount(run - 1)
        long = np.flatnonzero(size >= 3)
        a, b = first[long], first[long] + size[long] - 1
        start, end, row = (np.append(x, y) for x, y in ((start, start[a]), (end, end[b]), (row, row[a])))
    return start, end, row


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, shrink: float = 0.05) -> np.ndarray:
    """Slopes of a weighted logistic fit, by damped Newton steps; the last is the level."""
    ridge = np.full(x.shape[1], shrink)
    ridge[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * w * w).sum())

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - 2 * ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(2 * ridge), g)
        while loss(w + step) > loss(w) and abs(step).max() > 1e-8:
            step = step / 2
        w = w + step
        if abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], toxic: np.ndarray, share: float, n_landmarks: int = LANDMARKS) -> Model | None:
    """The model from some texts and their labels; share: of toxic rows among all labelled ones."""
    if not toxic.any():
        return None
    words: dict[str, str] = {}  # one object for each word, however often it occurs
    sentences = [[[words.setdefault(w, w) for w in s.lower().split()] for s in re.split(r"[.!?\n]", t) if s.strip()] for t in texts]
    bad, good = Counter(), Counter()
    for parts, label in zip(sentences, toxic, strict=True):
        (bad if label else good).update(set().union(*parts))
    n_bad, n_good = int(toxic.sum()), max(1, int((~toxic).sum()))
    every = sorted(set(bad) | set(good))
    place = {w: i for i, w in enumerate(every)}
    odds = np.array([np.log((bad[w] + 0.1) / n_bad) - np.log((good[w] + 0.1) / n_good) for w in every])
    ranked = sorted((w for w in bad if len(w) > 2 and bad[w] > 1), key=lambda w: (-odds[place[w]] * bad[w] ** 0.5, w))[: n_landmarks * 4]
    common = [w for w, _ in sorted(good.items(), key=lambda x: (-x[1], x[0])) if len(w) > 2 and odds[place[w]] < 1]
    own = vectors(ranked)
    near = own @ own.T
    del own
    telling: list[int] = []
    for i in range(len(ranked)):  # each unlike the ones before it
        if len(telling) < n_landmarks * 2 // 3 and (not telling or near[i, telling].max() < 0.8):
            telling.append(i)
    machine = Machine.of([*(ranked[i] for i in telling), *common[: n_landmarks - len(telling)]])
    of_marks = machine.features([*(ranked[i] for i in telling), *common[: n_landmarks - len(telling)]]).astype(np.float64)
    values, basis = np.linalg.eigh((of_marks + of_marks.T) / 2)
    keep = values > 1e-2 * values.max()
    white = basis[:, keep] / np.sqrt(values[keep])

    # the sentences as runs of token numbers, and the texts as runs of sentences
    flat = np.array([place[w] for x in sentences for s in x for w in s], np.int64)
    lengths = np.array([len(s) for x in sentences for s in x], np.int64)
    starts, owner = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(texts)), [len(x) for x in sentences])
    raw, offsets = tx.buffers(pa.array(every, pa.large_string()))
    n_bad_of, n_good_of = (np.array([c[w] for w in every]) for c in (bad, good))
    found = odds

    def worst_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The worst token of each sentence, and its rank."""
        order = np.lexsort((np.arange(len(found)), found))
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found))
        top = np.maximum.reduceat(rank[flat], starts)
        return order[top], top

    # tokens that toxic texts hold far more often count from the first round to the last
    known = np.flatnonzero((n_bad_of >= 3) & (n_bad_of * n_good > 20 * (n_good_of + 0.5) * n_bad))
    for _ in range(ROUNDS):
        worst, top = worst_of(found)
        best = np.full(len(texts), -1)
        np.maximum.at(best, owner, top)
        chosen = worst[toxic[owner] & (top == best[owner])]
        witness, votes = np.unique(chosen, return_counts=True)
        fits = (n_good_of[witness] == 0) | (n_bad_of[witness] * n_good > 3 * n_good_of[witness] * n_bad)
        votes = np.bincount(np.append(witness[fits], known), np.append(votes[fits], n_bad_of[known]), len(every))
        witness = np.flatnonzero(votes)
        votes = votes[witness]
        other = np.unique(worst[~toxic[owner]])
        hard = other[np.argsort(-found[other], kind="stable")[:1500]]
        rest = sorted(other.tolist(), key=lambda i: (zlib.crc32(every[i].encode()), i))[:1000]
        against = np.setdiff1d(np.unique(np.concatenate([hard, np.array(rest, np.int64), [place[w] for w in common[:300]]])).astype(np.int64), witness)
        y = np.append(np.ones(len(witness)), -np.ones(len(against)))
        weight = np.append(votes**0.5, np.maximum(n_good_of[against], 1) ** 0.5)
        weight[y > 0] *= weight[y < 0].sum() / weight[y > 0].sum()
        w = svm(machine.features([every[i] for i in [*witness.tolist(), *against.tolist()]]) @ white, y, weight)
        machine.alpha, machine.bias = (white @ w[:-1]).astype(np.float32), float(w[-1])
        found = machine.margins(raw, offsets[:-1], offsets[1:])
    whole = np.full(len(texts), EMPTY)
    worst, _ = worst_of(found)
    np.maximum.at(whole, owner, found[worst])
    text_of = np.repeat(owner, lengths)
    hits, n_tokens = (np.bincount(text_of, x, len(texts)) for x in (found[flat] > SURE, np.ones(len(flat))))
    balance = np.where(toxic, share / n_bad, (1 - share) / n_good) * len(texts)
    return Model(machine, _logistic(summaries(whole, hits, n_tokens), toxic.astype(float), balance))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4 == 2


def train(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES
) -> Model | None:
    """The model, from at most `rows` texts of each label, chosen by a hash, none of them held out."""
    own = labels.where(~held_out(key) & F.col(key).isNotNull()).select(F.col(key).alias("k"), (F.coalesce(F.col(label), F.lit(0)) == 1).alias("y"))
    counts = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("k")
    sample = own.where("y").orderBy(order, "k").limit(rows).unionByName(own.where("not y").orderBy(order, "k").limit(rows))
    texts = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    once = texts.join(F.broadcast(sample.distinct()), "k").groupBy("k", "y").agg(F.min("t").alias("t"))
    begin = F.pmod(F.xxhash64("k"), F.greatest(F.length("t") - most_bytes + 1, F.lit(1))) + 1
    window = F.when(F.length("t") > most_bytes, F.substr("t", begin.cast("int"), F.lit(most_bytes))).otherwise(F.col("t"))
    found = once.select(window.alias("t"), "y").collect()  # bounded by rows and most_bytes
    found.sort(key=lambda r: (r.y, r.t))
    share = counts.get(True, 0) / max(1, sum(counts.values()))
    return fit([r.t for r in found], np.array([r.y for r in found], bool), share)


def score(documents: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """All columns, with the score of each whole text under the name; an own column of that name is replaced."""
    given = documents.drop(name)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known, value = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            raw, offsets = tx.buffers(batch.column(text))
            for first, last in tx.slices(offsets) if m is not None else ():
                own = offsets[first : last + 1] - offsets[first]
                part = tx.LOWER[raw[offsets[first] : offsets[last]]]
                start, end, row = spans(part, own)
                hashes, at, inverse = np.unique(tx.word_hashes(part, start, end), return_index=True, return_inverse=True)
                margin = np.zeros(len(hashes), np.float32)
                place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                seen = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
                margin[seen] = value[place[seen]]
                fresh = np.flatnonzero(~seen)
                margin[fresh] = m.machine.margins(part, start[at[fresh]], end[at[fresh]])
                if len(known) < 1 << 19:
                    order = np.argsort(both := np.concatenate([known, hashes[fresh]]))
                    known, value = both[order], np.concatenate([value, margin[fresh]])[order]
                worst = np.full(last - first, EMPTY, np.float32)
                own_margin = margin[inverse]
                np.maximum.at(worst, row, own_margin)
                hits, n_tokens = (np.bincount(row, x, last - first) for x in (own_margin > SURE, np.ones(len(row))))
                out[first:last] = m.score(summaries(worst, hits, n_tokens))
            arrays = [*(batch.column(n) for n in batch.schema.names), pa.array(out, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, name])

    return given.mapInArrow(run, StructType([*given.schema.fields, StructField(name, DoubleType())]))


def clean(documents: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores under the threshold, with their columns."""
    name = fresh(documents, "toxicity")[0]
    return score(documents, model, text, name).where(F.col(name) < threshold).drop(name)
