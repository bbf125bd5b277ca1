"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

Every token of a text is tagged as outside, begin or inside of a secret; a line is one chain. Tokens
are runs without white space, quotes, brackets and the signs , ; | = : (trailing . ! ? and the like
are cut). Features are the token's shape, the two words before and the one after, the signs beside
it, and the whole text's length, code signs and equals signs. Viterbi decodes the chains. A token
whose outside score is ahead by more than any transition can make good is outside in every best
path (`undecided`), so the chain is decoded only in the runs between such tokens, with the same result.

The field learns from lines of all documents: lines with a match of the patterns (the value is the
secret; in some copies the keyword gives way to another word), lines with digits but no match,
plain lines, and lines in which a generator has planted carriers: secrets of kinds that the
patterns don't know behind many cues, and look-alikes (numbers, addresses, names, times) that are
outside. How many lines of each sort train is bounded by TRAIN_LINES, chosen by a hash.

Defined cases: a null or empty text has no spans. A table without any text trains no field, and
nothing is added. Spans of the field stand beside those of the patterns where both see one, unless
start and end are the same. Positions are code points. Repeated rows each get their own row. `scan` replaces an own
column with the name of its result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from hirelake.llm import text as tx
from hirelake.llm.shared import discard, written

#: Fixed values of the contract: kind, pattern, least length (of group 2 for assign).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
ADDED = "field"

#: Lines of each sort that train the field, at most, and tokens of each.
TRAIN_LINES, TRAIN_TOKENS = 1500, 32
#: Characters of a line that trains, at most.
TRAIN_CHARS = 8192
#: Plain lines come from about so many documents.
TRAIN_DOCUMENTS = 4000
BEGIN, INSIDE, OUTSIDE = range(3)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


# Tokens and their features, for all texts of a slice at once.

_TOKEN = np.ones(256, bool)
_TOKEN[[*b" \t\n\v\f\r\"'`<>(){}[],;|=:"]] = False
_TRAIL = np.zeros(256, bool)
_TRAIL[[*b".!?*#$%&~"]] = True
_DIGIT, _UPPER, _LOWER, _VOWEL, _HEX = (np.zeros(256, bool) for _ in range(5))
_DIGIT[0x30:0x3A] = _UPPER[0x41:0x5B] = _LOWER[0x61:0x7B] = True
_VOWEL[[*b"aeiouyAEIOUY"]] = True
_HEX[[*b"0123456789abcdef"]] = True
#: Class of each byte for counting turns: digit, small, capital, other.
_CLASS = np.where(_DIGIT, 0, np.where(_LOWER, 1, np.where(_UPPER, 2, 3))).astype(np.int8)
_CLASS[0x80:] = 1
_QUOTE = [*b"\"'`"]
_WORDS = 1 << 13


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each token, without trailing marks."""
    start, end, row = tx.words(raw, offsets, _TOKEN)
    if len(start):
        last = np.maximum.accumulate(np.where(_TRAIL[raw], -1, np.arange(len(raw))))[end - 1] + 1
        end = np.where(last > start, last, end)
    return start, end, row


def _before(x: np.ndarray, empty: int = 0) -> np.ndarray:
    return np.append(np.array([empty], x.dtype), x[:-1]) if len(x) else x


def _sums(flag: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])


def file_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One number for each text: its length, signs of code, and equals signs."""
    n = np.diff(offsets)
    code, equal = (_sums(np.isin(raw, x)) for x in ([*b"{};"], [*b"="]))
    many = [x[offsets[1:]] - x[offsets[:-1]] for x in (code, equal)]
    size = np.minimum(np.log2(n + 1).astype(np.int64) // 2, 9)
    return (size * 2 + (many[0] > 0)) * 4 + np.minimum(many[1], 3)


def features(raw: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, file: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each token, as columns, and where a chain begins."""
    counts = [_sums(x[raw]) for x in (_DIGIT, _UPPER, _LOWER, _VOWEL, _HEX)]
    counts.append(_sums(raw >= 0x80))
    kind = _CLASS[raw]
    counts.append(_sums(np.append(False, kind[1:] != kind[:-1]) if len(raw) else np.zeros(0, bool)))
    d, u, low, v, h, far = (c[end] - c[start] for c in counts[:-1])
    turns = counts[-1][end] - counts[-1][np.minimum(start + 1, end)]
    n = end - start
    signs = n - d - u - low - far
    lines = _sums(raw == 0x0A)
    new = np.append(True, (row[1:] != row[:-1]) | (lines[start[1:]] > lines[end[:-1]])) if len(start) else np.zeros(0, bool)
    begin = np.maximum(np.maximum.accumulate(np.where(raw == 0x0A, np.arange(1, len(raw) + 1), 0))[start], offsets[row])  # of the line
    gap = np.where(new, begin, _before(end))
    equal, colon, quotes = (_sums(raw == x) for x in b'=:"')
    sep = (equal[start] > equal[gap]) * 1 + (colon[start] > colon[gap]) * 2
    left = np.where(start > offsets[row], raw[np.maximum(start - 1, 0)], 0)
    right = np.where(end < offsets[row + 1], raw[np.minimum(end, len(raw) - 1)], 0) if len(start) else end
    quoted = np.isin(left, _QUOTE).astype(np.int64)
    open_ = (quotes[start] - quotes[begin]) & 1
    mask = (d > 0) + 2 * (u > 0) + 4 * (low > 0) + 8 * (far > 0) + 16 * (signs > 0)
    has = [_sums(raw == x) for x in b"@./-_"]
    marks = sum((((c[end] - c[start]) > 0) << k) for k, c in enumerate(has))
    inner = np.minimum(turns, 15)
    short = np.minimum(n // 4, 10)
    word = tx.word_hashes(tx.LOWER[raw], start, end)
    one = np.where(new, np.uint64(1), _before(word))
    two = np.where(new | _before(new, 1), np.uint64(2), _before(one))
    last = np.append(new[1:], True) if len(new) else new
    after = np.where(last, np.uint64(3), np.append(word[1:], np.uint64(0))) if len(word) else word
    prefix = tx.word_hashes(raw, start, np.minimum(start + 4, end))
    letters = np.maximum(u + low, 1)
    vowels = v * 8 // letters
    plain = (d == 0) & (signs == 0) & (far == 0)
    capital = np.minimum(u - (_UPPER[raw[start]] if len(start) else 0), 3) * 2 + (u == letters)

    def hashed(x: np.ndarray, salt: int) -> np.ndarray:
        return (tx.mix(x ^ np.uint64(salt)) % np.uint64(_WORDS)).astype(np.int64)

    small = [
        (np.minimum(n, 40), 41),
        (mask, 32),
        (inner, 16),
        (mask * 11 + short, 352),
        ((vowels * 2 + plain) * 11 + short, 198),
        (d * 8 // n * 11 + short, 99),
        (sep * 2 + quoted, 8),
        ((open_ * 2 + (sep > 0)) * 2 + quoted, 8),
        ((sep * 2 + quoted) * 32 + mask, 256),
        ((sep * 2 + quoted) * 11 + short, 88),
        (left, 256),
        (right, 256),
        ((h == n) * 11 + short, 22),
        (marks * 2 + (d > 0), 64),
        (marks * 16 + inner, 512),
        (inner * 11 + short, 176),
        (capital * 16 + inner, 128),
        (file[row], 80),
        (np.zeros(len(n), np.int64), 1),
    ]
    words = [
        hashed(one, 0x11), hashed(two, 0x22), hashed(after, 0x33), hashed(prefix, 0x44),
        hashed(one + sep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0x55), hashed(one + mask.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9), 0x66),
    ]
    out, base = [], 0
    for x, size in [*small, *((w, _WORDS) for w in words)]:
        out.append(x.astype(np.int32) + np.int32(base))
        base += size
    return np.stack(out) if len(start) else np.zeros((len(out), 0), np.int32), new


SPACE = 41 + 32 + 16 + 352 + 198 + 99 + 8 + 8 + 256 + 88 + 256 + 256 + 22 + 64 + 512 + 176 + 128 + 80 + 1 + 6 * _WORDS
_NEVER = -1e9


class Field:
    """A linear-chain conditional random field over begin, inside and outside."""

    def __init__(self) -> None:
        self.weights = np.zeros((SPACE, 3), np.float32)
        self.moves = np.zeros((3, 3), np.float32)
        self.start = np.zeros(3, np.float32)

    def moved(self) -> np.ndarray:
        moves = self.moves.astype(np.float64)
        moves[OUTSIDE, INSIDE] = _NEVER  # inside follows begin or inside only
        return moves

    def scores(self, x: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Scores of the tags of each token; x: its features, as columns."""
        out = np.zeros((x.shape[1], 3), np.float32)
        for column in x:
            out += self.weights[column]
        out = out.astype(np.float64)
        out[new] += self.start
        out[new, INSIDE] = _NEVER
        return out

    def fit(self, x: np.ndarray, new: np.ndarray, tags: np.ndarray, rounds: int = 14, rate: float = 0.25, shrink: float = 2e-5, part: int = 256) -> Field:
        """Gradient steps on the log likelihood of parts of the chains, with a rate of its own for each weight."""
        first = np.flatnonzero(new)
        lengths = np.diff(np.append(first, len(new)))
        past, past_moves, past_start = np.full((SPACE, 3), 1e-4, np.float32), np.full((3, 3), 1e-4), np.full(3, 1e-4)
        order = np.random.default_rng(7)
        for _ in range(rounds):
            mixed = order.permutation(len(first))
            for low in range(0, len(first), part):
                own = mixed[low : low + part]
                own = own[np.argsort(-lengths[own], kind="stable")]
                n = lengths[own]
                wide = int(n[0])
                at = first[own][:, None] + np.minimum(np.arange(wide), n[:, None] - 1)
                live = np.arange(wide) < n[:, None]
                feature, tag = x[:, at], tags[at]
                e = np.zeros((len(own), wide, 3))
                for column in feature:
                    e += self.weights[column]
                e[:, 0] += self.start
                e[:, 0, INSIDE] = _NEVER
                moves = self.moved()
                ahead, back = np.zeros_like(e), np.zeros_like(e)
                ahead[:, 0] = e[:, 0]
                for i in range(1, wide):
                    ahead[:, i] = e[:, i] + np.logaddexp.reduce(ahead[:, i - 1, :, None] + moves, axis=1)
                for i in range(wide - 2, -1, -1):
                    step = np.logaddexp.reduce(moves + (e[:, i + 1] + back[:, i + 1])[:, None, :], axis=2)
                    back[:, i] = np.where((i + 1 < n)[:, None], step, 0)
                total = np.logaddexp.reduce(np.take_along_axis(ahead, (n - 1)[:, None, None], axis=1)[:, 0], axis=1)
                grad = -np.exp(ahead + back - total[:, None, None])
                np.put_along_axis(grad, tag[..., None], np.take_along_axis(grad, tag[..., None], axis=2) + 1, axis=2)
                grad *= live[..., None]
                flat = feature.reshape(len(feature), -1)
                for t in range(3):
                    g = np.bincount(flat.ravel(), np.tile(grad[..., t].ravel(), len(flat)), SPACE).astype(np.float32)
                    g -= shrink * self.weights[:, t] * (g != 0)
                    past[:, t] += g * g
                    self.weights[:, t] += rate * g / np.sqrt(past[:, t])
                g = grad[:, 0].sum(axis=0)
                past_start += g * g
                self.start += (rate * g / np.sqrt(past_start)).astype(np.float32)
                g = np.zeros((3, 3))
                for i in range(1, wide):
                    some = i < n
                    g -= np.exp(ahead[some, i - 1, :, None] + moves + (e[some, i] + back[some, i])[:, None, :] - total[some, None, None]).sum(axis=0)
                    np.add.at(g, (tag[some, i - 1], tag[some, i]), 1)
                past_moves += g * g
                self.moves += (rate * g / np.sqrt(past_moves)).astype(np.float32)
        return self

    def decode(self, e: np.ndarray, left: bool = False, right: bool = False) -> list[int]:
        """The likeliest tags of one chain, by Viterbi; left, right: whether an outside token stands before, behind."""
        moves = self.moved()
        best, back = e[0] + (moves[OUTSIDE] if left else 0), []
        for own in e[1:]:
            each = best[:, None] + moves
            back.append(each.argmax(axis=0))
            best = each.max(axis=0) + own
        if right:
            best = best + moves[:, OUTSIDE]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def undecided(self, e: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Tokens that may be begin or inside on a best path; all others are outside on every one.

        `ahead` bounds what a token gains over outside, with the moves beside it. A secret without a
        token of a gain not below zero loses against outside, and so does its end behind the last
        such token. Tokens before such a one stay only if what they lose is less than what that one
        loses as a begin instead of inside.
        """
        m = self.moved()
        most = max(0.0, m[m > _NEVER / 2].max() - m[OUTSIDE, OUTSIDE])
        edges = max(0.0, m[OUTSIDE, OUTSIDE] - m[:, OUTSIDE].min()) + max(0.0, m[OUTSIDE, OUTSIDE] - m[OUTSIDE, BEGIN])
        ahead = e[:, :OUTSIDE].max(axis=1) - e[:, OUTSIDE] + 2 * most + edges
        hard = ahead >= 0
        open_ = hard.copy()
        at = np.flatnonzero(hard)
        budget = e[at, INSIDE] - e[at, BEGIN] + max(0.0, (m[INSIDE] - m[BEGIN]).max())
        while len(at):
            keep = ~new[at]
            at, budget = at[keep] - 1, budget[keep]
            budget = budget + ahead[at]
            keep = ~hard[at] & (budget >= 0)
            at, budget = at[keep], budget[keep]
            open_[at] = True
        return open_

    def tags(self, x: np.ndarray, new: np.ndarray) -> np.ndarray:
        """The tags of all tokens."""
        e = self.scores(x, new)
        out = np.full(len(e), OUTSIDE)
        if not len(e):
            return out
        open_ = np.flatnonzero(self.undecided(e, new))
        if not len(open_):
            return out
        cut = np.flatnonzero(np.append(True, (open_[1:] != open_[:-1] + 1) | new[open_[1:]]))
        for a, b in zip(open_[cut].tolist(), (open_[np.append(cut[1:], len(open_)) - 1] + 1).tolist(), strict=True):
            out[a:b] = self.decode(e[a:b], left=not new[a], right=b < len(new) and not new[b])
        return out


def field_spans(raw: np.ndarray, offsets: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (in bytes of the slice) of the spans that the field finds."""
    start, end, row = tokens(raw, offsets)
    tag = field.tags(*features(raw, offsets, start, end, row, file_features(raw, offsets)))
    first = np.flatnonzero(tag == BEGIN)
    stop = np.flatnonzero(np.append(tag[1:] != INSIDE, True)) if len(tag) else first
    last = stop[np.searchsorted(stop, first)]
    return row[first], start[first], end[last]


# Training: lines of the corpus, and carriers that a generator plants in them.

_RANDOM = string.ascii_letters + string.digits
#: What stands before a secret; {} is its place.
CUES = [
    "password {}", "password is {}", "pwd = {}", "pwd: {}", "pass={}", "passphrase: {}", "my token is {}", "token {}", "bearer {}", "Authorization: Bearer {}",
    "Authorization: Basic {}", "secret key {}", "aws_secret_access_key = {}", "client_secret={}", "private key {}", "access key: {}", "auth = {}", "credential {}",
    "credentials: {}", "login with {}", "api key {}", "API-Key {}", "x-api-key {}", "key = {}", "sshpass -p {}", "connection string {}", "pin code {}", "{}",
]
#: The same cues where no secret follows.
CALM = [
    "the password is incorrect", "password required", "forgot your password ?", "a secret garden", "the secret is out", "token ring network", "token count = 512", "token : none",
    "key: value", "key = null", "the key is under the mat", "api key documentation", "bearer of news", "login with your account", "auth = true", "passphrase: optional", "pwd = None",
    "credentials: see above", "private key management", "access key: not set", "secret = {name}", "pass={num}", "token is {num}", "key: {name}",
]


def _text_of(r: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(r.choice(letters) for _ in range(r.randint(low, high)))


def _word(r: random.Random, low: int = 3, high: int = 8) -> str:
    return "".join(r.choice("bcdfghklmnprstvw" if k % 2 else "aeiou") for k in range(r.randint(low, high)))


#: Kinds of generated secrets; `weak` ones look like words or short mixes and are planted behind cues only.
SECRETS = {
    "mixed": lambda r: _text_of(r, _RANDOM, 16, 48),
    "prefixed": lambda r: r.choice(["ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "sk-", "npm_", "pypi-", "SG.", "rk_", "hf_"]) + _text_of(r, _RANDOM, 20, 40),
    "slashed": lambda r: _text_of(r, _RANDOM + "+/", 32, 44),
    "jwt": lambda r: ".".join(["eyJ" + _text_of(r, _RANDOM, 14, 30), "eyJ" + _text_of(r, _RANDOM + "-_", 20, 50), _text_of(r, _RANDOM + "-_", 20, 43)]),
    "basic": lambda r: base64.b64encode((_word(r) + ":" + _text_of(r, _RANDOM, 8, 14)).encode()).decode().rstrip("="),
    "dashed": lambda r: "-".join(_text_of(r, string.ascii_uppercase + string.digits, 5, 5) for _ in range(r.randint(3, 5))),
    "short": lambda r: _text_of(r, _RANDOM, 9, 15),
    "letters": lambda r: _text_of(r, string.ascii_letters, 14, 32),
    "small": lambda r: _text_of(r, string.ascii_lowercase, 14, 28),
    "signed": lambda r: _word(r).capitalize() + r.choice("!@#$%&*^") + _text_of(r, _RANDOM + "!@#$%^&*", 5, 10) + str(r.randint(0, 99)),
    "changed": lambda r: re.sub("[aeio]", lambda m: r.choice([m[0], *"@310!"]), _word(r, 5, 9)) + r.choice("!@#$%&*^") + _word(r) + r.choice("#$!_") + str(r.randint(0, 999)),
    "worded": lambda r: _word(r) + str(r.randint(0, 999)) + _word(r) + r.choice(["", str(r.randint(0, 99)), "!"]),
    "phrase": lambda r: '"' + " ".join(_word(r) for _ in range(r.randint(3, 6))) + '"',
}
WEAK = {"short", "small", "signed", "changed", "worded", "phrase", "basic"}

#: Look-alikes that are no secrets.
OTHERS = [
    lambda r: str(r.randint(0, 10 ** r.randint(2, 17))),
    lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)),
    lambda r: f"{_word(r)}.{r.randint(0, 99)}@{_word(r)}.example.com",
    lambda r: f"+{r.randint(1, 99)} ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}",
    lambda r: f"https://www.{_word(r)}.com/{_word(r)}/{_word(r)}-{r.randint(1, 99999)}?id={r.randint(1, 10**6)}",
    lambda r: f"{r.choice(['http', 'https', 'ftp'])}://{_word(r, 1, 9)}.{r.choice(['com', 'org', 'de', 'io'])}/" + "/".join(_word(r, 1, 6) + r.choice(["", str(r.randint(1, 999)), "-1"]) for _ in range(r.randint(0, 3))) + r.choice(["", "?x=4", "#top", "/"]),
    lambda r: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:00Z",
    lambda r: "".join(_word(r).capitalize() for _ in range(r.randint(2, 4))) + r.choice(["", "", "_v2", "2", "()"]),
    lambda r: _word(r) + "".join(_word(r).capitalize() for _ in range(r.randint(1, 3))) + r.choice(["", "", "3", ".get"]),
    lambda r: f"{_word(r)}_{_word(r)}{r.randint(1, 99)}",
    lambda r: "_".join(_word(r) for _ in range(r.randint(2, 4))),
    lambda r: "-".join(_word(r) for _ in range(r.randint(2, 5))),
    lambda r: f"/{_word(r)}/{_word(r)}/{_word(r)}_{r.randint(1, 99)}.{r.choice(['py', 'txt', 'json', 'html'])}",
    lambda r: f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}-rc{r.randint(0, 9)}",
    lambda r: _word(r, 9, 16).upper(),
    lambda r: _word(r, 9, 18) + r.choice(["!!", "***", "%%%", "."]),
    lambda r: f"{_word(r)}.{_word(r, 3, 4)}",
    lambda r: f"{_word(r)},{_word(r, 3, 4)}",
    lambda r: f"{r.choice('$€')}{r.randint(1, 9999)}.{r.randint(10, 99)}",
    lambda r: f"{r.randint(1, 99)}{r.choice(['th', 'kg', 'px', 'GB', 'mm'])}",
]


def planted(line: str, r: random.Random, kinds: list[str]) -> tuple[str, tuple[int, int] | None]:
    """The line with a carrier in it, and where its secret is, if there is one."""
    places = [0, *(m.end() for m in re.finditer(r"\s", line))]
    at = r.choice(places)
    if r.random() < 0.35:
        kind = r.choice(OTHERS)(r)
        words = [x for x in line.split() if x.isalpha()] or [_word(r)]
        long = "".join(r.choice(words).lower() for _ in range(r.randint(2, 5)))  # a long word of the line's language
        carrier = r.choice([r.choice(CALM).format(name=_word(r), num=r.randint(1, 10**6)), kind, long])
        return f"{line[:at]}{carrier} {line[at:]}", None
    kind = r.choice([*kinds, "phrase"] if "phrase" in kinds else kinds)
    cue = r.choice(CUES[:-1] if kind in WEAK else CUES)
    if kind == "worded" and not cue.endswith(("= {}", ": {}", "={}", "is {}", "password {}", "-p {}", "token {}")):
        kind = "mixed" if "mixed" in kinds else kind
    value = SECRETS[kind](r)
    if kind == "phrase" and len(line.split()) > 2 and r.random() < 0.7:
        value = '"' + " ".join(r.choice(re.sub(r'"', " ", line).split() or [_word(r)]) for _ in range(r.randint(3, 6))) + '"'
    quote = r.choice(["", "", "", '"', "'"]) if kind != "phrase" else ""
    before, _, after = cue.partition("{}")
    if r.random() < 0.2:
        before = before.upper() if r.random() < 0.5 else before.capitalize()
    lead = line[:at] + before + quote
    s = len(lead) + (kind == "phrase")
    body = value.strip('"')
    return f"{lead}{value}{quote}{r.choice(['', '', '.', ',', ';'])} {after}{line[at:]}", (s, s + len(body))


def _window(line: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """So many tokens and characters of the line about its first span, or its first ones."""
    low, high = 0, len(line)
    if high > TRAIN_CHARS:  # tokens can have any length
        low = max(0, spans[0][0] - TRAIN_CHARS // 2) if spans else 0
        high = min(high, low + TRAIN_CHARS)
    at = [m.start() + low for m in re.finditer(r"\S+", line[low:high])]
    if len(at) > TRAIN_TOKENS:
        k = max(0, sum(a <= spans[0][0] for a in at) - TRAIN_TOKENS // 2) if spans else 0
        low = at[k]
        high = at[k + TRAIN_TOKENS] if k + TRAIN_TOKENS < len(at) else high
    return line[low:high], [(s - low, e - low) for s, e in spans if s >= low and e <= high]


_LINE = StructType([StructField(n, IntegerType()) for n in ("sort", "turn", "file")] + [StructField("line", StringType()), StructField("s", ArrayType(IntegerType())), StructField("e", ArrayType(IntegerType()))])
_LINE_ARROW = pa.schema({"sort": pa.int32(), "turn": pa.int32(), "file": pa.int32(), "line": pa.string(), "s": pa.list_(pa.int32()), "e": pa.list_(pa.int32())})
_MATCHED, _DIGITS, _PLAIN = range(3)


def _line(text: str, at: int) -> tuple[int, str]:
    """Where the line around a place begins, and the line."""
    low, high = text.rfind("\n", 0, at) + 1, text.find("\n", at)
    return low, text[low : len(text) if high < 0 else high]


def _lines_of(text: str, part: int) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
    """Sort, window and values of lines that may train; one pass over the values, line by line."""
    values = sorted({(at, end) for _, _, end, at in base_spans(text)})
    k = 0
    while k < len(values):
        low, line = _line(text, values[k][0])
        high = low + len(line)
        own: list[tuple[int, int]] = []  # values of the line, without those that overlap
        while k < len(values) and values[k][0] < high:
            a, b = values[k]
            if b <= high and (not own or a >= own[-1][1]):
                own.append((a, b))
            k += 1
        yield _MATCHED, *_window(line, [(a - low, b - low) for a, b in own])
    if zlib.crc32(text.encode()) % 1_000_000 < part:
        first, digit = re.search(r"\S", text), re.search("[0-9]", text)
        if first:
            line = _line(text, first.start())[1]
            if not base_spans(line):
                yield _PLAIN, *_window(line, [])
        if digit and not values:
            low, line = _line(text, digit.start())
            yield _DIGITS, _window(line, [(digit.start() - low, digit.end() - low)])[0], []


def _training_lines(part: int, most: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {k: [] for k in (_MATCHED, _DIGITS, _PLAIN)}
        for batch in batches:
            raw, offsets = tx.buffers(batch.column(0))
            file = file_features(raw, offsets).tolist()
            for text, number in zip(batch.column(0).to_pylist(), file, strict=True):
                for sort, line, spans in _lines_of(text, part) if text else ():
                    turn = -(zlib.crc32(line.encode()) >> 1)
                    item = (turn, line, number, tuple(spans))
                    if len(best[sort]) < most:
                        heapq.heappush(best[sort], item)
                    elif item > best[sort][0]:
                        heapq.heapreplace(best[sort], item)
        out = [(sort, -turn, number, line, [s for s, _ in x], [e for _, e in x]) for sort, every in best.items() for turn, line, number, x in every]
        yield pa.RecordBatch.from_pydict(dict(zip(_LINE_ARROW.names, zip(*out, strict=True), strict=True)) if out else {n: [] for n in _LINE_ARROW.names}, _LINE_ARROW)

    return lines


def examples(rows: list[tuple[int, int, str, list[tuple[int, int]]]], kinds: list[str], seed: int = 7) -> list[tuple[str, int, list[tuple[int, int]]]]:
    """Line, file feature and secrets of each training line. rows: sort, file, line, values."""
    r, out = random.Random(seed), []
    for sort, file, line, spans in rows:
        out.append((line, file, spans))
        if sort == _MATCHED and spans:
            a = spans[0][0]
            key = re.search(r"\S*\s*[:=]?\s*[\"']?$", line[:a])
            cue = r.choice(["pwd = ", "auth ", "bearer ", "", "", _word(r) + " "])
            change = key.start() + len(cue) - a
            out.append((line[: key.start()] + cue + line[a:], file, [(s + change, e + change) for s, e in spans]))
        elif sort != _MATCHED:
            for _ in range(2):
                more, span = planted(line, r, kinds)
                out.append((more, file, [span] if span else []))
    return out


def fit(rows: list[tuple[int, int, str, list[tuple[int, int]]]], kinds: list[str] | None = None) -> Field | None:
    """The field from training lines; kinds: of generated secrets, all if none are given."""
    if not rows:
        return None
    every = examples(rows, kinds or list(SECRETS))
    parts = [_tagged(every[k : k + 500]) for k in range(0, len(every), 500)]
    return Field().fit(np.concatenate([x for x, _, _ in parts], axis=1), *(np.concatenate([p[k] for p in parts]) for k in (1, 2)))


def _tagged(every: list[tuple[str, int, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, chain beginnings and tags of some training lines."""
    raw, offsets = tx.buffers(pa.array([line for line, _, _ in every], pa.large_string()))
    start, end, row = tokens(raw, offsets)
    x, new = features(raw, offsets, start, end, row, np.array([f for _, f, _ in every], np.int64))
    tags = np.full(len(start), OUTSIDE)
    first = np.searchsorted(row, np.arange(len(every) + 1))
    for k, (line, _, spans) in enumerate(every):
        for s, e in spans:
            low, high = (len(line[:p].encode()) + offsets[k] for p in (s, e))
            own = np.arange(first[k], first[k + 1])
            own = own[(start[own] < high) & (end[own] > low)]
            tags[own] = INSIDE
            tags[own[:1]] = BEGIN
    tags[new & (tags == INSIDE)] = BEGIN
    return x, new, tags


def train(documents: DataFrame, text: str = "text", most: int = TRAIN_LINES, documents_most: int = TRAIN_DOCUMENTS, kinds: list[str] | None = None) -> Field | None:
    """The field, from at most `most` lines of each sort: with a match, from every document; others from about `documents_most` documents, by a hash."""
    n = documents.count()
    part = 1_000_000 if n <= documents_most else max(1, documents_most * 1_000_000 // n)
    lines = written(documents.select(text).mapInArrow(_training_lines(part, most), _LINE), "lines")
    order = Window.partitionBy("sort").orderBy("turn", "line")
    each = lines.groupBy("sort", "line").agg(F.min(F.struct("turn", "file", "s", "e")).alias("r")).select("sort", "line", "r.*")
    first = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    rows = sorted(first.collect(), key=lambda r: (r.sort, r.place))  # bounded by most
    discard(lines)
    return fit([(r.sort, r.file, r.line, list(zip(r.s, r.e, strict=True))) for r in rows], kinds)


# Scanning.


def _found(texts: list, column: pa.Array, field: Field | None) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text by start, then kind: the fixed patterns', and what the field adds."""
    base = [[(s, k, e) for s, k, e, _ in base_spans(t)] if t else [] for t in texts]
    if field is not None:
        raw, offsets = tx.buffers(column)
        for first, last in tx.slices(offsets, 1 << 18):
            own = offsets[first : last + 1]
            part = raw[own[0] : own[-1]]
            row, start, end = field_spans(part, own - own[0], field)
            if len(row):
                points = _sums((part & 0xC0) != 0x80)
                begin = points[own - own[0]][row]
                for k, s, e in zip((row + first).tolist(), (points[start] - begin).tolist(), (points[end] - begin).tolist(), strict=True):
                    base[k].append((s, len(KINDS), e))
    out = []
    for every in base:
        known = {(s, e) for s, k, e in every if k < len(KINDS)}
        out.append([((*KINDS, ADDED)[k], s, e) for s, k, e in sorted(every) if k < len(KINDS) or (s, e) not in known])
    return out


def spans_of(text: str, field: Field | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind, of one text."""
    return _found([text], pa.array([text], pa.large_string()), field)[0]


def hidden(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with the mark in place of each span; spans that overlap become one."""
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _scan(documents: DataFrame, field: Field | None, text: str, mark: str | None, name: str | None) -> DataFrame:
    cols = [c for c in documents.columns if c != name]
    given = documents.select(*(f"`{c}`" for c in cols))
    model = documents.sparkSession.sparkContext.broadcast(field)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int32(), "end": pa.int32()}))
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                at = part.schema.get_field_index(text)
                texts = part.column(at).to_pylist()
                spans = _found(texts, part.column(at), model.value)
                columns = list(part.columns)
                if mark is not None:
                    texts = [hidden(t, s, mark) if s else t for t, s in zip(texts, spans, strict=True)]
                    columns[at] = pa.array(texts, part.schema.field(at).type)
                names = list(part.schema.names)
                if name is not None:
                    columns.append(pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], kind))
                    names.append(name)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    more = [StructField(name, ArrayType(span))] if name is not None else []
    return given.mapInArrow(find, StructType([*given.schema.fields, *more]))


def scan(documents: DataFrame, field: Field | None, text: str = "text", name: str = "spans") -> DataFrame:
    """All columns, with the spans (kind, start, end) under the name."""
    return _scan(documents, field, text, None, name)


def masked(documents: DataFrame, field: Field | None, mark: str, text: str = "text") -> DataFrame:
    """All columns, with the mark in place of each span of the text."""
    return _scan(documents, field, text, mark, None)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
