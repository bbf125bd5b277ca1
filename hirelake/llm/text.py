"""Vectorised helpers on Arrow string columns, shared by the operators that run inside tasks.

All positions are byte positions in the UTF-8 text. Hashes are 64-bit; two different words or
windows of one corpus get the same hash with a chance of about n*n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Word bytes by contract: everything but ASCII white space.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Word bytes by contract: digits, small letters and every byte of a non-ASCII character.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: An odd base and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 16)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            step = np.full(m, base, dtype=np.uint64)
            step[0] = 1
            _powers.append(np.cumprod(step, dtype=np.uint64))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more at the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows with about `most` bytes each; a longer text is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; no word runs from one text into the next."""
    inside = kind[raw]
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(raw))]
    both = border[inside[border] & inside[border - 1]]
    starts[both] = True
    ends[both - 1] = True
    start = np.flatnonzero(starts)
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, np.flatnonzero(ends) + 1, row


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive values, also across texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64) | 1
        out += hashes[k : k + n] * np.uint64(factor)
    return mix(out)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The window hash of one whole sequence."""
    return windows(hashes, len(hashes))[0]
