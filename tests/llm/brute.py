"""Plain versions of the operators, for small inputs."""

import hashlib
import re


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def shingles(t):
    w = space_words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(docs):
    """doc_id -> (size, least reachable doc_id), of (doc_id, text) rows."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def removed(docs, span):
    """doc_id -> (bytes, removed, spans, digest of the rest), of (doc_id, text) rows with distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            s = b[i : i + span]
            if s in seen:
                gone[i : i + span] = b"\1" * span
            seen.add(s)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def contaminated(docs, items, size=10):
    """doc_id -> (words, hit words, item ids), of (doc_id, text) and (item_id, text) rows."""
    windows = {}
    for ident, t in items:
        w = alnum_words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(ident))
    out = {}
    for d, t in docs:
        w, hit, found = alnum_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[d] = (len(w), len(hit), sorted(found))
    return out
