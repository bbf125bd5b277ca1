"""Trees of hashes, language profiles and resampling against plain versions; nulls, empties, repeats, ties, long texts, clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import importance, language, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
EXTRA = ", tree string, digest string, place long, part int, score string, row string, n long, path string, turn int, language string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", "d", 5, 6, "s", "r", 7, "p", 8, "l") for r in rows], SCHEMA + EXTRA)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climbed(nodes):
    """The root of some nodes, and each one's steps (before, after)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            a = p - p % 3
            steps[i].append(("".join(nodes[a:p]), "".join(nodes[p + 1 : a + 3])))
        nodes, at = [sha(*nodes[a : a + 3]) for a in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], steps


def plain_manifest(rows):
    """Of (doc_id, leaf, subroot, root, path) the sorted list."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0], plain_leaf(*r)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(climbed([leaf for _, leaf in by[s]]))
    root, outer = climbed([t[0] for t in trees])
    return sorted(
        (repr(key), leaf, sub, root, tuple(inner[i] + outer[j]))
        for j, (s, (sub, inner)) in enumerate(zip(sources, trees, strict=True)) for i, (key, leaf) in enumerate(by[s])
    )


def documents(seed, n=260):
    r = random.Random(seed)
    sources = [None, "", "a", "B", "é", "src1", "src10", "src2", *(f"s{i}" for i in range(7))]
    hot = r.choice(sources)
    return [
        (i, r.choice([None, "", "a\nb", "text é %d" % r.randint(0, 5), "x" * r.randint(0, 40)]), r.choice([None, "en", ""]), hot if r.random() < 0.4 else r.choice(sources), r.choice([None, 0, 17]))
        for i in range(n)
    ]


def found(rows):
    return sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in rows)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_against_plain_trees(spark, levels, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 40)
    rows = documents(levels)
    rows += rows[:3] * 2 + [(None, "x", "en", "a", 1)] * 4 + [(7, "other", "en", "a", 1)]  # repeated rows, null and repeated keys
    told = table(spark, rows)
    out = merkle.manifest(told, carry={"own": F.col("path")}, levels=levels)
    got = out.withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert found(got) == plain_manifest(rows)
    assert all(r.again == r.root and r.own == "p" for r in got)


def test_manifest_of_one_source_over_many_rounds(spark):
    rows = [(i, str(i), "en", "only", 1) for i in range(3**5 + 2)]
    got = merkle.manifest(table(spark, rows), levels=1).collect()
    assert found(got) == plain_manifest(rows)


def test_manifest_small_and_empty(spark):
    assert merkle.manifest(table(spark, [])).count() == 0
    (one,) = merkle.manifest(table(spark, [(1, "x", None, None, None)])).collect()
    assert one.leaf == one.subroot == one.root == plain_leaf(1, "x", None, None, None) and one.path == []
    with pytest.raises(ValueError):
        merkle.manifest(table(spark, []), carry={"place": F.lit(1)})


def test_manifest_shows_what_was_changed(spark):
    rows = [(i, f"line\n{i}", "en", f"s{i % 3}", 6) for i in range(40)]
    shown = F.when(F.col("doc_id") == 11, merkle.leaf(["doc_id", "source", "lang", "n_chars", F.lit("other")])).otherwise(merkle.leaf(merkle.COLUMNS))
    out = merkle.manifest(table(spark, rows), carry={"shown": shown}, levels=2)
    wrong = out.where(merkle.folded(F.col("shown"), F.col("path")) != F.col("root")).collect()
    assert [r.doc_id for r in wrong] == [11]


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        code = [int(language.codes()[ord(c)]) for c in w]
        padded = [32, *code, 32]
        out.update((1 << 30) | c for c in code)
        out.update((2 << 30) | (a << 10) | b for a, b in zip(padded, padded[1:]))
        out.update((3 << 30) | (a << 20) | (b << 10) | c for a, b, c in zip(padded, padded[1:], padded[2:]))
    return out


def plain_ranking(counts, length):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:length]]


def test_grams_against_plain():
    r = random.Random(3)
    texts = ["", "...", "a", "Ünïcode 漢字 \U0001d400x", "İstanbul", "abc", *("".join(r.choice("abé ,ZW\n0漢") for _ in range(r.randint(0, 60))) for _ in range(200))]
    every, at = language.grams(texts)
    for i, t in enumerate(texts):
        own = every[at[i] : at[i + 1]]
        assert Counter(own.tolist()) == plain_grams(t), t
        for length in (3, 300):
            assert language.ranking(own, length).tolist() == plain_ranking(plain_grams(t), length)


def test_language_against_plain(spark):
    r = random.Random(4)
    parts = {"aa": "ka lo mi tu", "bb": "sha eth oor ing", "cc": "ção é ñu il"}
    rows = []
    for i in range(120):
        lang = r.choice(list(parts))
        rows.append((i, " ".join("".join(r.choice(parts[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 30))), lang, "s", 1))
    rows += [(500, None, "aa", "s", 1), (501, "", "aa", "s", 1), (502, "12 ! 34", "bb", "s", 1), (503, "kalo", None, "s", 1), (504, "zzz", "never", "s", 1), (None, "ka lo", "aa", "s", 1)] + rows[:2] * 3
    docs = table(spark, rows)
    learn = [x for x in rows if x[0] is None or zlib.crc32(str(x[0]).encode()) % 4 != 2]
    counts = {}
    for _, t, lang, _, _ in learn:
        if t and lang:
            counts.setdefault(lang, Counter()).update(plain_grams(t))
    model = {lang: plain_ranking(c, language.LENGTH) for lang, c in counts.items() if c}
    assert language.train(docs.where(language.learnable())) == model
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.predict(docs, model).collect()), key=repr)
    want = []
    for key, t, *_ in rows:
        own = plain_ranking(plain_grams(t or ""), language.LENGTH)
        away = {x: sum(abs(i - model[x].index(g)) if g in model[x] else language.LENGTH for i, g in enumerate(own)) for x in model}
        best = min(away, key=lambda x: (away[x], x)) if own else "und"
        want.append((key, best, round(1 - away[best] / (language.LENGTH * len(own)), 9) if own else 0.0))
    assert got == sorted(want, key=repr)


def test_language_edges(spark):
    docs = table(spark, [(1, "some text", "en", "s", 1), (2, None, "en", "s", 1)])
    assert language.train(docs.limit(0)) == {}
    assert {(r.lang_pred, r.score) for r in language.predict(docs, {}).collect()} == {("und", 0.0)}
    assert language.predict(docs.limit(0), {"en": [1]}).count() == 0
    long = table(spark, [(1, "the and of " * 300_000, "en", "s", 1), (2, "ß" * 2_000_000, "de", "s", 1), (3, "the", "en", "s", 1), (4, "ß", "de", "s", 1)])
    model = language.train(long)
    assert {r.doc_id: r.lang_pred for r in language.predict(long, model).collect()} == {1: "en", 2: "de", 3: "en", 4: "de"}
    same = {"b": model["en"], "a": model["en"]}
    assert {r.lang_pred for r in language.predict(long, same).collect()} == {"a"}
    kept = language.tagged(docs, model)
    assert kept.columns == [*docs.columns, "_language"] and kept.first()._language.lang_pred == "en"
    with pytest.raises(ValueError):
        language.train(table(spark, [(i, "x", f"l{i}", "s", 1) for i in range(language.MOST_LANGUAGES + 1)]))


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.predict(docs, language.train(docs.where(language.learnable()))).join(docs.select("doc_id", "lang"), "doc_id").where(~language.learnable()).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.99


def plain_features(text):
    w = brute.alnum_words(text)
    return [zlib.crc32(g.encode()) for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]], len(w)


def plain_resample(docs, target, percent=25, least=20):
    """(doc_id, n_features, weight, score, rank) of each row; ranks of rows that repeat an id are a set."""
    s, t = np.zeros(10_000), np.zeros(10_000)
    for of, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for c in plain_features(x)[0]:
                of[c % 10_000] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    out = []
    for key, x in docs:
        crc, n = plain_features(x)
        weight = sum(gain[c % 10_000] for c in crc) // len(crc) if crc else 0
        h = int(sha(f"7:{'' if key is None else key}")[:8], 16)
        out.append([key, len(crc), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for i, x in enumerate(may[: percent * len(may) // 100]):
        x[4] = i + 1
    return [tuple(x[:5]) for x in out]


def texts(seed, n=300):
    r = random.Random(seed)
    words = ["a", "I", "Der", "ÉTÉ", "naïve", "漢字", "x" * 47, "y" * 48, "z" * 49, "w" * 200, *(f"w{i}" for i in range(60))]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 3, 19, 20, 21, 40]))) + r.choice(["", ".", " -"]) for _ in range(n)]


def test_features_against_zlib():
    every = texts(1)
    import pyarrow as pa

    for _, _, raw, offsets in importance._slices(pa.array([None, *every])):
        crc, row, n = importance.features(raw, offsets)
        for i, t in enumerate([None, *every]):
            want, words = plain_features(t)
            assert sorted(crc[row == i].tolist()) == sorted(want) and n[i] == words


@pytest.mark.parametrize(("percent", "target"), [(25, None), (100, []), (0, None), (60, [""])])
def test_resample_against_plain(spark, percent, target):
    docs = list(enumerate(texts(2)))
    docs += [(1000, None), (1001, ""), (None, texts(9)[5] + " a" * 20)]
    target = texts(3, 20) if target is None else target
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, score int")
    out = importance.resample(table(spark, [(k, t, "en", "s", 1) for k, t in docs]), bench, percent=percent)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()), key=repr)
    assert got == sorted(plain_resample(docs, target, percent), key=repr)


def test_resample_repeats_and_empty(spark):
    line = " ".join(f"w{i}" for i in range(30))
    docs = [(1, line)] * 400 + [(None, line)] * 300 + [(i, line) for i in range(2, 302)]
    told = table(spark, [(k, t, "en", "s", 1) for k, t in docs]).repartition(7)
    bench = spark.createDataFrame([(line,)], "text string")
    rows = importance.resample(told, bench, percent=80).collect()
    want = plain_resample(docs, [line], 80)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 801))
    by = lambda xs: sorted(((k, rank) for k, _, _, _, rank in xs), key=repr)
    assert by((r.doc_id, 0, 0, 0, r["rank"]) for r in rows) == by(want)
    assert importance.resample(told.limit(0), bench).count() == 0


def test_resample_long_text(spark):
    long = " ".join(f"w{i * 7919 % 99991}" for i in range(300_000)) + " " + "q" * 3_000_000
    docs = [(1, long), (2, "short text")]
    bench = spark.createDataFrame([("w1 w2 w3",)], "text string")
    got = sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in importance.resample(table(spark, [(k, t, "en", "s", 1) for k, t in docs]), bench, percent=100).collect() if r.doc_id)
    assert got == sorted(plain_resample(docs, ["w1 w2 w3"], 100))
