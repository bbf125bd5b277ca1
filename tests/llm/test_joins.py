"""The pair and repeat operators against brute force, with limits small enough that blocks, parts and shards come into play."""

import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from hirelake.llm import decontaminate, ngram_join, repeats, suffix_dedup
from hirelake.llm.components import components

DOCS = "doc_id long, text string, id string, set string, n int, key string"


def rows(spark, docs):
    """With further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "x", "y", 1, "z") for d, t in docs], DOCS)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(8, 60))] for _ in range(6)]
    common = " ".join(r.choice(words) for _ in range(30))
    docs = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.3:
            w = w[: len(w) // 2] + common.split() + w[len(w) // 2 :]
        docs.append((i, " ".join(w).title() if r.random() < 0.3 else "\n".join(w)))
    return docs + [(1000, None), (1001, ""), (1002, " \t "), (1003, "a b c"), (1004, "A  b\tC"), (1005, "é" * 40), (1006, "a\x00" * 90), (1007, "a\x00" * 90)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", 500)
    docs = corpus(seed)
    got = ngram_join.join(rows(spark, docs)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute.components(docs)


def test_search_in_parts(spark):
    docs = corpus(3)
    sets = ngram_join.measured(rows(spark, docs), "doc_id", "text", 5)
    classes = ngram_join.survivors(rows(spark, docs), sets, "doc_id", "text", 5, 75)
    rest = classes.select("number", "n", F.col("number").alias("label"), F.array_sort("tokens").alias("tokens")).cache()
    whole = {frozenset(x) for x in ngram_join.searched(rest, 75, block=1000).distinct().collect()}
    parts = {frozenset(x) for x in ngram_join.searched(rest, 75, block=3).distinct().collect()}

    def closed(links):
        return {(r.node, r.root) for r in components(spark.createDataFrame([tuple(x) for x in links], "a long, b long")).collect()}

    assert whole and closed(whole) == closed(parts)


def test_parts_of_a_block_are_shards(spark):
    """However many pairs of parts a block or a hot shingle has, no shard gets more than one."""
    r = random.Random(8)
    own = r.sample(range(10_000), 400)
    for most_parts, common in ((100, [7]), (1, [7, 8, 9])):  # a block in parts, and shingles that stay hot however many are asked for
        rest = [(i, i, 1 + len(common), [*common, 1000 + i]) for i in own]
        rest = spark.createDataFrame(rest, "number long, label long, n long, tokens array<long>")
        sizes = [x["count"] for x in ngram_join.dealt_classes(rest, 75, 20, most_parts).groupBy("shard").count().collect()]
        assert len(sizes) == 20 * 21 // 2 and max(sizes) < 100


def test_hot_prefix_shingle_copies_no_class_often(spark):
    """Classes that share one prefix shingle, and two of them more, meet by what else they share; nobody is copied for each part of a hot shingle."""
    rest = [(i, i, 12, [7, *(1000 * (i // 2) + k for k in range(10)), 900_000 + i]) for i in range(200)]
    table = spark.createDataFrame(rest, "number long, label long, n long, tokens array<long>")
    dealt = ngram_join.dealt_classes(table, 75, 2, 2)
    assert max(r["count"] for r in dealt.groupBy("number").count().collect()) <= 6
    links = {tuple(sorted(x)) for x in ngram_join.searched(table, 75, block=2).distinct().collect()}
    assert links == {(i, i + 1) for i in range(0, 200, 2)}


@pytest.mark.parametrize("seed", range(3))
def test_narrowed_groups_lose_no_link(spark, seed):
    """Sets over few shingles, so that many are hot at any depth: every pair that links shares a shard."""
    r = random.Random(seed)
    rest = []
    for i in range(150):
        n = r.randint(3, 9)
        rest.append((i, i, n, sorted(r.sample(range(14), n))))
    table = spark.createDataFrame(rest, "number long, label long, n long, tokens array<long>")
    shards = {}
    for x in ngram_join.dealt_classes(table, 75, 5, 1).select("number", "shard").collect():
        shards.setdefault(x.number, set()).add(x.shard)
    for a, b in itertools.combinations(rest, 2):
        if len(set(a[3]) & set(b[3])) >= ngram_join.least_overlap(a[2], b[2]):
            assert shards.get(a[0], set()) & shards.get(b[0], set()), (a, b)


def test_chained_block_stays_apart(spark):
    """Classes that chain into one block by shingles of two each are no common shard."""
    rest = [(i, i, 2, [i, i + 1]) for i in range(300)]
    rest = spark.createDataFrame(rest, "number long, label long, n long, tokens array<long>")
    dealt = ngram_join.dealt_classes(rest, 50, 20, 2).groupBy("shard").agg(F.collect_set("number").alias("own")).collect()
    assert max(len(x.own) for x in dealt) == 2
    together = {(a, a + 1) for x in dealt for a in x.own if a + 1 in x.own}
    assert together == {(i, i + 1) for i in range(299)}


def test_divide_skip():
    r = random.Random(5)
    for _ in range(200):
        lists = [np.array(sorted(r.sample(range(30), r.randint(1, 25)))) for _ in range(r.randint(1, 12))]
        least = r.randint(1, 8)
        counts = {x: sum(x in s for s in map(set, lists)) for x in range(30)}
        assert ngram_join.divide_skip(lists, least) == {x: n for x, n in counts.items() if n >= least}


@pytest.mark.parametrize("probe", [0, 1, 3])
def test_divide_skip_wherever_it_divides(probe):
    """With all but the needed lists probed, or some of them: the same counts."""
    r = random.Random(6)
    for _ in range(200):
        lists = [np.array(sorted(r.sample(range(30), r.randint(0, 25))), np.int64) for _ in range(r.randint(0, 12))]
        least = r.randint(1, 8)
        counts = {x: sum(x in s for s in map(set, lists)) for x in range(30)}
        assert ngram_join.divide_skip(lists, least, probe) == {x: n for x, n in counts.items() if n >= least}


def test_search_of_a_large_near_copy_group():
    """800 versions of one text, nearly all just too unlike to link, so that no link saves a comparison: nothing is walked id by id."""
    r = np.random.default_rng(3)
    sets = [np.sort(r.choice(400, r.integers(320, 345), replace=False)) for _ in range(800)]
    sizes = np.array([len(x) for x in sets])
    held = np.zeros((800, 400), np.int32)
    for k, x in enumerate(sets):
        held[k, x] = 1
    both = held @ held.T
    linked = 100 * both >= 75 * (sizes[:, None] + sizes - both)
    want = {(a, b) for a, b in zip(*np.nonzero(linked), strict=True) if a < b}
    assert 0 < len(want) < 20_000
    begun = time.process_time()
    pairs = ngram_join.search(sets, sizes, np.arange(800))
    assert time.process_time() - begun < 6
    assert set(pairs) <= want and len(set(pairs)) == len(pairs)
    group = list(range(800))
    for a, b in want:
        group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group] if group[a] != group[b] else group
    assert len(pairs) == 800 - len(set(group))


def test_small_shards_are_not_one_task(spark):
    """Shards take few bytes and much time, so they are not all put into one task for being small; a shard is in one task."""
    rest = [(i, i, 4, [10 * (i // 2) + k for k in range(4)]) for i in range(200)]
    table = spark.createDataFrame(rest, "number long, label long, n long, tokens array<long>")
    tasks = ngram_join.dealt_classes(table, 75, 20).select(F.spark_partition_id().alias("p"), "shard").distinct().collect()
    assert len({x.shard for x in tasks}) > 4 and len({x.p for x in tasks}) > 2
    assert len({x.shard for x in tasks}) == len(tasks)


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_contested_lists_over_many_batches(most):
    """A class whose rows lie in several batches is one list, rarest first; too few tokens, and it goes."""
    r = random.Random(9)
    tokens = {n: [(r.randint(2, 4), r.randrange(-99, 99) * 100 + k) for k in range(r.randint(1, 9))] for n in range(-20, 20)}
    flat = [(n, 8, -n, df, t) for n, own in tokens.items() for df, t in own]
    columns = [pa.array(x, pa.int64()) for x in zip(*flat, strict=True)]
    batches = pa.RecordBatch.from_arrays(columns, names=["number", "n", "label", "df", "token"])
    cut = [batches.slice(k, 3) for k in range(0, len(flat), 3)]
    got = [x for b in ngram_join._gathered(75, most)(iter(cut)) for x in b.to_pylist()]
    assert got == [{"number": n, "n": 8, "label": -n, "tokens": [t for _, t in sorted(own)]} for n, own in tokens.items() if len(own) >= 6]
    assert list(ngram_join._gathered(75, most)(iter([]))) == []


def test_one_of_each(spark):
    docs = corpus(4)
    kept = ngram_join.one_of_each(rows(spark, docs))
    assert kept.columns == ["doc_id", "text", "id", "set", "n", "key"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in brute.components(docs) if d == c)


def test_repeated_rows_and_empty(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (None, "x y z"), (None, None)]
    got = ngram_join.join(rows(spark, docs)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 1, None), (None, 0, None)], key=str)
    assert ngram_join.join(rows(spark, [])).count() == 0


@pytest.mark.parametrize("key", [None, 7])
def test_ngram_join_texts_of_one_key(spark, key):
    """Unrelated texts under one key, each with near copies of other keys, link with those only."""
    r = random.Random(6)
    base = [[f"t{i}w{r.randrange(10_000)}" for _ in range(60)] for i in range(4)]
    docs = [(key, " ".join(w)) for w in base] + [(100 + 10 * i + k, " ".join([*w[:-1], f"end{k}"])) for i, w in enumerate(base) for k in range(2)]
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.join(rows(spark, docs)).collect()}
    least = [100 + 10 * i if key is None else 7 for i in range(4)]
    assert got == {*((key, 56, c) for c in least), *((100 + 10 * i + k, 56, least[i]) for i in range(4) for k in range(2))}
    sets = ngram_join.measured(rows(spark, docs), "doc_id", "text", 5)
    classes = ngram_join.survivors(rows(spark, docs), sets, "doc_id", "text", 5, 75).collect()
    assert len(classes) == 12 and all(x.n >= len(x.tokens) for x in classes)


def pieces(seed, n=40):
    r = random.Random(seed)
    blocks = ["".join(r.choice("abcd é\n") for _ in range(r.randint(20, 90))) for _ in range(8)]
    docs = [(i, "".join(r.choice(blocks) if r.random() < 0.7 else "".join(r.choice("abcdefgh ") for _ in range(15)) for _ in range(r.randint(1, 5)))) for i in range(n)]
    return docs + [(100, None), (101, ""), (102, "q" * 300), (103, "q" * 29), (104, docs[3][1]), (105, "n\x00" * 50), (106, "m" + "n\x00" * 50)]


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"block": 2, "shard_bytes": 400}), (3, {"shard_bytes": 5000, "part_bytes": 300})])
def test_suffix_dedup(spark, seed, options):
    docs = pieces(seed)
    found = suffix_dedup.dedup(rows(spark, docs), span=30, gram=8, **options)
    got = {r.doc_id: (r.n_bytes, r.n, len(r.spans), r.kept_sha256) for r in found.withColumn("n", suffix_dedup.n_removed()).collect()}
    assert got == brute.removed(docs, 30)


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.dedup(rows(spark, [])).count() == 0
    text = "".join(chr(97 + i * 7 % 26) for i in range(150)) + "xyz" * 20
    got = suffix_dedup.dedup(rows(spark, [(2, text), (2, text), (5, text), (None, text)])).withColumn("n", suffix_dedup.n_removed()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n == r.n_bytes) for r in got) == [(False, 2, False), (False, 2, False), (False, 5, True), (True, 0, True)]


def test_suffix_dedup_repeated_rows(spark):
    """Rows that repeat a key and text are one document, also where their fingerprints have several contexts."""
    docs = pieces(4)
    want = brute.removed(docs, 30)
    null = "z" + docs[5][1] + "unlike the others " * 3
    want |= {None: brute.removed([*docs, (10_000, null)], 30)[10_000]}
    every = [*docs, *docs[::2], *docs[::3], *docs[:4] * 20, (None, null), (None, null)]
    found = suffix_dedup.dedup(rows(spark, every), span=30, gram=8).withColumn("n", suffix_dedup.n_removed()).collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted((d for d, _ in every), key=str)
    assert {(r.doc_id, (r.n_bytes, r.n, len(r.spans), r.kept_sha256)) for r in found} == set(want.items())


def test_suffix_dedup_keys_of_any_type(spark):
    """Text keys come in their order; a name that the operator uses is no trouble."""
    docs = pieces(6)
    names = {d: f"k{(d * 37) % 211:03d}" for d, _ in docs}
    want = brute.removed(sorted((int(names[d][1:]), t) for d, t in docs), 30)
    table = spark.createDataFrame([(names[d], t, 1, 2) for d, t in docs] + [(None, docs[2][1] + "tail", 1, 2)], "doc_id string, text string, place int, own int")
    found = suffix_dedup.dedup(table, span=30, gram=8).withColumn("n", suffix_dedup.n_removed()).collect()
    assert {int(r.doc_id[1:]): (r.n_bytes, r.n, len(r.spans), r.kept_sha256) for r in found if r.doc_id} == want
    assert len(found) == len(docs) + 1


def test_index_is_small():
    """Windows are places among the items' words: some bytes each, however long they are."""
    import pickle

    texts = [" ".join(f"w{i * 7919 % 50_021}x{k}" for i in range(20_000)) for k in range(5)]
    windows = decontaminate.item_windows(list(range(5)), texts, 10)
    vocabulary = np.unique(windows[0])
    index = decontaminate.Index(windows, list(range(5)), vocabulary, np.ones(len(vocabulary), np.int64))
    assert len(index.start) == 5 * (20_000 - 9) and len(pickle.dumps(index)) < 5.5 * sum(map(len, texts))


def test_contexts_are_dealt_once(spark):
    """Contexts of a hot fingerprint stay out of the shards, and the others enter one each."""
    firsts = spark.createDataFrame([(fp, k, 100 * fp + k, 0, 130) for fp, m in ((1, 50), (2, 4), (3, 1)) for k in range(m)], "fp long, same long, id long, a long, e long")
    few, hot = suffix_dedup.dealt_contexts(firsts, 10, 400)
    assert sorted(x.id for x in few.collect()) == [200, 201, 202, 203] and sorted(x.id for x in hot.collect()) == list(range(100, 150))


def test_passed_on_entries_spread():
    """What repeats within a batch doesn't meet in one group, however small the ids are."""
    hashes, rows_of = np.repeat(np.arange(50, dtype=np.uint64), 2), np.arange(100) % 10
    hashes, rows_of = hashes[np.argsort(rows_of, kind="stable")], np.sort(rows_of)
    found = [repeats._flush(1, hashes, rows_of, None, np.arange(10 * k, 10 * k + 10)).to_pydict() for k in range(20)]
    passed = [b for x in found for b, kind in zip(x["bucket"], x["kind"], strict=True) if kind == repeats._PASSED]
    assert len(passed) == 20 and len(set(passed)) > 15 and max(passed) < 0


def test_suffix_array():
    r = random.Random(9)
    for _ in range(50):
        t = np.array([r.choice([97, 97, 98]) for _ in range(r.randint(1, 120))], np.uint8)
        order, word = suffix_dedup.suffix_array(t, 20)
        data = t.tobytes()
        assert order.tolist() == sorted(range(len(t)), key=lambda i: data[i:])
        want = [0] + [next((k for k in range(len(data)) if data[a + k : a + k + 1] != data[b + k : b + k + 1]), len(data)) for a, b in zip(order[1:], order, strict=False)]
        got = suffix_dedup.common_prefixes(order, word, 20, lanes=4)
        assert [min(x, 20) for x in want] == got.tolist()


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    r = random.Random(1)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 3, 9, 10, 25])))) for i in range(12)] + [(99, None), (98, "only one")]
    docs = []
    for i in range(30):
        w = [r.choice(words) for _ in range(40)]
        if i % 3 == 0:
            part = (r.choice(items)[1] or "").split()
            w[10:10] = part[r.randint(0, 5) :]
        docs.append((i, ", ".join(w).upper() if i % 2 else " ".join(w)))
    docs += [(100, None), (101, ""), (102, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(rows(spark, docs), bench, block_bytes=block_bytes).withColumn("hit", decontaminate.n_hit()).collect()
    assert {x.doc_id: (x.n_words, x.hit, x["items"]) for x in found} == brute.contaminated(docs, items)
    kept = decontaminate.clean(rows(spark, docs), bench, block_bytes=block_bytes)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(d for d, x in brute.contaminated(docs, items).items() if not x[1])
    assert decontaminate.find(rows(spark, []), bench).count() == 0
    clash = spark.createDataFrame([(d, t, i, "s", "e", "i", 1, "r", "k") for i, (d, t) in enumerate([*docs, docs[0]])], "doc_id long, text string, n_words int, starts string, ends string, items string, n int, `row` string, key string")
    kept = decontaminate.clean(clash, bench, block_bytes=block_bytes)
    want = brute.contaminated(docs, items)
    assert kept.columns == clash.columns and sorted(x.n_words for x in kept.collect()) == [i for i, (d, _) in enumerate([*docs, docs[0]]) if not want[d][1]]
    assert decontaminate.find(rows(spark, docs), bench.limit(0)).where("size(starts) > 0").count() == 0


@pytest.mark.parametrize("buckets", [1, 1000, 400_000, 8_000_000])
def test_dealing_does_not_walk_all_buckets(buckets):
    """What a task makes of its parts is bounded by the parts and by GROUPS, not by the buckets that the corpus has."""
    r = np.random.default_rng(1)
    hashes = (r.integers(0, 1 << 31, 200_000, dtype=np.uint64) << np.uint64(32)) | np.arange(200_000, dtype=np.uint64)
    each = -(-buckets // repeats.GROUPS)
    found = repeats._flush(buckets, hashes, np.repeat(np.arange(200), 1000), None, np.arange(200), each)
    assert found.num_rows <= min(buckets, repeats.GROUPS) * 2 + 1
    width = 4 if each == 1 else 8
    assert sum(len(k) for k in found["keys"].to_pylist()) == width * len(hashes)


@pytest.mark.parametrize(("groups", "batch"), [(10_000, 300), (3, 300), (1, 50), (7, 100_000)])
def test_repeated_parts_through_groups(spark, monkeypatch, groups, batch):
    """With and without the step through groups of buckets, the same parts are found."""
    monkeypatch.setattr(repeats, "GROUPS", groups)
    r = random.Random(groups)
    docs = [(i, [r.randrange(4000) for _ in range(r.randint(0, 40))]) for i in range(300)] + [(1000 + i, [5, 6, 7]) for i in range(50)]
    table = spark.createDataFrame(docs, "id long, p array<long>").repartition(6)

    def parts_of(batch):
        import hashlib

        lists = batch.column(1)
        flat = np.asarray(lists.flatten()).astype(np.uint64)
        row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths(), dtype=np.int64))
        place = np.arange(len(flat), dtype=np.uint32) - np.repeat(np.asarray(lists.offsets)[:-1], np.asarray(lists.value_lengths(), dtype=np.int64)).astype(np.uint32)
        digests = [hashlib.sha256(str(x).encode()).digest() for x in lists.to_pylist()]
        yield 0, len(lists), repeats.tx.mix(flat + np.uint64(1)), row, place, digests

    got = {x.id: x.places for x in repeats.repeated(table, parts_of, 8000, bucket=100, batch=batch).collect()}
    # equal lists of one batch count once, under the least id; at least one of them is there
    seen = {}
    for i, p in docs:
        for v in set(p):
            seen.setdefault(v, set()).add(tuple(p))
    for i, p in docs[:300]:
        elsewhere = [k for k, v in enumerate(p) if len(seen[v]) > 1 or p.count(v) > 1]
        assert set(elsewhere) <= set(got.get(i, [])) or not p, i
        extra = set(got.get(i, [])) - set(elsewhere)
        assert not extra or sum(q == p for _, q in docs) > 1
