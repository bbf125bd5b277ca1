"""Every registered query of the corpus operators as a whole: against DuckDB where SQL can express it, else against brute force."""

import hashlib
import zlib

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hirelake.llm import packing, queries, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    cols = sorted(found.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in found.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_toxicity(spark, texts):
    rows = queries.op1_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_token_counts(spark, texts):
    encode = packing.encoder(added=False)
    got = sorted(r.n_tokens for r in queries.op2_token_counts(spark, SF).collect())
    assert got == sorted(len(encode(t or "")) for t in texts.values())


def test_packing(spark, texts):
    encode, at, filled = packing.encoder(), {}, {}
    rows = queries.op5_best_fit_packing(spark, SF).collect()
    ids = {d: np.append(encode(t or ""), 0).astype("<u4") for d, t in texts.items()}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        piece, start = at.get(r.doc_id, (0, 0))
        assert (r.piece, r.start) == (piece, start) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][start : start + r.length].tobytes())
        assert r.length == 2048 or r.piece == 0
        at[r.doc_id] = (piece + 1, start + r.length)
    assert {d: e for d, (_, e) in at.items()} == {d: len(x) for d, x in ids.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= 1.05 * -(-sum(map(len, ids.values())) // 2048) + 1


def test_suffix_dedup(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, SF).collect()}
    assert got == brute.removed(sorted(texts.items()), 100)


def test_secret_scan(spark, texts):
    for r in queries.op8_secret_scan(spark, SF).collect():
        base = sorted((s, k, e) for s, k, e, _ in secrets.base_spans(texts[r.doc_id] or ""))
        names = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [x for x in every if not x.startswith("field:")] == names and len(every) == len(names) + r.n_field


CLASH = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string, starts int, row string, toxicity string, stay int, id string, `set` string"


def folder(spark, tmp_path, rows):
    """Tables for the pipeline: given documents with clashing further columns, and the labels and benchmark of the test data."""
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "own", "own", d, "own", "own", 5, "own", "own") for d, t in rows], CLASH)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    return docs


def test_pipeline_run(spark, texts, tmp_path):
    long = " ".join(f"word{i * 7919 % 9973}" for i in range(200_000))
    rows = [*list(texts.items())[:60], (10**6, None), (10**6 + 1, ""), (10**6 + 2, long), (10**6 + 3, long + " more"), (10**6 + 4, "a\nsecret = abcdef123456 b")]
    docs = folder(spark, tmp_path, rows)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = {r.doc_id for r in packed}
    assert {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 4} <= found and 10**6 + 3 not in found
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert {(r.spans, r.score, r.row, r.toxicity, r.id, r.set, r.starts == r.doc_id) for r in kept.collect()} == {("own", "own", "own", "own", "own", "own", True)}


@pytest.mark.parametrize("rows", [[], [(None, None)] * 3])
def test_pipeline_without_texts(spark, tmp_path, rows):
    folder(spark, tmp_path, rows)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(rows)


def test_shared_folder_must_be_named(spark, monkeypatch):
    from hirelake.llm import shared

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        shared.shared_dir(Cluster)


def test_discarded_tables_go(spark):
    from hirelake.llm import shared

    table = shared.written(spark.range(5), "some")
    assert table.count() == 5
    shared.discard(table)
    with pytest.raises(Exception):  # noqa: B017, PT011
        spark.read.parquet(table.written_to)


def test_very_long_texts(spark):
    """One text of some megabytes beside short ones, in every operator that reads texts."""
    from hirelake.llm import decontaminate, line_quality, ngram_join, suffix_dedup, toxicity

    words = [f"w{i * 7919 % 250_007}" for i in range(250_000)]
    long = " ".join(words) + "\n" + "x" * 300_000
    docs = spark.createDataFrame([(1, long, "s"), (2, " ".join(words[1000:1030]), "s"), (3, "short", "s"), (4, long + " end", "s")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(7, " ".join(words[200_000:200_010]))], "item_id long, text string")
    hit = {r.doc_id: len(r.starts) for r in decontaminate.find(docs, bench).collect()}
    assert hit == {1: 1, 2: 0, 3: 0, 4: 1}
    assert {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    removed = {r.doc_id: r.n for r in suffix_dedup.dedup(docs).withColumn("n", suffix_dedup.n_removed()).collect()}
    assert removed[1] == 300_000 - 1 and removed[2] == len(" ".join(words[1000:1030])) and removed[3] == 0 and removed[4] == len(long)
    assert line_quality.judge(docs).count() == 4
    labels = spark.createDataFrame([(3, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).where(F.col("score").between(0, 1)).count() == 4
    assert packing.pack(packing.pieces(docs, with_ids=False)).where("length > 2048").count() == 0
