"""Backlogs, small records, places, days and salaries on worked examples."""

import random

import pytest
from pyspark.sql import functions as F

from hirelake.functions import places, salary
from hirelake.operators import backlog


def value(spark, kind, given, make):
    return [r[0] for r in spark.createDataFrame([(x,) for x in given], f"x {kind}").select(make(F.col("x"))).collect()]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 7, 50])
def test_quartiles_are_ntile(spark, n):
    r = random.Random(n)
    rows = [(i, r.choice([None, 1, 2, 2, 3])) for i in range(n)]
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    q, more = divmod(n, 4)
    sizes = [q + (k < more) for k in range(4)]
    tile = [k + 1 for k, size in enumerate(sizes) for _ in range(size)]
    want = {key: 0 if s is None else t for (key, s), t in zip(order, tile, strict=True)}
    got = backlog.quartiles(spark.createDataFrame(rows, "k int, s int"), "k", "s")
    assert {x.k: x.quartile for x in got.collect()} == want
    batch = backlog.bucket_batch(got, "k", "quartile", 6).groupBy("quartile").count().collect()
    present = set(want.values())
    assert {x.quartile: x["count"] for x in batch} == {b: min(max(1, -(-6 // len(present))), list(want.values()).count(b)) for b in present}


def test_candidates_look_at_titles_first(spark):
    rows = [(1, 1, "Apply", "/a"), (1, 2, "Data Engineer", "/a"), (1, 3, "Data Engineer II", "/a"), (1, 4, "Data Engineer", None), (1, 5, "Data Engineer", ""), (2, 1, "Data Engineer", "/a"), (2, 2, None, "/b")]
    found = backlog.candidates(spark.createDataFrame(rows, "page int, place int, title string, url string"), "page", "place", "title", "url", ("data engineer",)).collect()
    assert sorted((r.page, r.place) for r in found) == [(1, 2), (1, 4), (1, 5), (2, 1)]


def test_direct_links_by_precedence(spark):
    jobs = spark.createDataFrame([(1, None, None), (2, "o", "loose"), (3, "o", "strict"), (4, "o", "loose"), (5, None, None), (6, None, None)], "k int, direct_url string, direct_confidence string")
    links = spark.createDataFrame([(1, "b", "loose"), (1, "a", "loose"), (2, "n", "strict"), (2, "m", "loose"), (3, "n", "strict"), (4, "n", "loose"), (5, "", "strict"), (5, "x", "odd"), (9, "n", "strict"), (6, None, "strict")], "k int, url string, confidence string")
    got = {r.k: (r.direct_url, r.direct_confidence) for r in backlog.with_direct_links(jobs, links, "k").collect()}
    assert got == {1: ("a", "loose"), 2: ("n", "strict"), 3: ("o", "strict"), 4: ("o", "loose"), 5: (None, None), 6: (None, None)}


def test_notes_and_alarm(spark):
    jobs = spark.createDataFrame([(1, "old"), (2, "old"), (3, None)], "k int, note string")
    notes = spark.createDataFrame([(1, "a", 1), (1, " b ", 2), (2, "x", 1), (2, "  ", 2)], "k int, note string, at int")
    assert {r.k: r.note for r in backlog.with_notes(jobs, notes, "k", "at").collect()} == {1: "b", 2: None, 3: None}
    runs = lambda *m: spark.createDataFrame([("ingestion", i, x) for i, x in enumerate(m)] + [("other", 99, '{"unexplained": 9}')], "source string, ts int, metadata string")
    told = lambda df, **o: [r.unexplained for r in backlog.funnel_alarm(df, **o).collect()]
    assert told(runs('{"unexplained": 0}', '{"unexplained": 3}')) == [3] and told(runs('{"unexplained": 3}', '{"unexplained": 0}')) == []
    assert told(runs('{"unexplained": 3}', None)) == [3] and told(runs('{"unexplained": 3}', "broken")) == [] and told(runs('{"unexplained": 3}'), most=-1) == [] and told(runs('{"unexplained": "x"}')) == []


def test_places_and_days(spark):
    assert value(spark, "string", ["Greater Austin Area, USA", None, "of to"], places.location_tokens) == [["austin"], [], []]
    shapes = ['{"jobLocation": "Rome "}', '{"jobLocation": {"address": "Via 1"}}', '{"jobLocation": [{"name": "A"}, "B", {"address": {"addressLocality": "C"}}]}', '{"jobLocation": null}', "{}", "broken", None]
    assert value(spark, "string", shapes, places.posted_location) == ["Rome", "Via 1", "A | B | C", "", "", "", ""]
    times = ["2026-01-02T03:04:05-04:00", "2026-01-02T03:04:05Z", "2026-01-02 03:04:05", "soon", None]
    assert [t and str(t) for t in value(spark, "string", times, places.naive_utc)] == ["2026-01-02 07:04:05", "2026-01-02 03:04:05", "2026-01-02 03:04:05", None, None]
    spring = spark.createDataFrame([("2024-03-10 15:00:00",)], "t string").select(places.local_day_window(F.col("t").cast("timestamp"), "America/New_York").alias("w")).select((F.unix_timestamp("w.end") - F.unix_timestamp("w.start")).alias("s"))
    assert spring.first().s == 23 * 3600


def test_salary_captured(spark):
    texts = ["$100K - $120K", "$50 - $60 per hour", "$10 - $20 a year", "nothing", None, "€5,000 - €6,000 per month"]
    got = value(spark, "string", texts, lambda c: salary.captured(salary.observed(c, F.lit("feed_string"))))
    assert [g and (g.salary_min, g.salary_max, g.period, g.currency, g.resolution, len(g.observations)) for g in got] == [
        (100_000, 120_000, "unknown", "USD", "ok", 1), (104_000, 124_800, "hourly", "USD", "salvaged_hourly", 1), (None, None, None, "USD", "implausible", 1), None, None, (60_000, 72_000, "monthly", "EUR", "salvaged_monthly", 1),
    ]
    assert [(g.salary_min, g.salary_max) for g in value(spark, "string", texts[:4], salary.from_text)] == [(100_000, 120_000), (104_000, 124_800), (None, None), (None, None)]
