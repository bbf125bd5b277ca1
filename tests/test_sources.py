"""Feeds, sinks and streams on small inputs."""

import random

from pyspark.sql import functions as F

from hirelake.functions import mail, ratios
from hirelake.operators import matching
from hirelake.sources import feeds
from hirelake.streaming import stateful


def test_postings(spark):
    raw = spark.createDataFrame([('{"jobs": [{"position": "Dev", "company_name": "A", "url": "u"}, {"title": "", "company": "B"}, {"name": "Ops", "organization": "C", "city": "Rome"}]}',), ('{"error": "quota"}',), ("broken",)], "doc string")
    got = feeds.postings(feeds.objects(raw, "doc")).select("title", "company", "location").collect()
    assert sorted(map(tuple, got)) == [("Dev", "A", "Remote"), ("Ops", "C", "Rome")]


def test_mail_and_pages(spark):
    body = "Analyst\nAcme\nParis\nView job: https://x.org/1\n------------\nOnly one line\nView job: https://x.org/2\n-----------\nDev\nBeta\nView job: https://x.org/3"
    got = feeds.mail_postings(spark.createDataFrame([(1, body), (2, None)], "id int, body string")).select("title", "company", "location", "url").collect()
    assert [tuple(r) for r in got] == [("Analyst", "Acme", "Paris", "https://x.org/1"), ("Dev", "Beta", "Unknown", "https://x.org/3")]
    page = spark.createDataFrame([(1, '<a class="x" href="/a"> One <b>two</b></a><a href="/b"></a><script type="application/ld+json">{"title": "T"}</script>')], "id int, html string")
    assert [(r.link, r.text) for r in feeds.anchors(page).collect()] == [("/a", "One two"), ("/b", "")]
    assert feeds.embedded_json(page).first().payload == '{"title": "T"}'


def test_first_seen_and_processed(spark):
    rows = spark.createDataFrame([(1, "u"), (2, "u"), (3, ""), (4, None), (5, "v")], "n int, url string")
    assert sorted(r.n for r in feeds.first_seen_urls(rows, "url", ["n"]).collect()) == [1, 3, 4, 5]
    assert sorted(r.n for r in feeds.unprocessed(rows, rows.where("n > 2"), "n").collect()) == [1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "map.xml").write_text("<urlset><url><loc>a</loc><lastmod>2026-01-01</lastmod></url><url><loc>b</loc></url></urlset>")
    assert sorted((r.loc, r.lastmod) for r in feeds.sitemap(spark, str(tmp_path / "map.xml")).collect()) == [("a", "2026-01-01"), ("b", None)]
    folder = str(tmp_path / "log")
    feeds.append_log(spark.createDataFrame([(1, "x")], "n int, kind string"), folder)
    feeds.append_log(spark.createDataFrame([(2, "y")], "n int, kind string"), folder)
    assert sorted(r.n for r in feeds.json_lines(spark, folder, "n int, kind string").collect()) == [1, 2]


def test_fuzzy_join(spark):
    names = spark.createDataFrame([("senior data analyst",), ("data analyst senior",), ("Data Analyst, senior",), ("cook",), (None,)], "name string")
    got = {(r.a, r.b): r.ratio for r in matching.fuzzy_pairs(names, "name", least=90).collect()}
    assert got[("data analyst senior", "senior data analyst")] == 100 and all("cook" not in k for k in got)


def test_breaks_once_per_streak(spark, tmp_path):
    rows = [(i, f"2026-01-01 00:{i:02d}:00", "s", kind) for i, kind in enumerate("bbbbgbbgbbb")]
    df = spark.createDataFrame(rows, "event_id long, ts string, source string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.source(spark, str(tmp_path / "in"), df.schema)
    out = stateful.run_once(stateful.break_alerts(stream, "source", F.col("kind") == "b", F.col("kind") == "g"), "breaks_small")
    assert sorted(r.ts.minute for r in out.collect()) == [2, 10]


def test_fuzzy_blocking_loses_nothing(spark):
    """Every pair of names at the threshold meets, as against all pairs."""
    r = random.Random(4)
    words = ["stripe", "inc", "acme", "corp", "global", "health", "hinge", "labs", "river", "mountain", "analytics", "data", "group"]
    names = {"Acme Corp", "AcmeCorp", "Inc Stripe", "Stripe Inc", "acme corp holdings", "Acmee Corp"}
    for _ in range(120):
        own = [r.choice(words) for _ in range(r.randint(1, 4))]
        k = r.randrange(len(own))
        at = r.randrange(len(own[k]))
        own[k] = r.choice([own[k], own[k][:at] + own[k][at + 1 :], own[k][:at] + r.choice("aeiou") + own[k][at:]])
        names.add(" ".join(own).title())
    df = spark.createDataFrame([(n,) for n in [*names, None, "", "  "]], "name string")
    for kind, least in (("token_set", 85), ("token_sort", 85), ("token_set", 90)):
        got = {(x.a, x.b): x.ratio for x in matching.fuzzy_pairs(df, "name", least, kind).collect()}
        score = ratios._RATIOS[kind]
        assert got == {(a, b): score(a, b) for a in names for b in names if a < b and score(a, b) >= least}
    left, right = df.where("length(name) % 2 = 0"), df.where("length(name) % 2 = 1")
    got = {x.l_name: (x.ratio, x.r_name) for x in matching.best_fuzzy(left, right, "name", 90).collect()}
    even, odd = [n for n in names if len(n) % 2 == 0], [n for n in names if len(n) % 2]
    every = {n: max(((ratios.token_set_ratio(n, m), m) for m in odd), default=(0, "")) for n in even}
    assert got == {n: x for n, x in every.items() if x[0] >= 90}


def test_mail_signals(spark):
    rows = [
        ("Hinge Health Inc.", "Interview with Hinge Health", "x@mail.hingehealth.com", "Senior Product Designer", "the product designer role"),
        ("Acme", "Hello", "Acme Careers <no-reply@greenhouse.io>", "Data Engineer", "engineer wanted"),
        ("Acme", "Hello", "x@notgreenhouse.io", "Lead Data", "lead data"),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "company string, subject string, sender string, title string, body string")
    c = F.col
    got = df.select(
        mail.names_company(c("company"), c("subject"), c("sender")).alias("a"), mail.from_applicant_system(c("sender")).alias("b"),
        mail.from_company(c("sender"), c("company")).alias("c"), mail.names_title(c("title"), F.lower("body")).alias("d"), mail.company_of_sender(c("sender")).alias("e"),
    )
    assert [tuple(r) for r in got.collect()] == [(True, False, True, True, "Hingehealth"), (True, True, False, True, "Acme"), (False, False, False, False, "Notgreenhouse"), (False, False, False, False, None)]
    text = spark.createDataFrame([("Hi there. We would like to schedule time! Bye",)], "body string")
    assert text.select(mail.snippet(c("body"), ("offer", "schedule time"))).first()[0] == "We would like to schedule time!"


def test_payloads_are_made_and_read_once(spark):
    made = spark.createDataFrame([(1,)], "k int").select(F.to_json(F.struct(F.lit("t").alias("title"), F.col("k").alias("company"))).alias("payload"))
    found = feeds.postings(made)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("StructsToJsonEvaluator(") == 1
    assert [(r.title, r.company, r.location, r.url) for r in found.collect()] == [("t", "1", "Remote", None)]


def test_fields_of_odd_payloads(spark):
    rows = ['{"title": "a", "title": "b", "company": "c"}', '{"title": null, "name": " n ", "company": "c"}', '{"title": "a", "company": "c"', '[]', None, '{"job": {"label": "deep"}, "company": {"x": 1}}',
            '{"title": "a", "company": "c", "error": null}', '{"title": "a", "company": "c", "error": "e", "jobs": []}', '{"title": "a", "company": "c", "message": "m"}']
    got = feeds.postings(spark.createDataFrame([(r,) for r in rows], "payload string"), more={"title": ["job.label"]}).select("title", "company").collect()
    assert sorted(map(tuple, got)) == [("a", "c"), ("a", "c"), ("a", "c"), ("deep", '{"x":1}'), ("n", "c")]
