"""Worked examples of the posting functions."""

import pytest
from pyspark.sql import functions as F

from hirelake.functions import content, fit, names, ratios, salary, urls
from hirelake.operators import evals, lifecycle, matching, merge


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [
    ("Apple", "apple"), ("Acme, Inc.", "acme"), ("Acme Corp", "acme"), ("Acme Holdings LLC", "acme"), ("Tom &amp; Co.", "tom &"),
    ("<b>Acme</b>  Ltd", "acme"), ("091 Acme Inc", "acme"), ("KPG99 INC", "kpg99"), ("A10 Networks, Inc", "a10 networks"), ("3. Acme", "acme"), ("21", "21"),
])
def test_company_key(spark, given, want):
    assert one(spark, names.company_key(F.lit(given))) == want


@pytest.mark.parametrize("given, want", [
    ("Sr. Data Scientist", "senior data scientist"), ("Senior Data Scientist (IC5)", "senior data scientist"), ("Engineer Level 3", "engineer"),
    ("84Data Scientist Jobs", "84 data scientist jobs"), ("Jr Mgr", "junior manager"), ("  VP.  Sales ", "vice president sales"),
])
def test_title_key(spark, given, want):
    assert one(spark, names.title_key(F.lit(given))) == want


def test_title_passes(spark):
    test = lambda t, want, no=(): one(spark, names.title_passes(F.lit(t), want, no))
    assert test("Sr DS, Growth", ("senior data scientist",))
    assert test("Senior Manager, Data Analytics", ("senior manager analytics",))
    assert not test("Senior Marketing Manager - Hiring Help for Data Analyst", ("senior data analyst",))
    assert not test("Leadership Coach", ("lead",))
    assert not test("Senior Data Scientist Intern", ("senior data scientist",), ("intern",))


@pytest.mark.parametrize("text, want", [
    ("$120K - $150K", (120000, 150000, "unknown")), ("$120 - $150", (120000, 150000, "unknown")), ("$42 - $51 an hour", (42, 51, "hourly")), ("starting at $120K", None),
])
def test_salary_text(spark, text, want):
    got = one(spark, salary.observed(F.lit(text), F.lit("feed_string")))
    assert (got and (got.min_value, got.max_value, got.period)) == want


@pytest.mark.parametrize("low, high, period, provenance, want", [
    (42.0, 51.0, "hourly", "feed_string", (87360, 106080, "salvaged_hourly")), (None, None, "annual", "x", (None, None, "empty")),
    (150000.0, 120000.0, "annual", "x", (120000, 150000, "ok")), (4000000.0, 40000.0, "annual", "x", (None, None, "implausible")),
    (12000000.0, 15000000.0, "unknown", "ats_structured", (120000, 150000, "salvaged_cents")), (12000000.0, 15000000.0, "unknown", "jd_regex", (None, None, "implausible")),
    (100000.0, None, "odd", "x", (100000, None, "ok")),
])
def test_salary_ladder(spark, low, high, period, provenance, want):
    got = one(spark, salary.normalized(F.lit(low).cast("double"), F.lit(high).cast("double"), F.lit(period), F.lit(provenance)))
    assert (got.salary_min, got.salary_max, got.resolution) == want


@pytest.mark.parametrize("axes, want", [
    ((4, 4, 4, 4, 4, 4), "apply"), ((3, 3, 3, 3, 3, 3), "low_signal"), ((4, 4, 4, 3, 3, 3), "apply"), ((1, 5, 5, 5, 5, 5), "reject"), ((2, 3, 3, 3, 3, 3), "consider"), ((0, 3, 3, 3, 3, 3), None),
])
def test_classified(spark, axes, want):
    none = F.lit(None).cast("string")
    assert one(spark, fit.classified([F.lit(a) for a in axes], none, none, F.lit(None).cast("int"), F.lit(False))) == want


def test_location_fit(spark):
    place = "struct(cast(null as string) city, cast(null as string) region, cast(null as string) country, cast({c} as string) country_code, '{w}' workplace_type)"
    at = lambda *p: F.expr(f"array({','.join(place.format(c=c, w=w) for c, w in p)})")
    go = lambda locs, *a, **k: one(spark, fit.location_fit(locs, *a, **k))
    assert go(at(("null", "REMOTE")), ("remote",)) == 5
    assert go(at(("'US'", "REMOTE")), ("remote",), home="US") == 5
    assert go(at(("'FR'", "REMOTE")), ("remote",), home="US") == 1
    assert go(at(("'FR'", "ONSITE")), ("paris",), home="US") == 1
    assert go(at(("'US'", "ONSITE")), ("paris",), prefers_remote=True) == 1
    assert go(at(("'US'", "ONSITE")), ("paris",)) is None


def test_content(spark):
    assert one(spark, content.is_listing_tile(F.lit("1,200+ openings"))) is True
    assert one(spark, content.is_listing_tile(F.lit("84 Data Scientist Jobs"))) is True
    assert one(spark, content.is_metadata_blob(F.lit("Analyst SQL2354308|Chennai"))) is True
    assert one(spark, content.title_reason(F.lit("Join our talent network"))) == "title_non_posting"
    assert one(spark, content.title_reason(F.lit(" "))) == "title_invalid_shape"
    assert one(spark, content.body_reject(F.lit("Just a moment... checking"))).signal == "head_block_or_wiki"
    assert one(spark, content.body_reject(F.lit("x" * 500 + " this job has closed "))).reason == "jd_full_expired"
    assert one(spark, content.mail_kind(F.lit("Update"), F.lit("Unfortunately we ... interview"))) == "rejection"
    assert one(spark, content.without_repeated_blocks(F.lit("A b\n\nc\n\na  B\n\nd"))) == "A b\n\nc\n\nd"
    assert one(spark, content.scrubbed(F.lit("To: me\nHi a@b.org"))) == "Hi [email]"


def test_urls(spark):
    c = lambda u: one(spark, urls.canonical(F.lit(u)))
    assert c("HTTPS://Ex.Org/Path?utm_source=1&b=2&a=1#x") == "https://ex.org/Path?a=1&b=2#x"
    assert c("not a url") == "not a url" and c("") == ""
    assert one(spark, urls.title_from_slug(F.lit("https://x.org/jobs/senior-data-scientist-12345"))) == "Senior Data Scientist"
    assert one(spark, urls.under(F.lit("https://a.lever.co/x"), ("lever.co",))) is True


def test_matching():
    assert ratios.ratio("abc", "abc") == 100 and ratios.ratio("", "") == 100 and ratios.ratio("abc", "xyz") == 0
    assert ratios.token_sort_ratio("data scientist senior", "senior data scientist") == 100
    assert ratios.token_set_ratio("acme corp", "acme corp holdings") == 100
    assert ratios.partial_ratio("york", "new york city") == 100


def test_merge(spark):
    assert one(spark, merge.merged_places(F.array(F.lit("Paris")), F.array(F.lit("paris"), F.lit("Remote"), F.lit("Rome"), F.lit("Hybrid")))) == ["Hybrid", "Remote", "Paris", "Rome"]
    assert one(spark, merge.merged_text(F.lit("ab"), F.lit("b"))) == "ab"
    assert one(spark, merge.merged_text(F.lit("a"), F.lit("c"))) == "a\n\n---\n\nc"
    old = spark.createDataFrame([(1, 5, 1), (2, 6, 1), (3, 7, 1)], "k int, v int, t int")
    new = spark.createDataFrame([(1, 9, 3), (1, None, 4), (2, 6, 2), (4, 1, 2)], "k int, v int, t int")
    got = {r.k: (r.v, r.kind) for r in merge.upsert(old, new, "k", "v", "t").collect()}
    assert got == {1: (9, "updated"), 2: (6, "touched"), 3: (7, "unchanged"), 4: (1, "inserted")}
    again = merge.upsert(merge.upsert(old, new, "k", "v", "t").select("k", "v", F.col("last_seen").alias("t")), new, "k", "v", "t")
    assert {r.kind for r in again.collect()} <= {"touched", "unchanged"}


def test_lifecycle_and_evals(spark):
    s = lambda *a: one(spark, lifecycle.computed_status(*[F.lit(x) for x in a]))
    assert s("applied", "expired", True) == "applied" and s("technical", "expired", True) == "expired" and s("reviewing", None, True) == "stale" and s(None, None, None) == "active"
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "a double, b double")
    assert evals.errors(pairs, "a", "b").first().mae == 2
    assert evals.errors(pairs.limit(0), "a", "b").first().mae is None
    assert evals.weighted_kappa(spark.createDataFrame([(1, 1), (5, 5), (9, 1)], "a int, b int"), "a", "b").first().kappa == 1.0
    assert one(spark, evals.retry_gate(F.lit(5), F.lit(10))) == "SUPPRESSED"


def test_places(spark):
    from datetime import date

    from hirelake.functions import places

    assert one(spark, places.places(F.lit("Paris, | N/A; paris / Rome or  Remote "))) == ["Paris", "Rome", "Remote"]
    assert one(spark, places.workplace(F.lit("Hybrid or remote"))) == "REMOTE" and one(spark, places.workplace(F.lit(None).cast("string"))) == "UNSPECIFIED"
    assert tuple(one(spark, places.platform(F.lit("https://boards.greenhouse.io/acme/jobs/1")))) == ("greenhouse", "acme")
    assert places.business_days_before(date(2026, 4, 6), 3) == date(2026, 4, 1)
    assert places.business_days_before(date(2026, 4, 5), 1) == date(2026, 4, 3)


def test_contract(spark):
    from hirelake.operators import contract

    raw = spark.createDataFrame([("84 Data Jobs", "x", "a"), ("Analyst", None, "Bad Co"), ("Join our talent network", None, "a"), ("Data Engineer", "short", "a"), ("Data Engineer", None, "a")], "title string, body string, company string")
    denied = spark.createDataFrame([("bad co",)], "name string")
    got = [(r.route, r.reasons, r.body) for r in contract.routed(raw, denied).collect()]
    assert [g[0] for g in got] == ["dropped", "dropped", "quarantined", "quarantined", "clean"]
    assert got[3][1] == ["jd_full_junk"] and got[3][2] is None and got[2][1] == ["title_non_posting"]


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 10)) for i in range(400)], "k int, g int, v double")
    for r in evals.bootstrap_mean(df, "k", "v", "g").collect():
        assert r.low < r["mean"] < r.high and r.high - r.low < 2


def test_numbered_entities(spark):
    from hirelake.functions import blocks, content, names

    text = "a&#8217;b &#x1F600; &#39;c&#39; &amp;#39; &#0; &#1114112; &#xD800; &lt;&rsquo; &#34;q&#92;"
    want = "a’b \U0001f600 'c' &#39; &#0; &#1114112; &#xD800; <’ \"q\\"
    assert one(spark, names.unescaped(F.lit(text))) == want and one(spark, names.unescaped(F.lit(None).cast("string"))) is None
    assert one(spark, content.html_to_text(F.lit(f"<p>{text}</p>"))) == want
    assert one(spark, blocks.blocks(F.lit("<p>x&#8211;y</p>")))[0].text == "x–y"


def test_salary_text_is_read_once(spark):
    """However much a text is made of, it stands once in the plan; steps don't repeat those before them."""
    text = F.concat(F.lit("pays $"), F.col("id").cast("string"), F.lit("0K - $"), (F.col("id") + 3).cast("string"), F.lit("0K zzz"))
    df = spark.range(7, 9).select("id", salary.from_text(text).alias("p")).select("id", "p.*")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(7, 70_000, 100_000), (8, 80_000, 110_000)]
    assert df._jdf.queryExecution().analyzed().toString().count("0K zzz") == 1
