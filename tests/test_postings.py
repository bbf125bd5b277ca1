"""Locations, boards, factors, titles, links and field-level merging, by worked examples."""

import json

from pyspark.sql import functions as F

from hirelake.functions import content, fit, locations as L, urls
from hirelake.operators import postings as P
from hirelake.sources import boards


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


PARSED = [
    ("San Francisco, CA", [("San Francisco", "CA", "US", "UNSPECIFIED", False)]),
    ("San Francisco, CA / Remote", [("San Francisco", "CA", "US", "REMOTE", False)]),
    ("Remote - US", [(None, None, "US", "REMOTE", False)]),
    ("Remote, EMEA", [(None, None, None, "REMOTE", True)]),
    ("Multiple Locations", []),
    ("", []),
    (None, []),
    ("London, UK or Remote", [("London", None, "GB", "UNSPECIFIED", False), (None, None, None, "REMOTE", True)]),
    ("Berlin | Paris; Berlin", [("Berlin", None, "DE", "UNSPECIFIED", False), ("Paris", None, "FR", "UNSPECIFIED", False)]),
    ("Boulder, Colorado, United States", [("Boulder", "CO", "US", "UNSPECIFIED", False)]),
    ("Hybrid - Austin, TX", [("Austin", "TX", "US", "HYBRID", False)]),
    ("Toronto, ON, Canada", [("Toronto", None, "CA", "UNSPECIFIED", False)]),
    ("California", [(None, "CA", "US", "UNSPECIFIED", False)]),
    ("London", [("London", None, "GB", "UNSPECIFIED", False)]),
    ("Nowhereville", [(None, None, None, "UNSPECIFIED", True)]),
]


def test_locations(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PARSED)], "i int, x string").select("i", L.parsed(F.col("x")).alias("p"))
    got = {PARSED[r.i][0]: [(x.city, x.region_code, x.country_code, x.workplace_type, x.unresolved) for x in r.p] for r in df.collect()}
    assert got == dict(PARSED)


def test_location_helpers(spark):
    assert [one(spark, x, L.workplace_label) for x in ("On-site", "remote ", "HYBRID", "other", None)] == ["ONSITE", "REMOTE", "HYBRID", "UNSPECIFIED", "UNSPECIFIED"]
    assert one(spark, "text #LI-Remote here", L.tagged_workplace) == "REMOTE" and one(spark, "remote chance", L.tagged_workplace) == "UNSPECIFIED"
    assert [one(spark, x, L.display) for x in ("SAN FRANCISCO, California 94105, US", "Austin, Texas (+2 others)", "Paris, France")] == ["San Francisco, CA", "Austin, TX", "Paris, France"]
    df = spark.createDataFrame([("Berlin; Remote", "Berlin / Hybrid | Remote | Paris")], "a string, b string").select(L.merged(L.parsed(F.col("a")), L.parsed(F.col("b"))).alias("m"))
    assert [(x.city, x.workplace_type) for x in df.first().m] == [("Berlin", "UNSPECIFIED"), (None, "REMOTE"), (None, "HYBRID"), ("Paris", "UNSPECIFIED")]
    df = spark.createDataFrame([("Berlin", "Berlin / Hybrid")], "a string, b string").select(L.merged(L.parsed(F.col("a")), L.parsed(F.col("b"))).alias("m"))
    assert [(x.city, x.workplace_type) for x in df.first().m] == [("Berlin", "HYBRID")]


def test_links(spark):
    cases = {
        "https://boards.greenhouse.io/acme/jobs/123?gh_src=x": ("greenhouse", "acme", "123"), "https://jobs.lever.co/Acme/0a1b2c3d-0000-1111-2222-333344445555/apply": ("lever", "acme", "0a1b2c3d-0000-1111-2222-333344445555"),
        "https://acme.wd5.myworkdayjobs.com/en-US/site/job/Rome/Engineer_JR-1234": ("workday", "acme", "JR-1234"), "https://acme.breezy.hr/p/x": ("breezy", "acme", None), "https://example.com/jobs/9": (None, None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").withColumn("b", urls.board(F.col("u")))
    got = df.select("u", "b.platform", "b.slug", urls.posting_id(F.col("u"), F.col("b.platform")).alias("i")).collect()
    assert {r.u: (r.platform, r.slug, r.i) for r in got} == cases
    assert one(spark, "Stripe, Inc.", urls.slug_candidates) == ["stripe"] and one(spark, "Scale AI", urls.slug_candidates) == ["scale-ai", "scaleai"]
    every = ["https://a.com/x", "https://jobs.lever.co/acme/1", "https://b.org/y", "https://a.com/x"]
    assert one(spark, every, urls.first_hosted, "array<string>") == every[1]
    assert one(spark, every, lambda x: urls.first_board(x)["slug"], "array<string>") == "acme"
    assert one(spark, every, lambda x: urls.ranked_results(x, ("b.org",), ("lever.co", "a.com")), "array<string>") == [every[1], every[0]]
    assert tuple(one(spark, every, lambda x: urls.direct_link(x, F.lit("z"), F.lit(None)), "array<string>")) == (every[1], "source")
    assert one(spark, [" ", "https://s"], lambda x: urls.apply_link(F.lit(None), F.lit("l"), x, F.lit(False)), "array<string>") == "https://s"
    assert one(spark, [" ", "https://s"], lambda x: urls.apply_link(F.lit("d"), F.lit("l"), x, F.lit(True)), "array<string>") == "https://s"
    assert [one(spark, x, urls.is_posting) for x in ("https://a.com/jobs/1", "https://a.com/about", None)] == [True, False, False]
    assert [one(spark, x, lambda c: urls.slug_strength(c, F.lit("acme-labs"))) for x in ("Acme Labs", "Acme Foods", "Other")] == [3, 2, 0]


def test_titles_and_bodies(spark):
    cases = {
        "Data Engineer - Remote (US)": "Data Engineer", "Data Engineer - New York, NY": "Data Engineer", "Data EngineerPosted 3 days ago": "Data Engineer", "CSenior Vice President": "Senior Vice President",
        "AnalystREQ123 foo": "Analyst", "IT Manager": "IT Manager", "Remote": "Remote",
    }
    assert {t: one(spark, t, content.clean_title) for t in cases} == cases
    html = "<div><p>Hello&nbsp;<b>World</b></p><script>x<y</script><ul><li>One</li><li>Two &amp; three</li></ul><p>Hello World</p></div>"
    assert one(spark, html, content.html_to_text) == "Hello World\n\n- One\n\n- Two & three\n\nHello World" and one(spark, "a < b and c", content.plain_body) == "a < b and c"
    assert one(spark, html, content.clean_html).count("Hello World") == 1
    df = spark.createDataFrame([("ab", "c", "u"), ("abc", "c", "u"), ("a" * 201, "c", "u"), ("abc", " ", "u"), ("abc", "c", None)], "t string, c string, u string")
    assert [r[0] for r in df.select(content.is_valid_posting(F.col("t"), F.col("c"), F.col("u"))).collect()] == [False, True, False, False, False]
    assert one(spark, ["San Francisco, CA"], lambda x: content.title_bleeds(F.lit("Engineer (all) San Francisco"), x), "array<string>") and not one(spark, ["Rome"], lambda x: content.title_bleeds(F.lit("Engineer"), x), "array<string>")
    assert [one(spark, x, content.error_kind) for x in ("401 Unauthorized", "timeout", None)] == ["credential", "degraded", "degraded"]
    assert [one(spark, x, content.resume_index) for x in (None, "static", "unheard")] == [0, 1, len(content.TIERS)]
    assert [one(spark, x, content.may_enrich) for x in (None, "static", "agentic")] == [True, True, False]
    assert tuple(one(spark, "Engineer - Acme", content.title_and_company)) == ("Engineer", "Acme") and one(spark, "Engineer", content.title_and_company).company is None
    assert [one(spark, x, lambda c: content.one_of(c, ("full_time", "part_time"))) for x in ("Full Time", "part-time job", "other", None)] == ["full_time", "part_time", None, None]
    assert [one(spark, x, content.surface_of) for x in ("ats:lever", "careers", "linkedin")] == ["ats", "careers", "email"]
    assert one(spark, [23, 5], content.shifted_hours, "array<int>") == [0, 6]
    assert [one(spark, x, content.remote_flag) for x in (None, "false", "true", '{"label": "x"}')] == [None, False, True, True]
    assert one(spark, '{"a": 1}', lambda c: content.json_or(c, "a int", F.struct(F.lit(0).alias("a")))["a"]) == 1 and one(spark, None, lambda c: content.json_or(c, "a int", F.struct(F.lit(0).alias("a")))["a"]) == 0
    assert one(spark, "body text. Similar jobs: x. Share", lambda c: content.without_chrome(c, ("Share", "Similar jobs"))) == "body text."
    assert [one(spark, x, content.is_candidate_line) for x in ("Data Engineer", "http://x", "ab", "Unsubscribe here")] == [True, False, False, False]
    assert one(spark, "The  IBM!", lambda c: content.is_blocked_brand(c, ("the ibm", "Apple")))


def test_factors(spark):
    assert [one(spark, x, lambda c: fit.title_factor(c, ("Data Scientist",), ("intern",))) for x in ("Scientist Data", "Data Scientist Intern", "Cook")] == [100, 0, 11]
    assert [one(spark, x, lambda c: fit.place_factor(c, ("New York",))) for x in ("Remote", "USA", "New York City", "York")] == [100, 90, 100, 100]
    assert [one(spark, x, lambda c: fit.company_factor(c, ("Evil",))) for x in ("EVIL", "Good", None)] == [0, 50, 50]
    assert one(spark, "x", lambda c: fit.title_factor(c, ())) == 50 and one(spark, "x", lambda c: fit.place_factor(c, ())) == 50


def test_board_records(spark):
    payloads = {
        "greenhouse": {"title": "Dev", "absolute_url": "u", "location": {"name": "Austin, TX"}, "content": "<p>Hi</p>", "pay_input_ranges": [{"min_cents": 10000000, "max_cents": 12000000, "currency_type": "usd", "title": "Annual"}], "first_published": "2026-01-02T00:00:00Z", "id": 7},
        "lever": {"text": "Dev", "hostedUrl": "u", "categories": {"team": "Rome"}, "createdAt": 1767312000000, "id": "q", "workplaceType": "remote", "salaryRange": {"min": 50, "max": 60, "interval": "per-hour-wage", "currency": "USD"}},
        "ashby": {"title": "Dev", "jobUrl": "u", "isRemote": True, "descriptionHtml": "<b>Hi</b>", "id": "a"},
        "smartrecruiters": {"name": "Dev", "id": "9", "location": {"city": "Paris", "country": "fr"}},
        "workday": {"title": "Dev", "externalPath": "/site/job/Dev_R-12", "locationsText": "Rome"},
        "phenom": {"loc": "https://x.com/job/data-engineer-12345678"},
    }
    got = {}
    for platform, value in payloads.items():
        df = spark.createDataFrame([(json.dumps(value), "acme"), ("{}", "acme"), (None, "acme")], "payload string, slug string")
        rows = boards.records(df, platform, slug="slug").collect()
        assert len(rows) == 1, platform
        got[platform] = rows[0]
    g = got["greenhouse"]
    assert (g.title, g.url, g.body, g.pay_low, g.pay_high, g.period, g.currency, g.posted.year, g.posted_precision, g.source_id, g.locations[0].city) == ("Dev", "u", "Hi", 100000.0, 120000.0, "annual", "USD", 2026, "exact", "7", "Austin")
    assert (got["lever"].location, got["lever"].is_remote, got["lever"].period, got["lever"].posted.year, got["lever"].body) == ("Rome", True, "hourly", 2026, None)
    assert (got["ashby"].location, got["ashby"].body, got["ashby"].posted_precision) == ("Remote", "Hi", None)
    assert (got["smartrecruiters"].url, got["smartrecruiters"].location) == ("https://jobs.smartrecruiters.com/acme/9", "Paris, fr")
    assert (got["workday"].url, got["workday"].source_id) == ("https://acme.myworkdayjobs.com/site/job/Dev_R-12", "R-12")
    assert got["phenom"].title == "Data Engineer" and got["phenom"].locations == []
    for platform in ("recruitee", "ultipro", "amazon"):
        assert boards.records(spark.createDataFrame([("{}", "s")], "payload string, slug string"), platform, slug="slug").count() == 0
    gated = boards.records(spark.createDataFrame([('{"text": "Cook", "hostedUrl": "u"}',), ('{"text": "Data Engineer", "hostedUrl": "u"}',)], "payload string"), "lever", wanted=("data engineer",))
    assert [r.title for r in gated.collect()] == ["Data Engineer"]


SNAPSHOT = (
    "dedup_key string, company_id long, source_id string, title string, company string, sources array<string>, source_urls array<string>, locations_raw array<string>, "
    f"locations array<{L.KIND}>, description string, body string, salary_min double, salary_max double, salary_provenance string, posted_date timestamp, posted_precision string, "
    "workplace_type string, country_code string, first_seen timestamp, last_seen timestamp, status string, is_stale boolean, expired_at timestamp"
)


def posting(spark, *rows):
    names = [f.split(" ")[0] for f in SNAPSHOT.replace("array<struct<" + L.KIND[7:-1] + ">>", "x").split(", ")]
    kinds = spark.createDataFrame([], SNAPSHOT).schema
    assert len(names) == len(kinds)
    base = spark.createDataFrame([json.dumps({"sources": ["a"], "source_urls": ["u"], "last_seen": "2026-01-05T00:00:00Z"} | r) for r in rows], "string")
    return base.select(F.from_json("value", kinds).alias("r")).select("r.*")


def test_upserted(spark):
    body = "A real description of the work. " * 20
    old = posting(
        spark,
        {"dedup_key": "k1", "title": "T", "salary_min": 50000, "salary_max": 60000, "salary_provenance": "jd_regex", "posted_date": "2026-01-01T00:00:00Z", "posted_precision": "approximate", "status": "reviewing", "locations_raw": ["Rome"], "first_seen": "2026-01-01T00:00:00Z", "workplace_type": "REMOTE"},
        {"dedup_key": "k2", "title": "T2", "company_id": 5, "source_id": "s", "status": "archived", "is_stale": True, "expired_at": "2026-01-03T00:00:00Z", "first_seen": "2026-01-01T00:00:00Z"},
        {"dedup_key": "k3", "title": "T3", "status": "applied", "first_seen": "2026-01-01T00:00:00Z"},
        {"dedup_key": "k4", "title": "T4", "status": "applied", "first_seen": "2026-01-01T00:00:00Z"},
    )
    new = posting(
        spark,
        {"dedup_key": "k1", "title": "other", "salary_min": 1, "salary_max": 2, "salary_provenance": "feed_string", "posted_date": "2026-01-02T00:00:00Z", "posted_precision": "exact", "locations_raw": ["rome", "Remote"], "body": body, "workplace_type": "UNSPECIFIED", "country_code": "IT", "last_seen": "2026-01-06T00:00:00Z"},
        {"dedup_key": "other", "title": "T2", "company_id": 5, "source_id": "s", "sources": ["b"], "last_seen": "2026-01-07T00:00:00Z"},
        {"dedup_key": "k3", "title": "T3", "last_seen": "2026-01-08T00:00:00Z"},
        {"dedup_key": "k5", "title": "N", "posted_date": "2026-01-02T00:00:00Z", "salary_min": 90000, "salary_max": 80000},
        {"dedup_key": "k5", "title": "N", "sources": ["c"], "last_seen": "2026-01-09T00:00:00Z"},
    )
    got = {r.dedup_key: r for r in P.upserted(old, new).collect()}
    assert {k: (r.kind, r.reopened) for k, r in got.items()} == {"k1": ("updated", False), "k2": ("touched", True), "k3": ("unchanged", False), "k4": ("unchanged", False), "k5": ("inserted", False)}
    a = got["k1"]
    assert (a.title, a.salary_min, a.salary_provenance, a.posted_precision, a.posted_date.day, a.locations_raw, a.workplace_type, a.country_code, a.body, a.last_seen.day) == ("T", 50000, "jd_regex", "exact", 2, ["Remote", "Rome"], "REMOTE", "IT", body, 6)
    assert (got["k2"].status, got["k2"].is_stale, got["k2"].expired_at, got["k2"].sources) == ("discovered", False, None, ["a", "b"])
    n = got["k5"]
    assert (n.salary_min, n.salary_max, n.posted_precision, n.first_seen.day, n.sources, n.status) == (80000, 90000, "proxy", 2, ["a", "c"], "discovered")
    assert P.upserted(old.limit(0), new.limit(0)).count() == 0


def test_single_field_writes(spark):
    body = "A real description of the work. " * 20
    rows = spark.createDataFrame([(1, "old", 5), (2, body, 4), (3, None, 3)], "dedup_key int, body string, score int")
    new = spark.createDataFrame([(1, body), (2, body), (3, "404")], "dedup_key int, body string")
    assert sorted(map(tuple, P.with_bodies(rows, new, "dedup_key", ("score",)).collect())) == [(1, body, None), (2, body, 4), (3, None, 3)]
    assert sorted(map(tuple, P.without_bodies(rows, F.col("body") == "old", ("score",)).collect()), key=str) == sorted([(1, None, None), (2, body, 4), (3, None, 3)], key=str)
    jobs = spark.createDataFrame([(1, 9, "a"), (2, 9, None), (3, 9, None), (4, 8, None)], "dedup_key int, company_id int, source_id string")
    ids = spark.createDataFrame([(2, "a"), (3, "b"), (4, "a")], "dedup_key int, source_id string")
    assert {r.dedup_key: r.source_id for r in P.with_source_ids(jobs, ids).collect()} == {1: "a", 2: None, 3: "b", 4: "a"}
    kept, companies = P.without_denied(jobs, spark.createDataFrame([(8,), (9,)], "company_id int"), spark.createDataFrame([(9,)], "company_id int"))
    assert {r.dedup_key: r.company_id for r in kept.collect()} == {1: None, 2: None, 3: None, 4: 8} and [r[0] for r in companies.collect()] == [8]
    assert one(spark, [1, 2], lambda x: P.merged_observations(x, F.array(F.lit(2), F.lit(3)), 2), "array<int>") == [2, 3]
    assert [one(spark, x, lambda c: P.guarded_side(c, F.lit(50_000.0)), "double") for x in (60_000.0, 900_000.0, None)] == [60_000.0, None, None]
    tried = P.stamped_attempts(spark.createDataFrame([(1, None, None), (2, 1, None)], "k int, attempts int, checked_at timestamp"), spark.createDataFrame([(1,), (1,)], "k int"), "k", F.lit("2026-01-01").cast("timestamp"))
    assert {r.k: (r.attempts, r.checked_at is None) for r in tried.collect()} == {1: (2, False), 2: (1, True)}
    at = F.lit("2026-03-01").cast("timestamp")
    assert [one(spark, x, lambda c: P.may_try(c, F.lit("2026-01-01").cast("timestamp"), at), "int") for x in (2, 3)] == [True, True] and not one(spark, 3, lambda c: P.may_try(c, at, at), "int")


def test_boards_of_more_platforms(spark):
    long = "0f8fad5b-d9cb-469f-a165-70867728950e"
    cases = {
        "https://boards-api.greenhouse.io/v1/boards/Acme/jobs/12": ("greenhouse", "acme", "12"), "https://api.lever.co/v0/postings/acme?mode=json": ("lever", "acme", None), "https://api.ashbyhq.com/posting-api/job-board/acme": ("ashby", "acme", None),
        "https://api.smartrecruiters.com/v1/companies/acme/postings": ("smartrecruiters", "acme", None), f"https://acme.pinpointhq.com/en/postings/{long}": ("pinpoint", "acme", long), f"https://ats.rippling.com/en-GB/acme/jobs/{long}": ("rippling", "acme", long),
        f"https://recruiting.paylocity.com/recruiting/jobs/All/{long}/Acme": ("paylocity", long, None), "https://career5.successfactors.eu/career?company=acme&career_job_req_id=77": ("successfactors", "acme", "77"),
        "https://acme.fa.em2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX/job/990": ("oracle_cloud", "acme", "990"), f"https://recruiting2.ultipro.com/ACM1000/JobBoard/x/OpportunityDetail?opportunityId={long}": ("ultipro", "acm1000", long),
        "https://acme.eightfold.ai/careers/job/555": ("eightfold", "acme", "555"), f"https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid={long}&jobId=42": ("adp", long, "42"),
        "https://apply.workable.com/acme/j/0123456789/": ("workable", "acme", "0123456789"), "https://acme.breezy.hr/p/0123456789ab-dev": ("breezy", "acme", "0123456789ab"), "https://acme.bamboohr.com/careers/31": ("bamboohr", "acme", "31"),
        "https://acme.teamtailor.com/jobs/88-dev": ("teamtailor", "acme", "88"), "https://acme.jobs.personio.de/job/66": ("personio", "acme", "66"), "https://careers-acme.icims.com/jobs/17/dev/job": ("icims", "acme", "17"), "https://example.org/jobs/1": (None, None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").withColumn("b", urls.board(F.col("u")))
    got = {r.u: (r.platform, r.slug, r.i) for r in df.select("u", "b.platform", "b.slug", urls.posting_id(F.col("u"), F.col("b.platform")).alias("i")).collect()}
    assert got == cases
