"""Worked examples of companies, records, health and mail that the queries don't show."""

from pyspark.sql import functions as F

from hirelake.operators import companies as C, evals as E, health as H, records as K
from hirelake.sources import mailbox


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_linked(spark):
    jobs = spark.createDataFrame([("Acme Inc",), ("ACME, Inc.",), ("Globex Systems",), ("Nobody",), ("Spam Co",), (" ",), (None,)], "company string")
    known = spark.createDataFrame([("acme",), ("Systems Globex",)], "company string")
    got = rows(C.linked(jobs, known, spark.createDataFrame([("spam",)], "name string")), "name", "company", "how")
    assert got == [("ACME, Inc.", "acme", "exact"), ("Acme Inc", "acme", "exact"), ("Globex Systems", "Systems Globex", "fuzzy"), ("Nobody", "Nobody", "created"), ("Spam Co", None, "denied")]


def test_upsert_of_empty_and_contested(spark):
    shape = "name string, platform string, slug string, probe string, homepage string"
    none = spark.createDataFrame([], shape)
    new = spark.createDataFrame([("a", "lever", "x", "hit", None, 1), ("b", "lever", "x", "hit", "h", 2), (None, "lever", "y", "hit", None, 3)], shape + ", seen int")
    assert rows(C.upserted_companies(none, new), "name", "slug", "probe", "kind") == [("a", None, "hit", "inserted"), ("b", None, "hit", "inserted")]
    old = spark.createDataFrame([("a", "lever", "x", "hit", None)], shape)
    less = spark.createDataFrame([("a", None, None, "miss", "h", 1)], shape + ", seen int")
    assert rows(C.upserted_companies(old, less), "slug", "probe", "homepage", "kind") == [("x", "hit", "h", "updated")]
    assert rows(C.upserted_companies(old, new.limit(0)), "slug", "kind") == [("x", "unchanged")]


def test_healed_moves_jobs(spark):
    companies = spark.createDataFrame([(1, "Top Jobs", "lever", "nielsen"), (2, "Nielsen Media", None, None), (3, "Other", None, None)], "company_id int, company string, platform string, slug string")
    jobs = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "dedup_key int, company_id int")
    after, moved = C.healed_slugs(companies, jobs)
    assert rows(after, "company_id", "slug") == [(1, None), (2, "nielsen"), (3, None)]
    assert rows(moved.where("company_id IS NOT NULL"), "dedup_key", "company_id") == [(10, 2), (11, 3)]


def test_recommended(spark):
    shape = "model string, site string, verdict string, secondary double, uniformity double, retry double, latency double, memory double"
    line = lambda m, s, v, lat=1.0: (m, s, v, None, 0.0, 0.0, lat, 0.0)
    got = E.recommended(spark.createDataFrame([line("a", "x", "PASS"), line("a", "y", "WARN"), line("b", "x", "PASS", 9.0), line("b", "y", "PASS", 9.0), line("c", "x", "PASS", 5.0), line("c", "y", "PASS", 5.0)], shape))
    assert rows(got, "site", "model", "mode") == [("x", "c", "single"), ("y", "c", "single")]
    assert E.recommended(spark.createDataFrame([], shape)).count() == 0


def test_records_with_nulls(spark):
    work = spark.createDataFrame([(1, None, None, None), (2, "cancelled", "e", "t")], "id int, status string, error string, finished string")
    assert rows(K.reaped(work, F.lit("now")), "id", "status", "error", "finished") == [(1, "error", "interrupted", "now"), (2, "cancelled", "e", "t")]
    looks = spark.createDataFrame([(1, "perhaps", 1)], "detection_id int, resolution string, at int")
    kept = K.resolved(spark.createDataFrame([(1, "pending", None)], "detection_id int, status string, resolved_at int"), looks)
    assert rows(kept, "status", "resolved_at") == [("pending", None)]


def test_verdict(spark):
    none = F.array().cast("array<string>")
    one = lambda *a: tuple(spark.range(1).select(H.verdict(*a).alias("v")).select("v.*").first())
    assert one(F.lit(None).cast("boolean"), F.lit("t"), F.lit("ok"), F.lit(False), none) == ("down", 2, ["no live process"])
    assert one(F.lit(True), F.lit("t"), F.lit("unreadable"), F.lit(True), none) == ("down", 2, ["heartbeat unreadable"])
    assert one(F.lit(True), F.lit("t"), F.lit("ok"), F.lit(False), none) == ("ok", 0, [])


def test_links_in_mail(spark):
    bodies = [("Title\nData Engineer https://jobs.lever.co/a/1) more\nAcme",), ("https://jobs.lever.co/a/1\nAcme",), (None,), ("",)]
    got = mailbox.linked_postings(spark.createDataFrame(bodies, "body string"))
    assert rows(got, "title", "company", "url") == [("Data Engineer", "more", "https://jobs.lever.co/a/1")]
    none = F.array().cast("array<string>")
    assert spark.range(1).select(mailbox.first_found(none, F.array(F.lit("x")), F.array(F.lit("y")))).first()[0] == ["x"]


def test_misplaced_slugs_against_all_pairs(spark):
    """Every pair compared, on names with common words, short slugs and equal candidates."""
    import random

    from hirelake.functions.urls import slug_strength

    r = random.Random(4)
    words = ["inc", "acme", "jobs", "data", "ab", "nova", "acmedata", "north", "media"]
    text = lambda n, sep: sep.join(r.choice(words) for _ in range(r.randint(1, n)))
    table = [(i, f"Top Jobs {i}", "lever", text(3, r.choice(["-", "", "."]))) for i in range(40)] + [(100 + i, text(3, " ").title(), None, None) for i in range(60)]
    companies = spark.createDataFrame(table, "company_id int, company string, platform string, slug string")
    got = {x.owner_id: (x.candidate_id, x.strength) for x in C.misplaced_slugs(companies).collect()}
    both = companies.where("platform IS NOT NULL").alias("o").join(companies.where("platform IS NULL").alias("c"))
    strength = both.select(F.col("o.company_id").alias("own"), F.col("o.slug").alias("slug"), F.col("c.company_id").alias("cand"), F.lower(F.regexp_replace("c.company", "[^A-Za-z0-9]", "")).alias("name"), slug_strength(F.col("c.company"), F.col("o.slug")).alias("s")).collect()
    want = {}
    for x in strength:
        plain = "".join(ch for ch in x.slug if ch.isalnum())
        if x.s >= 2 and (min(len(plain), len(x.name)) >= 3 or plain == x.name):
            want[x.own] = max(want.get(x.own, (0, 0)), (x.s, -x.cand))
    assert got == {o: (-c, s) for o, (s, c) in want.items()}


def test_misplaced_slugs_send_no_table_by_the_driver(spark):
    """Strings of texts are many times the texts, so none of their joins may be a broadcast, however small the tables look."""
    table = [(i, f"Top Jobs {i}", "lever", f"slug{i:07d}") for i in range(20)] + [(100 + i, f"Slug{i:07d} Inc", None, None) for i in range(20)]
    companies = spark.createDataFrame(table, "company_id int, company string, platform string, slug string")
    found = C.misplaced_slugs(companies)
    assert {(x.owner_id, x.candidate_id, x.strength) for x in found.collect()} == {(i, 100 + i, 3) for i in range(20)}
    healed = C.healed_slugs(companies, spark.createDataFrame([(1, 1)], "dedup_key int, company_id int"))
    for df in (found, *healed):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_units_meet_by_six_letters(spark):
    """Units that share all strings of three letters with many texts, but none of six, meet none of them."""
    strings = lambda t: spark.range(1).select(C._grams(F.lit(t), 6).alias("g")).first()[0]
    assert strings("abcdefgh") == ["abcdef", "bcdefg", "cdefgh"] and strings("abcde") == []
    units = spark.createDataFrame([("abcdef",), ("abc",), ("ab",), ("abcd",)], "unit string")
    wholes = spark.createDataFrame([("xabcdefy",), ("abcxbcdxcdexdef",), ("ab",), ("zabcdz",), ("q",)], "whole string")
    want = [("ab", "ab"), ("abc", "abcxbcdxcdexdef"), ("abc", "xabcdefy"), ("abc", "zabcdz"), ("abcd", "xabcdefy"), ("abcd", "zabcdz"), ("abcdef", "xabcdefy")]
    assert rows(C._held(units, wholes), "unit", "whole") == want


def test_recommended_per_site_where_one_passes_all(spark, tmp_path):
    """Customers whose sums let every model pass every site, against the SQL."""
    import duckdb

    from hirelake.plans import catalog

    spark.createDataFrame([(k + 20 * i,) for k in range(20) for i in range(8)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")  # sums: 8 k + 560
    got = catalog.QUERIES["q_recommended"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = duck.sql(f"SELECT site, model, mode FROM ({catalog.ORACLE_SQL['q_recommended']})").fetchall()
    assert len(want) == 4 and rows(got, "site", "model", "mode") == sorted(want)


def test_links_in_mail_are_looked_through_once(spark):
    """The lines before a link stand once in the plan, not again in the filter on what they gave."""
    found = mailbox.linked_postings(spark.createDataFrame([("Data Engineer\nhttps://jobs.lever.co/a/1\nAcme",)], "body string"))
    assert rows(found, "title", "company") == [("Data Engineer", "Acme")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
