"""Queries of backlogs and small records, of places, salaries and days, and of postings folded field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hirelake.functions import names as N, places as PL, salary as SA
from hirelake.operators import backlog as B, companies as C
from hirelake.plans import views as V
from hirelake.plans.views import Registry

R = Registry()

_SUM = " + ".join(V.AXES)


def _total() -> Column:
    return sum((F.col(a) for a in V.AXES), F.lit(0))


# backlogs and batches

@R.add(f"""
WITH s AS (SELECT dedup_key, CASE WHEN dedup_key % 7 <> 0 THEN {_SUM} END AS score FROM v_axes),
n AS (SELECT dedup_key, score, ntile(4) OVER (ORDER BY score NULLS FIRST, dedup_key) AS t FROM s)
SELECT dedup_key, CASE WHEN score IS NULL THEN 0 ELSE t END::INTEGER AS quartile FROM n
""")
def q_ntile_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.axes(spark, sf_dir).select("dedup_key", F.when(F.col("dedup_key") % 7 != 0, _total()).alias("score"))
    return B.quartiles(rows, "dedup_key", "score")


@R.add(f"""
WITH s AS (SELECT dedup_key, CASE WHEN dedup_key % 7 <> 0 THEN {_SUM} END AS score FROM v_axes),
n AS (SELECT dedup_key, CASE WHEN score IS NULL THEN 0 ELSE ntile(4) OVER (ORDER BY score NULLS FIRST, dedup_key) END::INTEGER AS quartile FROM s)
SELECT dedup_key, quartile FROM n QUALIFY row_number() OVER (PARTITION BY quartile ORDER BY md5(dedup_key || ':42'), dedup_key) <= 21
""")
def q_bucket_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bucket_batch(q_ntile_with_nulls(spark, sf_dir), "dedup_key", "quartile", 101)


@R.add("""
SELECT doc_id, CASE WHEN quality = 1 THEN 'apply' ELSE 'reject' END AS gold FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL
""")
def q_gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = V.table(spark, sf_dir, "labels").select("doc_id", V.mapped(F.col("quality").cast("string"), {"1": "apply", "0": "reject"}).alias("gold"))
    return B.gold_rows(V.table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left"), "doc_id", "gold")


_PROBE = "(['hit', 'miss', 'error', 'pending'])[company_id % 4 + 1]"


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("company_id")
    probe = F.element_at(F.array(*map(F.lit, ("hit", "miss", "error", "pending"))), (key % 4 + 1).cast("int"))
    return V.companies(spark, sf_dir).select(
        "company_id", F.col("company").alias("name"), F.concat(F.lit("raw "), key).alias("name_raw"), probe.alias("probe"), F.lower("platform").alias("platform"), (key % 5 != 0).alias("enabled"),
        F.when(key % 3 != 0, F.concat(F.lit("https://c"), key)).alias("homepage"), F.when(key % 8 == 2, F.date_add(F.lit("2024-01-01").cast("date"), (key % 100).cast("int"))).alias("retry_after"),
    )


@R.add(f"SELECT company_id, {_PROBE} AS probe FROM v_companies WHERE company_id % 4 <> 0 AND company_id % 5 <> 0 ORDER BY company_id LIMIT 40")
def q_promotion_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.promotion_batch(_probed(spark, sf_dir), "company_id", 40).select("company_id", "probe")


@R.add(f"""
WITH s AS (SELECT company_id, max({_SUM}) AS best FROM v_axes WHERE dedup_key % 3 = 1 GROUP BY 1),
c AS (SELECT company_id, {_PROBE} AS probe, lower(platform) AS platform, company_id % 3 <> 0 AS homepage, CASE WHEN company_id % 8 = 2 THEN DATE '2024-01-01' + (company_id % 100)::INTEGER END AS retry, best IS NULL OR best >= 22 AS may
  FROM v_companies LEFT JOIN s USING (company_id) WHERE company_id % 5 <> 0)
SELECT count(*) FILTER (may AND (probe = 'hit' OR (probe = 'error' AND (retry IS NULL OR retry < DATE '2024-02-15'))) AND platform NOT IN ('machinery')) AS a,
  count(*) FILTER (may AND homepage AND (probe IN ('miss', 'error') OR (probe = 'hit' AND platform = 'furniture'))) AS c FROM c
""")
def q_phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _probed(spark, sf_dir)
    jobs = V.axes(spark, sf_dir).join(named.select("company_id", "name"), "company_id").select(F.col("name").alias("company"), F.when(F.col("dedup_key") % 3 == 1, _total()).alias("s"))
    may = C.may_scan(named, jobs, F.col("s"), 22)
    return B.phase_counts(may, F.col("may_scan"), F.lit("2024-02-15").cast("date"), ("furniture",), ("machinery",))


@R.add("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND length(text) >= 200 AND doc_id % 4 <> 1")
def q_extraction_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    location = F.when(key % 3 == 0, F.lit("Rome")).when(key % 3 == 1, F.lit(""))
    reasons = F.when(key % 4 == 1, F.array(F.lit("other"), F.lit("location_missing"))).when(key % 4 == 2, F.array(F.lit("other")))
    jobs = V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), location.alias("location"), reasons.alias("reasons"))
    return B.extraction_backlog(jobs).select("doc_id")


@R.add(r"""
WITH f AS (SELECT *, p_partkey // 10 AS page, CASE WHEN p_partkey % 6 <> 0 THEN '/u' || p_size % 4 END AS url FROM part WHERE regexp_matches(p_name, '\b(?:widget|gear|steel)\b') AND NOT regexp_matches(p_name, '\bhot\b'))
SELECT p_partkey, page, url FROM f QUALIFY url IS NULL OR row_number() OVER (PARTITION BY page, url ORDER BY p_partkey) = 1
""")
def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part").withColumn("page", F.expr("p_partkey div 10")).withColumn("url", F.when(F.col("p_partkey") % 6 != 0, F.concat(F.lit("/u"), (F.col("p_size") % 4).cast("string"))))
    return B.candidates(part, "page", "p_partkey", "p_name", "url", ("widget", "gear", "steel"), ("hot",)).select("p_partkey", "page", "url")


# small records

@R.add("""
WITH j AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'loose' END AS c FROM orders),
l AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 5 <> 0 THEN 'u' || l_linenumber ELSE '' END AS url, CASE l_returnflag WHEN 'R' THEN 'strict' WHEN 'A' THEN 'loose' ELSE 'other' END AS c FROM lineitem),
b AS (SELECT k, min((c <> 'strict', url, c)) AS x FROM l WHERE url <> '' AND c <> 'other' GROUP BY k),
m AS (SELECT j.k, j.c, b.x[2] AS url, b.x[3] AS n, b.x IS NOT NULL AND (j.c IS NULL OR (b.x[3] = 'strict' AND j.c <> 'strict')) AS may FROM j LEFT JOIN b USING (k))
SELECT k AS job_id, CASE WHEN may THEN url WHEN c IS NOT NULL THEN 'old' END AS direct_url, CASE WHEN may THEN n ELSE c END AS direct_confidence FROM m
""")
def q_direct_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    has = F.when(key % 3 == 0, "strict").when(key % 3 == 1, "loose")
    jobs = V.table(spark, sf_dir, "orders").select(key.alias("job_id"), F.when(has.isNotNull(), F.lit("old")).alias("direct_url"), has.alias("direct_confidence"))
    url = F.when(F.col("l_linenumber") % 5 != 0, F.concat(F.lit("u"), F.col("l_linenumber").cast("string"))).otherwise("")
    links = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), url.alias("url"), V.mapped("l_returnflag", {"R": "strict", "A": "loose"}, "other").alias("confidence"))
    return B.with_direct_links(jobs, links, "job_id")


@R.add("""
WITH n AS (SELECT event_id // 2 AS k, max_by(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, (ts, event_type)) AS note, max_by({'n': CASE WHEN event_type = 'error' THEN NULL ELSE event_type END}, (ts, event_type)) AS x FROM events GROUP BY 1)
SELECT dedup_key, CASE WHEN n.k IS NULL THEN 'old' ELSE x.n END AS note FROM v_jobs LEFT JOIN n ON n.k = dedup_key
""")
def q_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = V.table(spark, sf_dir, "events").select(F.expr("event_id div 2").alias("dedup_key"), F.when(F.col("event_type") == "error", F.lit(" ")).otherwise(F.col("event_type")).alias("note"), "ts", "event_type")
    jobs = V.jobs(spark, sf_dir).select("dedup_key", F.lit("old").alias("note"))
    at = notes.withColumn("at", F.struct("ts", "event_type")).drop("ts", "event_type")
    return B.with_notes(jobs, at, "dedup_key", "at")


@R.add("""
WITH p AS (SELECT l_returnflag AS provider, l_linestatus AS model, CASE l_returnflag WHEN 'N' THEN 0.0 ELSE 2.5 END AS i, CASE l_returnflag WHEN 'N' THEN 0.0 ELSE 10.0 END AS o FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag <> 'A'))
SELECT l_orderkey AS job_id, l_linenumber AS line, round((l_quantity * 1000 * coalesce(i, 0) + l_quantity * 10 * coalesce(o, 0)) / 1000000, 6)::DOUBLE AS cost FROM lineitem LEFT JOIN p ON provider = l_returnflag AND model = l_linestatus
""")
def q_priced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = V.table(spark, sf_dir, "lineitem")
    calls = line.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("model"), (F.col("l_quantity") * 1000).alias("tokens_in"), (F.col("l_quantity") * 10).alias("tokens_out"))
    free = F.col("provider") == "N"
    prices = calls.where("provider <> 'A'").select("provider", "model", F.when(free, 0.0).otherwise(2.5).alias("price_in"), F.when(free, 0.0).otherwise(10.0).alias("price_out")).distinct()
    return B.priced(calls, prices).select("job_id", "line", "cost")


@R.add("""
SELECT user_id % 10 AS callsite, count(*) AS n, round(avg((event_type = 'view')::INTEGER), 6) AS share_a, round(avg((event_type = 'click')::INTEGER), 6) AS share_b, round(avg((event_type = 'signup')::INTEGER), 6) AS share_tie, round(avg(value), 6) AS confidence
FROM events WHERE event_type <> 'error' GROUP BY 1
""")
def q_verdict_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    judged = events.select((F.col("user_id") % 10).alias("callsite"), V.mapped("event_type", {"view": "A", "click": "B", "signup": "tie", "purchase": "unclear"}).alias("verdict"), F.col("value").alias("confidence"))
    return B.verdict_tallies(judged, ["callsite"])


@R.add("""
WITH r AS (SELECT user_id, max_by(CASE WHEN event_id % 9 = 0 THEN '"odd"' ELSE json_extract_string(props, '$.k') END, ts) AS n FROM events GROUP BY 1)
SELECT user_id, n::BIGINT AS unexplained FROM r WHERE n <> '"odd"' AND n::BIGINT > 40
""")
def q_funnel_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarm of each user's runs, all in one pass: the newest run's metadata by user."""
    events = V.table(spark, sf_dir, "events")
    n = F.when(F.col("event_id") % 9 == 0, F.lit('"odd"')).otherwise(F.get_json_object("props", "$.k"))
    runs = events.select("user_id", "ts", F.lit("ingestion").alias("source"), F.concat(F.lit('{"unexplained": '), n, F.lit("}")).alias("metadata"))
    return B.funnel_alarm(runs, 40, by=("user_id",))


@R.add("SELECT count(*) AS emails, coalesce(sum(value::BIGINT), 0)::BIGINT AS jobs FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 72 HOUR")
def q_inbox_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.table(spark, sf_dir, "events").select(F.col("ts").alias("processed_at"), F.bround("value").cast("long").alias("jobs_found"))
    return B.inbox_activity(log, V.newest(log, "processed_at"), 72)


# places, days and salaries

@R.add(r"""
SELECT s_suppkey, list_sort(list_distinct(list_filter(regexp_extract_all(lower(s_name || ' The Greater nation area, ' || s_nationkey || ' united'), '[a-z0-9]{3,}'), lambda x: x NOT IN ('united', 'states', 'usa', 'the', 'and', 'area', 'greater', 'metro')))) AS words FROM supplier
""")
def q_location_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("s_name", F.lit(" The Greater nation area, "), F.col("s_nationkey").cast("string"), F.lit(" united"))
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", F.array_sort(PL.location_tokens(text)).alias("words"))


@R.add("""
SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'City ' || s_nationkey WHEN 1 THEN 'Region' WHEN 2 THEN 'DE' WHEN 3 THEN 'Hall ' || s_nationkey WHEN 4 THEN 'Plain, Text' WHEN 5 THEN 'City ' || s_nationkey || ' | Other' ELSE '' END AS location FROM supplier
""")
def q_posted_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    city = F.concat(F.lit('{"@type": "Place", "address": {"addressLocality": "City '), F.col("s_nationkey").cast("string"), F.lit('", "addressRegion": "R", "addressCountry": "DE"}}'))
    shapes = [
        city, F.lit('{"address": {"addressLocality": " ", "addressRegion": "Region"}}'), F.lit('{"address": {"addressCountry": "DE"}}'), F.concat(F.lit('{"name": "Hall '), F.col("s_nationkey").cast("string"), F.lit('"}')),
        F.lit('" Plain, Text "'), F.concat(F.lit("["), city, F.lit(', "Other", {"address": {}}]')),
    ]
    where = F.lit("null")
    for i, shape in enumerate(shapes):
        where = F.when(F.col("s_suppkey") % 7 == i, shape).otherwise(where)
    posting = F.concat(F.lit('{"title": "t", "jobLocation": '), where, F.lit("}"))
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", PL.posted_location(posting).alias("location"))


@R.add("""
WITH t AS (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey * 977 % 86400) AS ts FROM orders), d AS (SELECT *, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS day FROM t)
SELECT o_orderkey, ((day::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS start_utc, (((day + 1)::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS end_utc,
  ((((day::VARCHAR || ' 23:59:59')::TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS last_second FROM d
""")
def q_local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = "America/New_York"
    ts = (F.col("o_orderdate").cast("timestamp") + F.make_interval(secs=(F.col("o_orderkey") * 977 % 86400).cast("decimal(18,6)"))).alias("ts")
    rows = V.table(spark, sf_dir, "orders").select("o_orderkey", ts)
    window = PL.local_day_window(F.col("ts"), zone)
    day = F.from_utc_timestamp("ts", zone).cast("date")
    return rows.select("o_orderkey", *(x.cast("timestamp_ntz").alias(n) for x, n in ((window["start"], "start_utc"), (window["end"], "end_utc"), (PL.local_date_time(day, zone, True), "last_second"))))


@R.add("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) + INTERVAL 4 HOUR WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS utc FROM events
""")
def q_naive_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    told = F.when(kind == 0, F.concat(text, F.lit("-04:00"))).when(kind == 1, F.concat(text, F.lit("Z"))).when(kind == 2, text).otherwise(F.lit("soon"))
    return V.table(spark, sf_dir, "events").select("event_id", PL.naive_utc(told).alias("utc"))


@R.add("""
WITH t AS (SELECT p_partkey AS k, p_size AS n FROM part),
v AS (SELECT k, n, CASE k % 6 WHEN 0 THEN n * 1000 + 30000 WHEN 1 THEN (n + 20) * 2080 WHEN 2 THEN n * 1000 WHEN 3 THEN NULL WHEN 4 THEN (n + 30) * 1000 WHEN 5 THEN 900000000 END AS low,
  CASE k % 6 WHEN 0 THEN n * 1000 + 60000 WHEN 1 THEN (n + 30) * 2080 WHEN 2 THEN n * 1000 + 5000 WHEN 4 THEN (n + 50) * 1000 WHEN 5 THEN 950000000 END AS high FROM t)
SELECT k AS p_partkey, CASE WHEN low BETWEEN 30000 AND 5000000 AND high BETWEEN 30000 AND 5000000 THEN low END::BIGINT AS salary_min, CASE WHEN low BETWEEN 30000 AND 5000000 AND high BETWEEN 30000 AND 5000000 THEN high END::BIGINT AS salary_max FROM v
""")
def q_salary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    texts = [
        F.concat(F.lit("pays $"), s(n * 1000 + 30_000), F.lit(" - $"), s(n * 1000 + 60_000), F.lit(" a year")), F.concat(F.lit("$"), s(n + 20), F.lit(" to $"), s(n + 30), F.lit(" per hour")),
        F.concat(F.lit("$"), s(n), F.lit("K - $"), s(n + 5), F.lit("K per year")), F.concat(F.lit("about $"), s(n), F.lit("K")), F.concat(F.lit("$"), s(n + 30), F.lit("-$"), s(n + 50)), F.lit("raised $900M - $950M"),
    ]
    text = F.element_at(F.array(*texts), (key % 6 + 1).cast("int"))
    return V.table(spark, sf_dir, "part").select("p_partkey", SA.from_text(text).alias("p")).select("p_partkey", "p.*")


# usage by day, purpose and provider

@R.add("SELECT date_trunc('day', ts)::DATE AS day, purpose, sum(tokens)::DOUBLE AS tokens, count(*) AS calls FROM v_ledger WHERE ts > (SELECT max(ts) FROM v_ledger) - INTERVAL 30 DAY GROUP BY ALL")
def q_usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.ledger(spark, sf_dir)
    newest = V.newest(rows, "ts")
    return rows.where(F.col("ts") > newest - F.expr("INTERVAL 30 DAY")).groupBy(F.to_date("ts").alias("day"), "purpose").agg(F.sum("tokens").cast("double").alias("tokens"), F.count("*").alias("calls"))


def _month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.ledger(spark, sf_dir)
    return rows.where(F.date_trunc("month", "ts") == F.date_trunc("month", V.newest(rows, "ts")))


_IN_MONTH = "date_trunc('month', ts) = date_trunc('month', (SELECT max(ts) FROM v_ledger))"


@R.add(f"SELECT purpose, sum(tokens)::DOUBLE AS tokens, count(*) AS calls FROM v_ledger WHERE {_IN_MONTH} GROUP BY 1")
def q_usage_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _month(spark, sf_dir).groupBy("purpose").agg(F.sum("tokens").cast("double").alias("tokens"), F.count("*").alias("calls")).orderBy(F.desc("tokens"), "purpose")


@R.add(f"SELECT provider, sum(tokens)::DOUBLE AS tokens, count(*) AS calls FROM v_ledger WHERE {_IN_MONTH} GROUP BY 1")
def q_usage_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _month(spark, sf_dir).groupBy("provider").agg(F.sum("tokens").cast("double").alias("tokens"), F.count("*").alias("calls")).orderBy(F.desc("tokens"), "provider")


@R.add("SELECT provider, count(*) AS calls FROM v_ledger WHERE date_trunc('day', ts) = date_trunc('day', (SELECT max(ts) FROM v_ledger)) GROUP BY 1")
def q_daily_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.ledger(spark, sf_dir)
    return rows.where(F.to_date("ts") == F.to_date(V.newest(rows, "ts"))).groupBy("provider").agg(F.count("*").alias("calls"))


# title gate, keys and words of the library's own lists

_TITLES = ("Senior ML Eng", "Staff Software Engineer II", "Sr. Product Mgr", "Intern, Data", "Machine Operator Learning", "VP of Machine Learning")


@R.add(f"""
SELECT p_partkey, p_partkey % 6 IN (0, 1, 5) AND p_name NOT LIKE 'hot %' AS passes FROM part
""")
def q_title_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted phrases whole or with up to two words between, unwanted ones whole."""
    title = F.concat("p_name", F.lit(" "), F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % 6 + 1).cast("int")))
    return V.table(spark, sf_dir, "part").select("p_partkey", N.title_passes(title, ("software engineer", "machine learning"), ("hot", "operator")).alias("passes"))
