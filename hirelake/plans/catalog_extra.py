"""Further queries: the intake contract, exclusions, alarms, snapshots, per-company reports, places, evaluation of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hirelake.functions import content, locations, places as P, urls
from hirelake.operators import contract as C, evals as E, health as H, lifecycle as L, metrics as M
from hirelake.plans import views as V
from hirelake.plans.views import Registry
from hirelake.sources import boards

R = Registry()
_AGE = "(epoch_us({a}) - epoch_us({b})) / 86400000000.0"


def _contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = V.jobs(spark, sf_dir)
    return jobs.select(
        "dedup_key", (F.col("salary") - 20000).alias("salary_min"), F.col("salary").alias("salary_max"), F.col("first_seen").alias("posted_date"),
        F.when(F.col("dedup_key") % 3 != 0, "exact").alias("precision"), V.mapped((F.col("dedup_key") % 4).cast("string"), {"0": "USD", "1": "EUR", "2": "XXX"}).alias("currency"),
    )


@R.add("""
WITH a AS (SELECT max(first_seen) - INTERVAL 30 DAY AS t FROM v_jobs),
c AS (SELECT dedup_key, salary - 20000 AS lo, salary AS hi, first_seen AS posted, CASE WHEN dedup_key % 3 <> 0 THEN 'exact' END AS prec, CASE dedup_key % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'XXX' END AS cur FROM v_jobs)
SELECT dedup_key, array_to_string(list_filter([CASE WHEN lo <= 0 THEN 'I-01' END, CASE WHEN lo > hi THEN 'I-02' END, CASE WHEN posted > t + INTERVAL 1 DAY THEN 'I-12' END,
  CASE WHEN (posted IS NULL) <> (prec IS NULL) THEN 'I-14' END, CASE WHEN cur NOT IN ('USD', 'EUR') THEN 'currency' END], lambda x: x IS NOT NULL), ',') AS codes FROM c, a
""")
def q_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = V.jobs(spark, sf_dir)
    as_of = V.newest(jobs, "first_seen") - F.expr("INTERVAL 30 DAYS")
    return C.violations(_contract_rows(spark, sf_dir), as_of).select("dedup_key", F.array_join("violations", ",").alias("codes"))


def q_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw postings: routed, and counted by stage. The rules need look-around, so there is no SQL."""
    raw = V.table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("body"), F.col("source").alias("company"))
    denied = spark.createDataFrame([("src3",), ("SRC7",)], "name string")
    return C.funnel(C.routed(raw, denied), "route")


R.queries["q_intake"] = q_intake


@R.add("""
SELECT dedup_key, CASE WHEN contains(lower(classification), 'low') THEN 'title' WHEN lower(company) IN ('customer#000000001', 'customer#000000007') OR company_id % 97 = 0 THEN 'company' WHEN salary < 0.85 * 100000 THEN 'salary' END AS reason
FROM v_jobs JOIN v_companies USING (company_id)
""")
def q_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.jobs(spark, sf_dir).join(V.companies(spark, sf_dir).select("company_id", "company"), "company_id")
    denied = F.lower("company").isin("customer#000000001", "customer#000000007") | (F.col("company_id") % 97 == 0)
    reason = F.when(F.contains(F.lower("classification"), F.lit("low")), "title").when(denied, "company").when(F.col("salary") < 0.85 * 100000, "salary")
    return rows.select("dedup_key", reason.alias("reason"))


@R.add("SELECT count(*) FILTER (classification <> 'reject' AND salary >= 85000) AS scorable, count(*) AS total FROM v_jobs")
def q_scorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jobs(spark, sf_dir).agg(F.count_if((F.col("classification") != "reject") & (F.col("salary") >= 85000)).alias("scorable"), F.count("*").alias("total"))


@R.add("""
SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'awaiting_jd' WHEN toxic IS NULL AND lang <> 'en' THEN 'awaiting_location' END AS reason
FROM documents LEFT JOIN labels USING (doc_id)
""")
def q_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(V.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    reason = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "awaiting_jd").when(F.col("toxic").isNull() & (F.col("lang") != "en"), "awaiting_location")
    return rows.select("doc_id", reason.alias("reason"))


@R.add("SELECT doc_id, CASE WHEN contains(lower(text), 'password') THEN 'password' WHEN contains(lower(text), 'license') THEN 'license' END AS note FROM documents")
def q_legitimacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return V.table(spark, sf_dir, "documents").select("doc_id", F.when(F.contains(low, F.lit("password")), "password").when(F.contains(low, F.lit("license")), "license").alias("note"))


# alarms

@R.add("""
WITH c AS (SELECT company_id, count(*) AS n FROM v_jobs WHERE classification IN ('apply', 'consider') GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS g FROM c),
h AS (SELECT any_value(total) AS total, (sum((n / total) * (n / total)) - 1.0 / any_value(g)) / (1 - 1.0 / any_value(g)) AS hhi FROM c, t)
SELECT 'concentration' AS signal, round(hhi, 6) AS value, 0.6::DOUBLE AS threshold, hhi > 0.6 AND total >= 25 AS fired FROM h
""")
def q_alarm_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = V.jobs(spark, sf_dir).where(F.col("classification").isin("apply", "consider"))
    return H.signal("concentration", M.concentration(jobs, "company_id"), F.max("hhi"), 0.6)


@R.add("""
WITH s AS (SELECT job_id, max(CASE to_status WHEN 'applied' THEN 1 WHEN 'offer' THEN 5 ELSE 0 END) AS stage FROM v_events GROUP BY 1),
p AS (SELECT classification IN ('apply', 'consider') AS surfaced, count(*) FILTER (stage >= 1) AS applied, count(*) FILTER (stage >= 2) AS converted FROM v_jobs LEFT JOIN s ON job_id = dedup_key GROUP BY 1)
SELECT surfaced, applied, converted, applied >= 10 AS enough, round(converted::DOUBLE / nullif(applied, 0), 6) AS rate FROM p
""")
def q_alarm_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled rates of both sides; a side under ten applications doesn't tell."""
    joined = V.jobs(spark, sf_dir).join(M.last_stage(V.stage_events(spark, sf_dir)), F.col("dedup_key") == F.col("job_id"), "left")
    pooled = joined.groupBy(F.col("classification").isin("apply", "consider").alias("surfaced")).agg(F.count_if(F.col("stage") >= 1).alias("applied"), F.count_if(F.col("stage") >= 2).alias("converted"))
    return pooled.select("surfaced", "applied", "converted", (F.col("applied") >= 10).alias("enough"), F.round(F.try_divide("converted", "applied"), 6).alias("rate"))


# snapshots and reports

@R.add("""
SELECT 'status' AS facet, coalesce(status, '(null)') AS label, count(*) AS n FROM v_jobs GROUP BY 2
UNION ALL SELECT 'classification', coalesce(classification, '(null)'), count(*) FROM v_jobs GROUP BY 2
""")
def q_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facets in one scan."""
    facets = F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(c, F.lit("(null)")).alias("label")) for c in ("status", "classification")])
    return V.jobs(spark, sf_dir).select(F.explode(facets).alias("x")).groupBy("x.facet", "x.label").agg(F.count("*").alias("n"))


@R.add("SELECT platform, nation_id % 5 AS zone, count(*) AS n, count(DISTINCT company_id) AS companies FROM v_companies WHERE lower(platform) LIKE '%i%' GROUP BY 1, 2")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.companies(spark, sf_dir).where(F.lower("platform").contains("i"))
    return rows.groupBy("platform", (F.col("nation_id") % 5).alias("zone")).agg(F.count("*").alias("n"), F.count_distinct("company_id").alias("companies"))


@R.add("WITH d AS (SELECT max(ts)::DATE AS d FROM v_ledger) SELECT provider, count(*) AS calls, count(*) < 100 AS may_call FROM v_ledger, d WHERE ts::DATE = d GROUP BY provider")
def q_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = V.ledger(spark, sf_dir)
    today = ledger.where(F.to_date("ts") == F.to_date(V.newest(ledger, "ts")))
    return today.groupBy("provider").agg(F.count("*").alias("calls"), (F.count("*") < 100).alias("may_call"))


@R.add("SELECT ts::DATE AS day, count(*) FILTER (event_type = 'purchase') AS sent, count(*) FILTER (event_type = 'purchase') < 5 AS may_send FROM events GROUP BY 1")
def q_submit_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = F.count_if(F.col("event_type") == "purchase")
    return V.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(sent.alias("sent"), (sent < 5).alias("may_send"))


@R.add("SELECT coalesce(CASE WHEN o_totalprice > 300000 THEN 'agentic' WHEN o_totalprice > 100000 THEN 'serp' END, 'pending') AS tier, count(*) AS n FROM orders GROUP BY 1")
def q_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("o_totalprice") > 300000, "agentic").when(F.col("o_totalprice") > 100000, "serp")
    return V.table(spark, sf_dir, "orders").groupBy(F.coalesce(tier, F.lit("pending")).alias("tier")).agg(F.count("*").alias("n"))


@R.add("SELECT company_id, dedup_key, salary FROM v_jobs QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY salary DESC, dedup_key) <= 5")
def q_top_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.newest_per_group(V.jobs(spark, sf_dir).select("company_id", "dedup_key", "salary"), ["company_id"], [F.desc("salary"), F.col("dedup_key")], 5).drop("rn")


@R.add("SELECT dedup_key, classification FROM v_jobs ORDER BY CASE classification WHEN 'apply' THEN 0 WHEN 'consider' THEN 1 WHEN 'skip' THEN 2 WHEN 'reject' THEN 3 ELSE 4 END, dedup_key LIMIT 200")
def q_class_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators import board as B

    return B.board(V.jobs(spark, sf_dir), B.Filters(show_hidden=True), sort_by="classification", descending=False, limit=200).select("dedup_key", "classification")


@R.add("SELECT p_brand, p_partkey FROM part ORDER BY p_size, p_retailprice DESC, p_brand, p_partkey LIMIT 30")
def q_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").orderBy("p_size", F.desc("p_retailprice"), "p_brand", "p_partkey").limit(30).select("p_brand", "p_partkey")


@R.add("SELECT dedup_key, coalesce(closed, first_seen) AS recent FROM v_jobs LEFT JOIN (SELECT l_orderkey AS dedup_key, max(l_shipdate) AS closed FROM lineitem GROUP BY 1) USING (dedup_key)")
def q_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("dedup_key")).agg(F.max("l_shipdate").alias("closed"))
    return V.jobs(spark, sf_dir).join(closed, "dedup_key", "left").select("dedup_key", F.coalesce("closed", "first_seen").alias("recent"))


@R.add("SELECT job_id, event_id, ts, to_status FROM v_events")
def q_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of every job; a reader of one job filters by job_id."""
    return V.stage_events(spark, sf_dir).select("job_id", "event_id", "ts", "to_status")


@R.add("""
WITH u AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, url FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url) AS rn FROM u)
SELECT host, count(*) AS n, string_agg(url, ' ' ORDER BY url) AS urls FROM r WHERE rn <= 3 GROUP BY host
""")
def q_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.functions.urls import host

    own = V.table(spark, sf_dir, "pages").select(host(F.col("url")).alias("host"), "url").distinct()
    top = L.newest_per_group(own, ["host"], [F.col("url")], 3)
    return top.groupBy("host").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("url")), " ").alias("urls"))


@R.add("""
WITH n AS (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2)
SELECT p_brand, p_name, CASE WHEN n = 1 THEN 'strict' ELSE 'loose' END AS confidence, first AS posting FROM n
""")
def q_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting that is alone under its exact title is certain; else the first one, loosely."""
    found = V.table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("posting"))
    return found.select("p_brand", "p_name", F.when(F.col("n") == 1, "strict").otherwise("loose").alias("confidence"), "posting")


@R.add("SELECT user_id, max(ts) AS beat, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 3600000000.0 <= 24 AS fresh FROM events GROUP BY 1")
def q_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.max("ts").alias("beat"), (V.days_between(V.newest(events, "ts"), F.max("ts")) <= 1).alias("fresh"))


# places

@R.add("""
WITH x AS (SELECT s_suppkey, n_name || ' | ' || r_name || '; Remote; ' || lower(n_name) || ' | N/A' AS raw FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, n_name || ',' || r_name || ',Remote' AS places FROM (SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
""")
def q_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    rows = V.table(spark, sf_dir, "supplier").join(nation, "s_nationkey").join(V.table(spark, sf_dir, "region"), "r_regionkey")
    raw = F.concat("n_name", F.lit(" | "), "r_name", F.lit("; Remote; "), F.lower("n_name"), F.lit(" | N/A"))
    return rows.select("s_suppkey", F.array_join(P.places(raw), ",").alias("places"))


@R.add(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\b(remote|work from home|wfh|telecommute)\b') THEN 'REMOTE' WHEN regexp_matches(text, '(?i)\bhybrid\b') THEN 'HYBRID'
  WHEN regexp_matches(text, '(?i)\b(on-?site|in[- ]office)\b') THEN 'ONSITE' ELSE 'UNSPECIFIED' END AS workplace FROM documents
""")
def q_workplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", P.workplace(F.col("text")).alias("workplace"))


@R.add("""
WITH a AS (SELECT max(ts) AS t FROM events), d AS (SELECT event_id, t::DATE - ts::DATE AS days FROM events, a)
SELECT event_id, CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN days || 'd ago' WHEN days < 30 THEN days // 7 || 'w ago' ELSE days // 30 || 'mo ago' END AS label FROM d
""")
def q_relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    return events.select("event_id", P.relative_label(F.col("ts"), V.newest(events, "ts")).alias("label"))


# evaluation of runs

@R.add("""
WITH r AS (SELECT dedup_key, s0 AS gold, unnest([s1, s2, s3]) AS run FROM v_axes), m AS (SELECT dedup_key, any_value(gold) AS gold, round_even(avg(run), 0) AS mean FROM r GROUP BY 1)
SELECT count(*) AS n, round(avg(abs(mean - gold)), 6) AS mae, round(avg(mean - gold), 6) AS bias FROM m
""")
def q_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = V.axes(spark, sf_dir).select("dedup_key", "s0", F.explode(F.array("s1", "s2", "s3")).alias("run"))
    means = E.per_job(axes, "dedup_key", "run").join(V.axes(spark, sf_dir).select("dedup_key", "s0"), "dedup_key")
    return E.errors(means, "s0", "mean")


@R.add("""
SELECT dedup_key, CASE WHEN contains(lower(classification), 'low') AND s0 >= 4 THEN 'title_fit' WHEN (contains(lower(classification), 'reject') OR contains(lower(classification), 'low')) AND s1 >= 4 THEN 'location_fit' END AS axis FROM v_axes
""")
def q_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = E.coherence(F.col("classification"), {"title_fit": F.col("s0"), "location_fit": F.col("s1")}, {"title_fit": ("low",), "location_fit": ("reject", "low")})
    return V.axes(spark, sf_dir).select("dedup_key", axis.alias("axis"))


def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.axes(spark, sf_dir).select("dedup_key", "classification", (F.col("s1") - F.col("s0")).cast("double").alias("delta"))
    return E.bootstrap_mean(rows, "dedup_key", "delta", "classification", resamples=100)


R.queries["q_bootstrap"] = q_bootstrap


@R.add("SELECT provider, n, retries, CASE WHEN n < 20 THEN 'SUPPRESSED' WHEN retries::DOUBLE / n > 0.2 THEN 'WARN' ELSE 'PASS' END AS gate FROM (SELECT purpose AS provider, count(*) AS n, count(*) FILTER (line > 4) AS retries FROM v_ledger GROUP BY 1)")
def q_retry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = V.ledger(spark, sf_dir).groupBy(F.col("purpose").alias("provider")).agg(F.count("*").alias("n"), F.count_if(F.col("line") > 4).alias("retries"))
    return sums.withColumn("gate", E.retry_gate(F.col("retries"), F.col("n")))


@R.add("""
WITH w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS word FROM benchmark),
n AS (SELECT item_id, count(*) AS words FROM w GROUP BY 1),
k AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS word FROM documents)
SELECT doc_id, item_id, count(*) AS shared, round(count(*)::DOUBLE / any_value(words), 6) AS coverage FROM k JOIN w USING (word) JOIN n USING (item_id) GROUP BY doc_id, item_id
""")
def q_keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda t: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]{3,}"), F.lit(0)))).alias("word")
    items, docs = V.table(spark, sf_dir, "benchmark").select("item_id", words("text")), V.table(spark, sf_dir, "documents").select("doc_id", words("text"))
    return E.keyword_coverage(docs, items, "doc_id", "item_id", "word")





@R.add("""
SELECT s_suppkey, CASE WHEN code IS NOT NULL THEN 'City' || s_suppkey END AS city, code AS country_code, CASE WHEN s_suppkey % 5 = 2 THEN 'TX' END AS region_code,
  CASE s_suppkey % 3 WHEN 0 THEN 'REMOTE' WHEN 1 THEN 'HYBRID' ELSE 'UNSPECIFIED' END AS workplace_type, code IS NULL AS unresolved
FROM (SELECT s_suppkey, (['DE', 'GB', 'US', NULL, 'JP'])[s_suppkey % 5 + 1] AS code FROM supplier)
""")
def q_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = F.element_at(F.array(*map(F.lit, ("Germany", "UK", "TX", "Atlantis", "japan"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    tail = F.when(F.col("s_suppkey") % 3 == 0, " / Remote").when(F.col("s_suppkey") % 3 == 1, " (Hybrid)").otherwise("")
    text = F.concat(F.lit("City"), F.col("s_suppkey").cast("string"), F.lit(", "), land, tail)
    rows = V.table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(locations.parsed(text)).alias("x"))
    return rows.select("s_suppkey", "x.city", "x.country_code", "x.region_code", "x.workplace_type", "x.unresolved")


@R.add("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'recruitee' END AS platform, CASE WHEN p_partkey % 3 < 2 THEN 'c' || p_size END AS slug, CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR END AS posting_id FROM part
""")
def q_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug, ident = F.concat(F.lit("c"), F.col("p_size").cast("string")), F.col("p_partkey").cast("string")
    url = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://boards.greenhouse.io/"), slug, F.lit("/jobs/"), ident))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("https://"), slug, F.lit(".recruitee.com/o/"), ident)).otherwise(F.concat(F.lit("https://example.com/jobs/"), ident))
    )
    rows = V.table(spark, sf_dir, "part").select("p_partkey", url.alias("url")).withColumn("b", urls.board(F.col("url")))
    return rows.select("p_partkey", "b.platform", "b.slug", urls.posting_id(F.col("url"), F.col("b.platform")).alias("posting_id"))


@R.add("""
SELECT p_partkey, length(trim(left(p_name, p_partkey % 6))) BETWEEN 3 AND 200 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS valid FROM part
""")
def q_valid_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.left("p_name", (F.col("p_partkey") % 6).cast("int"))
    company, url = F.when(F.col("p_partkey") % 7 != 0, "c"), F.when(F.col("p_partkey") % 11 != 0, "u").otherwise(" ")
    return V.table(spark, sf_dir, "part").select("p_partkey", content.is_valid_posting(title, company, url).alias("valid"))


@R.add("""
SELECT p_partkey, p_name AS title, 'https://jobs.example.com/' || p_partkey AS url, 'City' || p_size || ', ' || p_brand AS location, p_partkey::VARCHAR AS source_id,
  TIMESTAMP '2026-01-01' + p_size * INTERVAL 1 DAY AS posted, 'exact' AS posted_precision, CASE WHEN p_size % 2 = 0 THEN 'annual' END AS period, CASE WHEN p_size % 2 = 0 THEN p_size * 1000.0 END AS pay_low
FROM part
""")
def q_board_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pay = F.when(F.col("p_size") % 2 == 0, F.array(F.struct((F.col("p_size") * 100_000).alias("min_cents"), (F.col("p_size") * 200_000).alias("max_cents"), F.lit("Annual pay").alias("title"))))
    payload = F.to_json(
        F.struct(
            F.col("p_name").alias("title"), F.concat(F.lit("https://jobs.example.com/"), "p_partkey").alias("absolute_url"), F.struct(F.concat(F.lit("City"), "p_size", F.lit(", "), "p_brand").alias("name")).alias("location"),
            F.col("p_partkey").alias("id"), F.date_format(F.timestamp_add("day", F.col("p_size").cast("int"), F.lit("2026-01-01").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_published"), pay.alias("pay_input_ranges"),
        )
    )
    rows = boards.records(V.table(spark, sf_dir, "part").select("p_partkey", payload.alias("payload")), "greenhouse")
    return rows.select("p_partkey", "title", "url", "location", "source_id", F.to_timestamp_ntz(F.date_format("posted", "yyyy-MM-dd HH:mm:ss")).alias("posted"), "posted_precision", "period", "pay_low")
