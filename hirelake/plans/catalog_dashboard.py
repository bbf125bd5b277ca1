"""Queries over postings, events, companies and costs: dashboard figures, joins, orders, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hirelake.operators import board as B, metrics as M
from hirelake.plans import views as V
from hirelake.plans.views import AXES, Registry

R = Registry()
_AGE = "(epoch_us({a}) - epoch_us({b})) / 86400000000.0"
_HIDDEN = "('archived', 'withdrawn', 'dismissed', 'rejected')"
_STAGE = "CASE to_status WHEN 'applied' THEN 1 WHEN 'phone_screen' THEN 2 WHEN 'technical' THEN 3 WHEN 'onsite' THEN 4 WHEN 'offer' THEN 5 WHEN 'accepted' THEN 6 ELSE 0 END"


@R.add(f"""
WITH stage AS (SELECT job_id, max({_STAGE}) AS stage FROM v_events GROUP BY job_id),
bands(classification) AS (VALUES ('apply'), ('consider'), ('skip'), ('reject'), ('low_signal')),
c AS (SELECT classification, count(*) AS scored, count(*) FILTER (stage >= 1) AS applied, count(*) FILTER (stage >= 2) AS converted
      FROM v_jobs LEFT JOIN stage ON dedup_key = job_id GROUP BY classification)
SELECT classification, coalesce(scored, 0)::BIGINT AS scored, coalesce(applied, 0)::BIGINT AS applied, coalesce(converted, 0)::BIGINT AS converted,
       round(applied::DOUBLE / nullif(scored, 0), 6) AS application_rate, round(converted::DOUBLE / nullif(applied, 0), 6) AS callback_rate
FROM bands LEFT JOIN c USING (classification)
""")
def q_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([(c,) for c in ("apply", "consider", "skip", "reject", "low_signal")], "classification string")
    return M.conversion(V.jobs(spark, sf_dir), V.stage_events(spark, sf_dir), bands)


@R.add(f"""
WITH a AS (SELECT max(o_orderdate) AS t FROM orders)
SELECT count(*) AS total, count(*) FILTER (first_seen::DATE = t::DATE) AS new_today, count(*) FILTER (status = 'reviewing') AS reviewing,
       count(*) FILTER (status NOT IN {_HIDDEN}) AS open_jobs, count(*) FILTER ({_AGE.format(a="t", b="first_seen")} > 30) AS old_jobs
FROM v_jobs, a
""")
def q_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = V.jobs(spark, sf_dir)
    return M.stat_cards(jobs, V.newest(jobs, "first_seen"))


@R.add("SELECT status, count(*) AS n FROM v_jobs GROUP BY status")
def q_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.status_rollup(V.jobs(spark, sf_dir))


_CONCENTRATION = """
WITH c AS (SELECT {key} AS k, count(*) AS n FROM {rows} GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS groups FROM c),
s AS (SELECT groups, sum((n / total) * (n / total)) AS squares, -sum((n / total) * log2(n / total)) AS bits FROM c, t GROUP BY groups)
SELECT groups, round(CASE WHEN groups = 1 THEN 1.0 ELSE (squares - 1.0 / groups) / (1 - 1.0 / groups) END, 6) AS hhi,
       round(CASE WHEN groups > 1 THEN bits END, 6) AS entropy, round(CASE WHEN groups > 1 THEN bits / log2(groups) END, 6) AS evenness
FROM s
"""


@R.add(_CONCENTRATION.format(key="company_id", rows="(SELECT * FROM v_jobs WHERE classification IN ('apply', 'consider')) j"))
def q_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.concentration(V.jobs(spark, sf_dir).where(F.col("classification").isin("apply", "consider")), "company_id")


@R.add(_CONCENTRATION.format(key="coalesce(platform, '_unknown')", rows="v_jobs LEFT JOIN v_companies USING (company_id)"))
def q_concentration_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = V.jobs(spark, sf_dir).join(V.companies(spark, sf_dir), "company_id", "left")
    return M.concentration(joined.select(F.coalesce("platform", F.lit("_unknown")).alias("platform")), "platform")


@R.add(f"""
WITH p AS (SELECT o_orderdate AS posted, l_shipdate AS seen FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d AS (SELECT CASE WHEN seen <> posted AND {_AGE.format(a="seen", b="posted")} BETWEEN 0 AND 30 THEN {_AGE.format(a="seen", b="posted")} END AS d FROM p)
SELECT count(d) AS sample_n, quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.95) AS p95, quantile_disc(d, 0.99) AS p99,
       round(count(d) * 100.0 / count(*), 1)::DOUBLE AS coverage FROM d
""")
def q_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return M.latency(lines.join(orders, "l_orderkey"), "o_orderdate", "l_shipdate").withColumn("coverage", F.col("coverage").cast("double"))


@R.add(f"""
WITH a AS (SELECT max(ts) AS t FROM events), e AS (SELECT job_id, to_status, max(ts) AS entered FROM v_events GROUP BY job_id, to_status)
SELECT dedup_key, status, greatest(0, floor({_AGE.format(a="t", b="coalesce(entered, first_seen)")}))::BIGINT AS days_in_stage
FROM v_jobs LEFT JOIN e ON dedup_key = job_id AND status = to_status, a
""")
def q_stage_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.stage_events(spark, sf_dir)
    return M.stage_age(V.jobs(spark, sf_dir), events, V.newest(events, "ts"))


@R.add(f"""
WITH a AS (SELECT max(o_orderdate) AS t FROM orders)
SELECT dedup_key, company_id, status FROM v_jobs, a WHERE status NOT IN ('archived', 'rejected', 'withdrawn', 'dismissed')
  AND {_AGE.format(a="t", b="first_seen")} > 30
  AND NOT EXISTS (SELECT 1 FROM v_events WHERE job_id = dedup_key AND to_status IN ('applied', 'phone_screen', 'technical', 'onsite', 'offer', 'accepted'))
""")
def q_ghost(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = V.jobs(spark, sf_dir)
    return M.ghosts(jobs, V.stage_events(spark, sf_dir), V.newest(jobs, "first_seen")).select("dedup_key", "company_id", "status")


@R.add(f"""
WITH e AS (SELECT l_orderkey AS dedup_key, max(l_shipdate) AS ended FROM lineitem GROUP BY 1),
j AS (SELECT j.*, ended, status = 'applied' AS dead, {_AGE.format(a="ended", b="first_seen")} AS age FROM v_jobs j LEFT JOIN e USING (dedup_key))
SELECT round(count(*) FILTER (NOT dead)::DOUBLE / count(*), 6) AS live_share, round(avg(age) FILTER (dead), 6) AS mean_dead_age, round(median(age) FILTER (dead), 6) AS median_dead_age FROM j
""")
def q_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("dedup_key")).agg(F.max("l_shipdate").alias("ended"))
    return M.liveness(V.jobs(spark, sf_dir).join(ended, "dedup_key", "left"), F.col("status") == "applied", F.col("ended"))


@R.add("""
SELECT CASE WHEN platform IS NULL THEN 'untracked' WHEN platform NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'unsupported'
            WHEN balance < 0 THEN 'scan_disabled' ELSE 'reachable' END AS bucket, count(*) AS n
FROM v_jobs LEFT JOIN v_companies USING (company_id) GROUP BY 1
""")
def q_miss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.miss_log(V.jobs(spark, sf_dir), V.companies(spark, sf_dir), ("BUILDING", "MACHINERY", "AUTOMOBILE"), F.col("balance") < 0)


@R.add("""
SELECT count(*) FILTER (status = 'discovered') AS discovered, count(*) FILTER (status = 'applied') AS applied,
       count(DISTINCT company_id) AS companies, count(*) FILTER (salary > 200000) AS high_paid, max(first_seen) AS newest FROM v_jobs
""")
def q_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jobs(spark, sf_dir).agg(
        F.count_if(F.col("status") == "discovered").alias("discovered"), F.count_if(F.col("status") == "applied").alias("applied"),
        F.count_distinct("company_id").alias("companies"), F.count_if(F.col("salary") > 200000).alias("high_paid"), F.max("first_seen").alias("newest"),
    )


# costs

_MONTH = "date_trunc('month', (SELECT max(ts) FROM v_ledger))"


def _month(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("ts") >= F.date_trunc("month", V.newest(ledger, "ts")).cast("timestamp_ntz"))


@R.add(f"""
WITH a AS (SELECT max(ts) AS t, {_MONTH} AS m FROM v_ledger)
SELECT sum(CASE WHEN ts::DATE = t::DATE THEN cost ELSE 0 END)::DECIMAL(28,4) AS today,
       sum(CASE WHEN ts >= date_trunc('week', t) THEN cost ELSE 0 END)::DECIMAL(28,4) AS week,
       sum(cost)::DECIMAL(28,4) AS month
FROM v_ledger, a WHERE ts >= m AND provider <> 'F'
""")
def q_cost_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid spend of the day, week and month of the newest entry; the week is clipped at the month's start."""
    ledger = V.ledger(spark, sf_dir)
    t = V.newest(ledger, "ts")
    part = lambda test: F.sum(F.when(test, F.col("cost")).otherwise(0)).cast("decimal(28,4)")
    week = F.date_trunc("week", t).cast("timestamp_ntz")
    return _month(ledger).where(F.col("provider") != "F").agg(
        part(F.to_date("ts") == F.to_date(t)).alias("today"), part(F.col("ts") >= week).alias("week"), F.sum("cost").cast("decimal(28,4)").alias("month")
    )


def _monthly(key: str, paid: bool) -> str:
    return f"SELECT {key}, sum(cost)::DECIMAL(28,4) AS spend, count(*) AS calls, sum(tokens) AS tokens FROM v_ledger WHERE ts >= {_MONTH} {'AND provider <> chr(70)' * paid} GROUP BY {key}"


def _month_by(spark: SparkSession, sf_dir: str, key: str, paid: bool = False) -> DataFrame:
    rows = _month(V.ledger(spark, sf_dir))
    rows = rows.where(F.col("provider") != "F") if paid else rows
    return rows.groupBy(key).agg(F.sum("cost").cast("decimal(28,4)").alias("spend"), F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


@R.add(_monthly("provider", True))
def q_cost_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _month_by(spark, sf_dir, "provider", paid=True)


@R.add(_monthly("purpose", False))
def q_cost_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _month_by(spark, sf_dir, "purpose")


@R.add("SELECT ts::DATE AS day, purpose, sum(cost)::DECIMAL(28,4) AS spend, sum(tokens) AS tokens FROM v_ledger WHERE ts > (SELECT max(ts) FROM v_ledger) - INTERVAL 30 DAY GROUP BY 1, 2")
def q_cost_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = V.ledger(spark, sf_dir)
    recent = ledger.where(F.col("ts") > V.newest(ledger, "ts") - F.expr("INTERVAL 30 DAYS"))
    return recent.groupBy(F.to_date("ts").alias("day"), "purpose").agg(F.sum("cost").cast("decimal(28,4)").alias("spend"), F.sum("tokens").alias("tokens"))


@R.add("""
WITH a AS (SELECT max(ts) AS t FROM v_ledger)
SELECT count(*) FILTER (ts > t - INTERVAL 1 DAY) AS calls_1, count(*) FILTER (ts > t - INTERVAL 7 DAY) AS calls_7, count(*) AS calls_30,
       coalesce(sum(tokens) FILTER (ts > t - INTERVAL 1 DAY), 0) AS tokens_1, coalesce(sum(tokens) FILTER (ts > t - INTERVAL 7 DAY), 0) AS tokens_7, sum(tokens) AS tokens_30
FROM v_ledger, a WHERE ts > t - INTERVAL 30 DAY
""")
def q_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windows in one scan."""
    ledger = V.ledger(spark, sf_dir)
    t = V.newest(ledger, "ts")
    since = {n: F.col("ts") > t - F.expr(f"INTERVAL {n} DAYS") for n in (1, 7, 30)}
    aggs = [F.count_if(since[n]).alias(f"calls_{n}") for n in since] + [F.sum(F.when(since[n], F.col("tokens")).otherwise(0.0)).alias(f"tokens_{n}") for n in since]
    return ledger.where(since[30]).agg(*aggs)


@R.add("SELECT purpose, round(sum(tokens) / (SELECT sum(tokens) FROM v_ledger), 6) AS share FROM v_ledger GROUP BY purpose ORDER BY share DESC, purpose LIMIT 1")
def q_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = V.ledger(spark, sf_dir).groupBy("purpose").agg(F.sum("tokens").alias("n"))
    total = sums.agg(F.sum("n").alias("all"), F.max_by("purpose", F.struct("n", "purpose")).alias("purpose"), F.max("n").alias("n"))
    return total.select("purpose", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@R.add("SELECT ts::DATE AS day, provider, count(*) AS calls, sum(cost)::DECIMAL(28,4) < 1000000 AS allowed FROM v_ledger WHERE provider <> 'F' GROUP BY 1, 2")
def q_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = V.ledger(spark, sf_dir).where(F.col("provider") != "F")
    return paid.groupBy(F.to_date("ts").alias("day"), "provider").agg(F.count("*").alias("calls"), (F.sum("cost") < 1000000).alias("allowed"))


# joins

@R.add("SELECT event_id, ts, company FROM v_events LEFT JOIN v_companies ON user_id = company_id ORDER BY ts DESC, event_id LIMIT 50")
def q_recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the newest events are cut before they meet the companies."""
    top = V.stage_events(spark, sf_dir).orderBy(F.desc("ts"), "event_id").limit(50)
    named = V.companies(spark, sf_dir).select(F.col("company_id").alias("user_id"), "company")
    return top.join(named, "user_id", "left").select("event_id", "ts", "company")


@R.add("SELECT c.company_id, company, count(j.dedup_key) AS n_jobs FROM v_companies c LEFT JOIN v_jobs j USING (company_id) GROUP BY 1, 2")
def q_company_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = V.jobs(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("n"))
    return V.companies(spark, sf_dir).join(counts, "company_id", "left").select("company_id", "company", F.coalesce("n", F.lit(0)).cast("long").alias("n_jobs"))


@R.add("SELECT company_id, company FROM v_companies c WHERE NOT EXISTS (SELECT 1 FROM v_jobs j WHERE j.company_id = c.company_id) AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.company_id)")
def q_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"))
    return V.companies(spark, sf_dir).join(V.jobs(spark, sf_dir), "company_id", "left_anti").join(users, "company_id", "left_anti").select("company_id", "company")


@R.add("""
SELECT company_id FROM v_companies c WHERE EXISTS (SELECT 1 FROM v_jobs j WHERE j.company_id = c.company_id AND classification = 'apply')
  AND company_id NOT IN (SELECT company_id FROM v_jobs GROUP BY company_id HAVING count(*) >= 5 AND count(*) FILTER (salary > 400000) = 0)
""")
def q_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = V.jobs(spark, sf_dir)
    good = jobs.where(F.col("classification") == "apply").select("company_id")
    dull = jobs.groupBy("company_id").agg(F.count("*").alias("n"), F.count_if(F.col("salary") > 400000).alias("hits")).where("n >= 5 AND hits = 0")
    return V.companies(spark, sf_dir).select("company_id").join(good, "company_id", "left_semi").join(dull, "company_id", "left_anti")


@R.add("SELECT dedup_key, max(l_shipdate) AS closed FROM v_jobs JOIN lineitem ON l_orderkey = dedup_key WHERE status = 'applied' GROUP BY dedup_key")
def q_dead_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = V.jobs(spark, sf_dir).where(F.col("status") == "applied").select("dedup_key")
    closed = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("dedup_key")).agg(F.max("l_shipdate").alias("closed"))
    return applied.join(closed, "dedup_key")


@R.add("SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def q_last_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders")
    return orders.where(F.col("o_orderdate") == V.newest(orders, "o_orderdate")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@R.add("SELECT user_id, ts::DATE AS day, min(ts) AS first_ts FROM events GROUP BY 1, 2")
def q_min_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("first_ts"))


@R.add("SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def q_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = V.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().join(rich, "k", "left_semi")


@R.add("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def q_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = V.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).join(returned, "k", "left_anti")


@R.add("SELECT o_custkey AS k, min(src) AS src FROM (SELECT o_custkey, 1 AS src FROM orders UNION ALL SELECT c_custkey, 2 FROM customer) GROUP BY 1")
def q_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("src"))
    b = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(2).alias("src"))
    return a.unionByName(b).groupBy("k").agg(F.min("src").alias("src"))


# grouping

@R.add("SELECT p_name, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def q_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("brands")).where("brands > 1")


@R.add("SELECT p_brand, p_name, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def q_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.merge import direct_duplicates

    return direct_duplicates(V.table(spark, sf_dir, "part"), ["p_brand", "p_name"], "p_partkey").withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@R.add("SELECT count(*) AS groups, sum(n)::BIGINT AS members FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_name HAVING count(*) > 1)")
def q_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = V.table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.sum("n").alias("members"))


@R.add("SELECT company_id, string_agg(DISTINCT classification, ',' ORDER BY classification) AS classes, max(coalesce(salary, 0)) AS best FROM v_jobs GROUP BY 1")
def q_sources_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jobs(spark, sf_dir).groupBy("company_id").agg(
        F.array_join(F.array_sort(F.collect_set("classification")), ",").alias("classes"), F.max(F.coalesce("salary", F.lit(0.0))).alias("best")
    )


@R.add("SELECT platform, nation_id, count(*) AS n, count(*) FILTER (balance < 0) AS negative, round(100.0 * count(*) FILTER (balance < 0) / count(*), 1)::DOUBLE AS pct FROM v_companies GROUP BY 1, 2")
def q_backlog_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.companies(spark, sf_dir).groupBy("platform", "nation_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("balance") < 0).alias("negative"), F.round(100.0 * F.count_if(F.col("balance") < 0) / F.count("*"), 1).alias("pct")
    )


@R.add("SELECT count(*) AS total, count(*) FILTER (balance > 0) AS healthy, count(DISTINCT platform) AS platforms, count(DISTINCT nation_id) AS nations, round_even(100.0 * count(*) FILTER (balance > 0) / count(*), 0)::DOUBLE AS pct FROM v_companies")
def q_company_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.count_if(F.col("balance") > 0)
    return V.companies(spark, sf_dir).agg(
        F.count("*").alias("total"), good.alias("healthy"), F.count_distinct("platform").alias("platforms"), F.count_distinct("nation_id").alias("nations"),
        F.bround(100.0 * good / F.count("*"), 0).alias("pct"),
    )


@R.add("""
WITH w(days) AS (VALUES (7), (14), (30), (60)), a AS (SELECT max(first_seen) AS t FROM v_jobs)
SELECT days, count(DISTINCT company_id) AS companies, count(*) AS jobs FROM v_jobs, a, w WHERE first_seen > t - to_days(days) GROUP BY days
""")
def q_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several windows in one scan: each row goes to the windows it is in."""
    jobs = V.jobs(spark, sf_dir)
    age = V.days_between(V.newest(jobs, "first_seen"), F.col("first_seen"))
    windows = F.filter(F.array(*[F.lit(n) for n in (7, 14, 30, 60)]), lambda n: age < n)
    return jobs.select("company_id", F.explode(windows).alias("days")).groupBy("days").agg(F.count_distinct("company_id").alias("companies"), F.count("*").alias("jobs"))


@R.add("SELECT company_id, count(*) AS volume, count(*) FILTER (classification IN ('apply', 'consider')) AS good FROM v_jobs GROUP BY 1 ORDER BY good DESC, volume DESC, company_id LIMIT 20")
def q_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = V.jobs(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("volume"), F.count_if(F.col("classification").isin("apply", "consider")).alias("good"))
    return sums.orderBy(F.desc("good"), F.desc("volume"), "company_id").limit(20)


@R.add("SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def q_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@R.add("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND source <> ''")
def q_distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("source").where("source <> ''").distinct()


@R.add("SELECT lower(p_type) AS k, min_by(p_type, p_partkey) AS shown FROM part GROUP BY 1")
def q_distinct_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("k")).agg(F.min_by("p_type", "p_partkey").alias("shown"))


@R.add("SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 5 AND event_type = 'error'")
def q_failure_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = V.table(spark, sf_dir, "events").where("event_type = 'error'")
    return errors.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).where("n >= 5")


@R.add("""
WITH g AS (SELECT toxic, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM labels GROUP BY toxic)
SELECT toxic, n, k, round((k::DOUBLE / n + 1.96*1.96 / (2*n) - 1.96 * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + 1.96*1.96 / (4.0*n*n))) / (1 + 1.96*1.96 / n), 6) AS low,
       round((k::DOUBLE / n + 1.96*1.96 / (2*n) + 1.96 * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + 1.96*1.96 / (4.0*n*n))) / (1 + 1.96*1.96 / n), 6) AS high FROM g
""")
def q_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = V.table(spark, sf_dir, "labels").groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    w = M.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return sums.select("toxic", "n", "k", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


# board and orders

@R.add("SELECT dedup_key, company_id, first_seen, salary, status, classification FROM v_jobs WHERE status NOT IN ('archived', 'withdrawn', 'dismissed', 'rejected') AND classification IN ('apply', 'consider') AND salary >= 150000 ORDER BY salary DESC, dedup_key LIMIT 100")
def q_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.board(V.jobs(spark, sf_dir), B.Filters(classification=("apply", "consider"), salary_min=150000), sort_by="salary").select("dedup_key", "company_id", "first_seen", "salary", "status", "classification")


@R.add("SELECT dedup_key, status, first_seen, classification FROM v_jobs WHERE status IN ('applied', 'reviewing') AND first_seen >= '2000-01-01' AND first_seen < '2000-07-01'")
def q_board_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = B.Filters(status=("applied", "reviewing"), date_from="2000-01-01", date_to="2000-06-30")
    jobs = V.jobs(spark, sf_dir)
    for condition in B.conditions(filters, jobs.columns):
        jobs = jobs.where(condition)
    return jobs.select("dedup_key", "status", "first_seen", "classification")


@R.add("SELECT dedup_key, classification, s0 + s1 + s2 + s3 + s4 + s5 AS composite FROM v_axes ORDER BY composite DESC, dedup_key LIMIT 100")
def q_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.functions.fit import composite

    rows = V.axes(spark, sf_dir).withColumn("composite", composite([F.col(a) for a in AXES]))
    return B.board(rows, B.Filters(show_hidden=True)).select("dedup_key", "classification", "composite")


@R.add("SELECT dedup_key FROM v_axes WHERE (s0 + s1 + s2 + s3 + s4 + s5) / 6.0 >= 3.5 AND classification NOT IN ('reject', 'low_signal')")
def q_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.functions.fit import target_member

    return V.axes(spark, sf_dir).where(target_member([F.col(a) for a in AXES], F.col("classification"))).select("dedup_key")


@R.add("""
SELECT dedup_key, CASE WHEN s0 = 3 AND s1 = 3 AND s2 = 3 AND s3 = 3 AND s4 = 3 AND s5 = 3 THEN 'low_signal'
  WHEN least(s0, s1, s2, s3, s4, s5) = 1 THEN 'reject'
  WHEN least(s0, s1, s2, s3, s4, s5) >= 3 AND (s0 >= 4)::INT + (s1 >= 4)::INT + (s2 >= 4)::INT + (s3 >= 4)::INT + (s4 >= 4)::INT + (s5 >= 4)::INT >= 3 AND (s0 + s1 + s2 + s3 + s4 + s5) / 6.0 >= 3.5 THEN 'apply'
  ELSE 'consider' END AS derived FROM v_axes
""")
def q_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.functions.fit import classified

    none = F.lit(None).cast("string")
    return V.axes(spark, sf_dir).select("dedup_key", classified([F.col(a) for a in AXES], none, none, F.lit(None).cast("int"), F.lit(False)).alias("derived"))


@R.add("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20")
def q_top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), "event_id").limit(20)


@R.add("SELECT company_id, company FROM v_companies ORDER BY lower(company), company_id LIMIT 25 OFFSET 50")
def q_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.companies(spark, sf_dir).select("company_id", "company").orderBy(F.asc_nulls_last(F.lower("company")), "company_id").offset(50).limit(25)


@R.add("SELECT c.company_id, max(j.first_seen) AS checked FROM v_companies c LEFT JOIN v_jobs j USING (company_id) GROUP BY 1 ORDER BY checked ASC NULLS FIRST, c.company_id LIMIT 100")
def q_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = V.jobs(spark, sf_dir).groupBy("company_id").agg(F.max("first_seen").alias("checked"))
    return V.companies(spark, sf_dir).select("company_id").join(last, "company_id", "left").orderBy(F.asc_nulls_first("checked"), "company_id").limit(100)


@R.add("SELECT dedup_key, classification, salary FROM v_jobs WHERE dedup_key = 7")
def q_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jobs(spark, sf_dir).where("dedup_key = 7").select("dedup_key", "classification", "salary")
