"""Queries of plans that run in passes, of rules with versions, and of intervals by resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hirelake.functions.names import is_target_role
from hirelake.functions.urls import requisition_in
from hirelake.operators import evals as E, resweep as S, rounds as P
from hirelake.plans import views as V
from hirelake.plans.views import Registry
from hirelake.streaming.stateful import shared_folder

R = Registry()


# matching with consumption

@R.add("""
WITH RECURSIVE roles AS (SELECT o_custkey AS c, o_orderkey AS role, o_orderpriority AS p, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn FROM orders WHERE o_orderkey % 2 = 1),
free AS (SELECT o_custkey AS c, o_orderkey AS job, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0),
likes AS (SELECT c, role, turn, list({'rank': rank, 'job': job} ORDER BY rank, job) AS jobs FROM
  (SELECT r.c, r.role, r.turn, CASE WHEN r.p = f.p THEN 1 ELSE 2 END AS rank, f.job FROM roles r JOIN free f ON r.c = f.c AND (r.p = f.p OR r.s = f.s)) GROUP BY ALL),
every AS (SELECT r.c, r.role, r.turn, coalesce(jobs, []) AS jobs FROM roles r LEFT JOIN likes USING (c, role, turn)),
go AS (SELECT c, 0::BIGINT AS turn, []::BIGINT[] AS taken, NULL::BIGINT AS role, NULL::BIGINT AS job, NULL::INTEGER AS rank FROM (SELECT DISTINCT c FROM roles)
  UNION ALL SELECT c, turn, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got.job) END, role, got.job, got.rank FROM
    (SELECT go.c, e.turn, go.taken, e.role, list_filter(e.jobs, lambda j: NOT list_contains(go.taken, j.job))[1] AS got FROM go JOIN every e ON e.c = go.c AND e.turn = go.turn + 1))
SELECT role, job, rank FROM go WHERE job IS NOT NULL
""")
def q_matched_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    odd = F.col("o_orderkey") % 2 == 1
    roles = orders.where(odd).toDF("c", "role", "p", "s")
    jobs = orders.where(~odd).toDF("c", "job", "jp", "js")
    both = roles.join(jobs, "c").where((F.col("p") == F.col("jp")) | (F.col("s") == F.col("js")))
    rank = F.when(F.col("p") == F.col("jp"), 1).otherwise(2).alias("rank")
    return P.assigned(both.select("role", F.col("role").alias("turn"), "job", rank))


@R.add("""
SELECT p_partkey, regexp_matches(p_name, '(?i)\\b(?:gizmo|widget|steel|red)\\b') AS target,
  CASE p_partkey % 4 WHEN 0 THEN 'JR20' || (100000 + p_partkey) WHEN 1 THEN '1065363994072' || (100000 + p_partkey) WHEN 2 THEN 'ab-' || p_partkey END AS req FROM part
""")
def q_role_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("p_partkey"), F.col("p_partkey") % 4
    url = (
        F.when(kind == 0, F.concat(F.lit("https://x.wd1.example.com/job/City/Title_JR20"), key + 100_000))
        .when(kind == 1, F.concat(F.lit("https://careers.example.com/jobs/results/1065363994072"), key + 100_000, F.lit("-title")))
        .when(kind == 2, F.concat(F.lit("https://example.com/apply?src=a&jobId=ab-"), key)).otherwise(F.concat(F.lit("https://example.com/jobs/"), key))
    )
    return V.table(spark, sf_dir, "part").select("p_partkey", is_target_role(F.col("p_name"), ("gizmo", "widget", "steel", "red")).alias("target"), requisition_in(url).alias("req"))


# reverts

@R.add("""
WITH RECURSIVE e AS (SELECT user_id AS u, event_id, ts, event_type AS s, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'view') AS prior FROM events),
steps AS (SELECT u, list({'ts': ts, 's': s, 'prior': prior} ORDER BY ts DESC, prior DESC) AS l FROM e WHERE event_id % 3 <> 0 GROUP BY u),
found AS (SELECT u, list({'ts': ts, 'id': event_id, 'valid': event_id % 2 = 0} ORDER BY ts DESC, event_id DESC) AS l FROM e WHERE event_id % 5 <> 0 GROUP BY u),
jobs AS (SELECT u, max_by(s, (ts, event_id)) AS s FROM e GROUP BY u),
go AS (
  SELECT jobs.u, s, coalesce(steps.l, []) AS steps, coalesce(found.l, []) AS found, []::BIGINT[] AS gone, 'untouched' AS outcome, true AS moved FROM jobs LEFT JOIN steps USING (u) LEFT JOIN found USING (u)
  UNION ALL
  SELECT u, CASE WHEN bad THEN step.prior ELSE s END, steps, found, CASE WHEN bad THEN list_append(gone, d.id) ELSE gone END,
    CASE WHEN step IS NULL THEN outcome WHEN d IS NULL THEN 'no_detection' WHEN bad THEN 'reverted' ELSE 'kept' END, coalesce(bad, false)
  FROM (SELECT *, d IS NOT NULL AND NOT d.valid AS bad FROM (
    SELECT *, list_filter(found, lambda x: x.ts <= step.ts AND NOT list_contains(gone, x.id))[1] AS d FROM (SELECT *, list_filter(steps, lambda x: x.s = s)[1] AS step FROM go WHERE moved AND s <> 'view')))),
last AS (SELECT u, s, gone, outcome FROM go QUALIFY row_number() OVER (PARTITION BY u ORDER BY len(gone) DESC, (outcome = 'untouched' OR outcome = 'reverted')) = 1)
SELECT u AS job_id, s AS status, len(gone)::INTEGER AS n_reverted, outcome, array_to_string(gone, ',') AS dismissed FROM last
""")
def q_reverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = events.select(F.col("user_id").alias("job_id"), "ts", before.alias("from_status"), F.col("event_type").alias("to_status"), (F.col("event_id") % 3 != 0).alias("auto"))
    jobs = events.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    found = events.where("event_id % 5 <> 0").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("detection_id"), "ts", (F.col("event_id") % 2 == 0).alias("valid"))
    out = P.reverted(jobs, steps, found, first="view", movable=("click", "signup", "purchase", "error"))
    return out.select("job_id", "status", "n_reverted", "outcome", F.array_join("dismissed", ",").alias("dismissed"))


# rules with versions

_TAILS = ("", " Posted 3 days ago", " Apply now", " 2 weeks ago | Full time", "  ")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (key % len(_TAILS) + 1).cast("int"))
    return V.table(spark, sf_dir, "part").select(
        key.alias("job_id"), F.concat("p_name", tail).alias("title"), F.lit(None).cast("string").alias("raw_title"),
        F.when(key % 7 == 0, F.array(F.lit("title_invalid_shape"), F.lit("salary_inverted"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.when(key % 2 == 0, "apply").alias("classification"), (key % 4).cast("int").alias("v"),
    )


_SQL_TITLES = f"""t AS (SELECT p_partkey AS k, p_name, p_name || (['{"', '".join(_TAILS)}'])[p_partkey % {len(_TAILS)} + 1] AS title, p_partkey % 4 AS v, CASE WHEN p_partkey % 2 = 0 THEN 'apply' END AS c,
  CASE WHEN p_partkey % 7 = 0 THEN 'title_invalid_shape,salary_inverted' ELSE '' END AS reasons FROM part)"""


@R.add(f"""
WITH {_SQL_TITLES}
SELECT k AS job_id, greatest(v, 2)::INTEGER AS version, CASE WHEN v < 2 THEN p_name ELSE title END AS title, CASE WHEN v < 2 AND title <> p_name THEN title END AS raw_title,
  CASE WHEN v < 2 THEN CASE WHEN k % 7 = 0 THEN 'salary_inverted' ELSE '' END ELSE reasons END AS reasons, CASE WHEN NOT (v < 2 AND k % 5 IN (1, 2, 3)) THEN c END AS classification FROM t
""")
def q_resweep_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles kept as files by four versions, swept to the third; those of the fourth are left alone."""
    folder = shared_folder(spark, "titles")
    rows = _titles(spark, sf_dir)
    for version in range(4):
        S.append(rows.where(F.col("v") == version).drop("v"), folder, version)
    S.resweep(spark, folder, 2, S.retitled)
    S.resweep(spark, folder, 2, S.retitled)  # owes nothing any more
    return S.stored(spark, folder).select("job_id", F.col("version").cast("int").alias("version"), "title", "raw_title", F.array_join("reasons", ",").alias("reasons"), "classification")


_REKEYED = f"""{_SQL_TITLES}, s AS (SELECT p_partkey AS k, p_brand || '/' || CASE WHEN p_partkey % 3 < 2 THEN p_name ELSE 'old ' || p_partkey END AS key, p_brand || '/' || p_name AS new, p_partkey % 3 AS v, p_size AS seen, p_partkey % 2 = 0 AS scored,
  CASE p_partkey % 5 WHEN 0 THEN 'applied' WHEN 1 THEN 'reviewing' ELSE 'discovered' END AS status FROM part),
n AS (SELECT *, CASE WHEN v < 2 THEN new ELSE key END AS nk, v < 2 AS stale FROM s), t2 AS (SELECT *, bool_or(stale) OVER (PARTITION BY nk) AS touched FROM n)"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    stale = key % 3 < 2
    return V.table(spark, sf_dir, "part").select(
        key.alias("job_id"), F.concat("p_brand", F.lit("/"), F.when(stale, F.col("p_name")).otherwise(F.concat(F.lit("old "), key))).alias("key"), F.concat("p_brand", F.lit("/"), "p_name").alias("new"),
        (key % 3).cast("int").alias("version"), F.col("p_size").alias("first_seen"), F.col("p_size").alias("last_seen"), V.mapped((key % 5).cast("string"), {"0": "applied", "1": "reviewing"}, "discovered").alias("status"),
        F.when(key % 2 == 0, "apply").alias("classification"),
    )


@R.add(f"""
WITH {_REKEYED}, g AS (SELECT nk, count(*) AS n, min_by(k, (seen, k)) AS k, max(seen) AS seen, max_by(status, CASE status WHEN 'applied' THEN 2 WHEN 'reviewing' THEN 1 ELSE 0 END) AS top FROM t2 WHERE touched GROUP BY nk)
SELECT g.k AS job_id, g.nk AS key, 2 AS version, s.seen AS first_seen, g.seen AS last_seen, CASE WHEN n = 1 THEN s.status ELSE top END AS status, CASE WHEN n = 1 AND s.scored THEN 'apply' END AS classification FROM g JOIN s ON s.k = g.k
UNION ALL SELECT k, nk, v::INTEGER, seen, seen, status, CASE WHEN scored THEN 'apply' END FROM t2 WHERE NOT touched
""")
def q_rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rekeyed(_keyed(spark, sf_dir), 2, F.col("new"))[0].drop("new")


@R.add(f"WITH {_REKEYED}, g AS (SELECT nk, min_by(k, (seen, k)) AS k FROM t2 WHERE touched GROUP BY nk) SELECT t2.k AS duplicate_id, g.k AS canonical_id FROM t2 JOIN g ON g.nk = t2.nk WHERE t2.k <> g.k")
def q_rekeyed_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rekeyed(_keyed(spark, sf_dir), 2, F.col("new"))[1]


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bodies; some begin like a page that isn't there or say that the posting has expired."""
    key = F.col("doc_id")
    head = V.mapped((key % 5).cast("string"), {"0": "Page not found. ", "1": "This position has been filled. "}, "")
    return V.table(spark, sf_dir, "documents").select(
        key.alias("job_id"), F.lit("Job").alias("title"), F.concat(head, "text").alias("body"), F.when(key % 4 == 0, F.array(F.lit("jd_full_offsite"), F.lit("other"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.lit("static").alias("tier"), F.when(key % 2 == 0, "apply").alias("classification"), F.when(key % 3 == 0, 1).when(key % 3 == 1, 2).alias("judged"),
    )


@R.add("""
WITH b AS (SELECT doc_id AS k, CASE doc_id % 5 WHEN 0 THEN 'jd_full_offsite' WHEN 1 THEN 'jd_full_expired' END AS code, CASE WHEN doc_id % 4 = 0 THEN 'other' END AS other FROM documents)
SELECT k AS job_id, concat_ws(',', other, code) AS reasons, code IS NULL AS has_body, CASE WHEN code IS NULL THEN 'static' END AS tier, CASE WHEN code IS NULL AND k % 2 = 0 THEN 'apply' END AS classification FROM b
""")
def q_rebodied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rebodied(_bodies(spark, sf_dir)).select("job_id", F.array_join("reasons", ",").alias("reasons"), F.col("body").isNotNull().alias("has_body"), "tier", "classification")


@R.add("""
WITH b AS (SELECT doc_id AS k, doc_id % 4 <> 0 AND doc_id % 3 <> 1 AS owed, CASE doc_id % 5 WHEN 0 THEN 'jd_full_offsite' WHEN 1 THEN 'jd_full_expired' END AS code, CASE WHEN doc_id % 4 = 0 THEN 'jd_full_offsite,other' ELSE '' END AS had,
  CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS judged, CASE WHEN doc_id % 7 < 2 THEN doc_id % 7 = 0 END AS keep FROM documents),
v AS (SELECT *, CASE WHEN owed THEN CASE WHEN code IS NOT NULL THEN 'reject' ELSE 'ambiguous' END END AS verdict FROM b),
l AS (SELECT *, coalesce(verdict = 'reject' OR (verdict = 'ambiguous' AND NOT keep), false) AS lose, coalesce(verdict = 'ambiguous' AND keep, false) AS hold FROM v)
SELECT k AS job_id, verdict, CASE WHEN hold THEN 2 ELSE judged END AS judged, CASE WHEN lose THEN coalesce(code, 'jd_full_offsite') ELSE had END AS reasons, NOT lose AS has_body FROM l
""")
def q_adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    answers = V.table(spark, sf_dir, "documents").where(key % 7 < 2).select(key.alias("job_id"), (key % 7 == 0).alias("keep"))
    out = S.adjudicated(_bodies(spark, sf_dir), 2, answers)
    return out.select("job_id", "verdict", "judged", F.array_join("reasons", ",").alias("reasons"), F.col("body").isNotNull().alias("has_body"))


# intervals

@R.add()
def q_bca_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the draws come from a hash that DuckDB hasn't. Tests hold it against numpy."""
    return E.bca_mean(V.table(spark, sf_dir, "events"), "event_id", "value", "event_type", resamples=2000)


@R.add("""
SELECT DISTINCT user_id, event_type || hour(ts) AS fact FROM events WHERE value <= 20
EXCEPT SELECT user_id, event_type || hour(ts) FROM events WHERE value > 20
""")
def q_ungrounded_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")

    def fact(name: Column) -> Column:
        return F.concat(name, F.hour("ts").cast("string")).alias("fact")

    facts, profile = events.where("value <= 20").select("user_id", fact(F.upper("event_type"))), events.where("value > 20").select("user_id", fact(F.col("event_type")))
    return E.ungrounded(facts, profile, "user_id", "fact")
