"""Queries over windows, lifecycles, merging, matching, texts, evaluation, health and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hirelake.functions import content, fit, names, salary, urls
from hirelake.operators import evals as E, health as H, lifecycle as L, matching as X, merge as G
from hirelake.plans import views as V
from hirelake.plans.views import AXES, Registry
from hirelake.sources import feeds
from hirelake.streaming import stateful as S

R = Registry()
_AGE = "(epoch_us({a}) - epoch_us({b})) / 86400000000.0"


# windows

@R.add("""
WITH r AS (SELECT dedup_key, ntile(4) OVER (PARTITION BY classification ORDER BY salary, dedup_key) AS bucket FROM v_jobs WHERE salary IS NOT NULL)
SELECT bucket, count(*) AS n, min(dedup_key) AS least FROM r GROUP BY bucket
""")
def q_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("classification").orderBy("salary", "dedup_key")
    return V.jobs(spark, sf_dir).select("dedup_key", F.ntile(4).over(w).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.min("dedup_key").alias("least"))


@R.add("SELECT event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 50")
def q_cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return L.newest_per_group(rows, ["event_type"], [F.desc("ts"), F.col("event_id")], 50).drop("rn")


@R.add("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events)
SELECT event_type, round_even(avg(CASE WHEN value > 0 THEN value END), 2) AS baseline FROM r WHERE rn <= 20 GROUP BY event_type
""")
def q_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = L.newest_per_group(V.table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value"), ["event_type"], [F.desc("ts"), F.col("event_id")], 20)
    return last.groupBy("event_type").agg(F.bround(F.avg(F.when(F.col("value") > 0, F.col("value"))), 2).alias("baseline"))


@R.add("SELECT c_nationkey AS lane, c_custkey AS company_id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 4 AS batch FROM customer")
def q_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return V.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("lane"), F.col("c_custkey").alias("company_id"), ((F.row_number().over(w) - 1) % 4).cast("long").alias("batch"))


@R.add("SELECT user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 AS gap_seconds FROM events")
def q_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return V.table(spark, sf_dir, "events").select("user_id", "event_id", ((us(F.col("ts")) - us(F.lag("ts").over(w))) / 1000000.0).alias("gap_seconds"))


_STREAK = """
WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' AS broken, event_type IN ('purchase', 'signup') AS good FROM events),
i AS (SELECT *, sum(good::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e),
s AS (SELECT event_id, user_id, ts, broken, sum(broken::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM i)
"""


def _streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("broken"), F.col("event_type").isin("purchase", "signup").alias("good"))
    return L.streaks(events, "user_id", ["ts", "event_id"], F.col("broken"), F.col("good"))


@R.add(_STREAK + "SELECT event_id, user_id, streak::BIGINT AS streak FROM s")
def q_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streaks(spark, sf_dir).select("event_id", "user_id", "streak")


@R.add(_STREAK + "SELECT event_id, user_id, ts FROM s WHERE broken AND streak = 3")
def q_escalate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once per streak: the row on which it reaches three."""
    return _streaks(spark, sf_dir).where(F.col("broken") & (F.col("streak") == 3)).select("event_id", "user_id", "ts")


@R.add(_STREAK + "SELECT user_id, max(streak)::BIGINT AS worst, max(streak) >= 3 AS degraded FROM s GROUP BY user_id")
def q_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streaks(spark, sf_dir).groupBy("user_id").agg(F.max("streak").alias("worst"), (F.max("streak") >= 3).alias("degraded"))


@R.add("""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM s GROUP BY user_id, s
""")
def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sessions(V.table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", 30)


@R.add("""
SELECT a.event_id, a.user_id, max(struct_pack(t := b.ts, v := b.value)).v AS found
FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'signup' AND b.ts <= a.ts WHERE a.event_type = 'purchase' GROUP BY 1, 2
""")
def q_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'signup'").select("user_id", "ts", "value")
    return L.as_of_join(left, right, "user_id", "ts", "value").select("event_id", "user_id", "found")


@R.add("SELECT ts::DATE::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.daily(rows, "event_type").select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


@R.add("""
WITH s AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) AS start FROM events, (VALUES (0), (1), (2), (3)) t(k))
SELECT start, event_type, count(*) AS n FROM s GROUP BY 1, 2
""")
def q_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.sliding(rows, "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# lifecycle

@R.add(f"""
WITH a AS (SELECT max(first_seen) AS t FROM v_jobs)
SELECT dedup_key, CASE WHEN status IN ('discovered', 'reviewing') AND {_AGE.format(a="t", b="first_seen")} > 30 THEN 'archive'
  WHEN status IN ('discovered', 'reviewing') AND {_AGE.format(a="t", b="first_seen")} > 14 THEN 'mark' ELSE 'keep' END AS action FROM v_jobs, a
""")
def q_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = V.jobs(spark, sf_dir)
    return L.staleness(jobs, V.newest(jobs, "first_seen")).select("dedup_key", "action")


@R.add("""
WITH l AS (SELECT *, lag(to_status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS from_status FROM v_events)
SELECT event_id, job_id, from_status, to_status FROM l WHERE from_status IS DISTINCT FROM to_status
""")
def q_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.transitions(V.stage_events(spark, sf_dir)).select("event_id", "job_id", "from_status", "to_status")


@R.add(f"SELECT event_id, event_type FROM events, (SELECT max(ts) AS t FROM events) a WHERE {_AGE.format(a='t', b='ts')} <= CASE event_type WHEN 'error' THEN 7 WHEN 'view' THEN 14 ELSE 90 END")
def q_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    return L.retained(events, V.newest(events, "ts"), {"error": 7, "view": 14}, 90).select("event_id", "event_type")


@R.add("""
WITH s AS (SELECT dedup_key, status, salary > 350000 AS stale, CASE WHEN salary < 50000 THEN 'expired' END AS expiry FROM v_jobs)
SELECT dedup_key, CASE WHEN status IN ('applied', 'phone_screen', 'interviewing', 'offer', 'rejected', 'withdrawn') THEN status WHEN expiry = 'expired' THEN 'expired' WHEN stale THEN 'stale' ELSE coalesce(status, 'active') END AS shown FROM s
""")
def q_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = L.computed_status(F.col("status"), F.when(F.col("salary") < 50000, "expired"), F.col("salary") > 350000)
    return V.jobs(spark, sf_dir).select("dedup_key", shown.alias("shown"))


# merging

@R.add("""
WITH cut AS (SELECT '1998-01-01'::TIMESTAMP AS t), k AS (SELECT o_orderkey % 4000 AS k, o_totalprice AS value, o_orderdate AS seen FROM orders),
old AS (SELECT k, max_by(value, struct_pack(s := seen, v := value)) AS o_value, max(seen) AS o_seen FROM k, cut WHERE seen < t GROUP BY k),
new AS (SELECT k, max_by(value, struct_pack(s := seen, v := value)) AS n_value, min(seen) AS n_first, max(seen) AS n_last FROM k, cut WHERE seen >= t GROUP BY k)
SELECT coalesce(old.k, new.k) AS k, coalesce(n_value, o_value) AS value, coalesce(o_seen, n_first) AS first_seen, coalesce(greatest(o_seen, n_last), o_seen, n_last) AS last_seen,
  CASE WHEN o_seen IS NULL THEN 'inserted' WHEN n_last IS NULL THEN 'unchanged' WHEN n_value IS NOT NULL AND n_value IS DISTINCT FROM o_value THEN 'updated' ELSE 'touched' END AS kind
FROM old FULL JOIN new ON old.k = new.k
""")
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4000).alias("k"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("seen"))
    at = F.lit("1998-01-01").cast("timestamp_ntz")
    old = rows.where(F.col("seen") < at).groupBy("k").agg(F.max_by("value", F.struct("seen", "value")).alias("value"), F.max("seen").alias("seen"))
    return G.upsert(old, rows.where(F.col("seen") >= at), "k", "value", "seen")


_PART_STATUS = "CASE p_size % 4 WHEN 0 THEN 'discovered' WHEN 1 THEN 'archived' WHEN 2 THEN 'applied' ELSE 'rejected' END"
_PART_RANK = "CASE status WHEN 'applied' THEN 4 WHEN 'discovered' THEN 2 WHEN 'archived' THEN 1 ELSE 0 END"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = V.mapped((F.col("p_size") % 4).cast("string"), {"0": "discovered", "1": "archived", "2": "applied", "3": "rejected"})
    return V.table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey", "p_size", F.when(F.col("p_retailprice") > 1200, F.col("p_retailprice")).alias("low"), status.alias("status"))


@R.add(f"""
WITH p AS (SELECT p_brand, p_name, p_partkey, p_size, CASE WHEN p_retailprice > 1200 THEN p_retailprice END AS low, {_PART_STATUS} AS status FROM part)
SELECT p_brand, p_name, min_by(p_partkey, struct_pack(s := p_size, k := p_partkey)) AS canonical_id, count(*) - 1 AS duplicates,
  min_by(low, CASE WHEN low IS NOT NULL THEN struct_pack(s := p_size, k := p_partkey) END) AS value,
  CASE WHEN max({_PART_RANK}) >= 2 THEN max_by(status, struct_pack(r := {_PART_RANK}, s := status)) ELSE 'discovered' END AS status, max(p_size) AS last_seen
FROM p GROUP BY p_brand, p_name
""")
def q_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.retroactive(_parts(spark, sf_dir), ["p_brand", "p_name"], "p_partkey", "p_size", "low", "status")


@R.add("""
WITH f AS (SELECT p_brand, p_name, min_by(p_partkey, struct_pack(s := p_size, k := p_partkey)) AS canonical_id FROM part GROUP BY 1, 2)
SELECT p_partkey AS duplicate_id, canonical_id FROM part JOIN f USING (p_brand, p_name) WHERE p_partkey <> canonical_id
""")
def q_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lineage(_parts(spark, sf_dir), ["p_brand", "p_name"], "p_partkey", "p_size")


@R.add("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_size, p_partkey) = 1 AS canonical FROM part")
def q_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.canonical(_parts(spark, sf_dir), ["p_brand", "p_name"], [F.col("p_size"), F.col("p_partkey")]).select("p_partkey", "canonical")


@R.add("SELECT p_brand, arg_max(p_partkey, struct_pack(a := p_retailprice > 1500, b := p_size, c := -p_partkey)) AS winner, count(*) AS members FROM part GROUP BY p_brand")
def q_cluster_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cluster_winners(V.table(spark, sf_dir, "part"), "p_brand", "p_partkey", F.col("p_retailprice") > 1500, F.col("p_size"))


@R.add("""
WITH live AS (SELECT DISTINCT l_orderkey AS dedup_key FROM lineitem WHERE l_returnflag = 'N')
SELECT dedup_key, CASE WHEN live.dedup_key IS NOT NULL THEN 'live' WHEN company_id % 7 <> 0 THEN 'expired' ELSE 'unknown' END AS verdict FROM v_jobs LEFT JOIN live USING (dedup_key)
""")
def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = V.table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("dedup_key"))
    return G.reconciled(V.jobs(spark, sf_dir), live, "dedup_key", F.col("company_id") % 7 != 0).select("dedup_key", "verdict")


def q_loc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each supplier's nation merged with those of its region, in order; a fold, so there is no SQL for it."""
    nation = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    region = V.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    rows = V.table(spark, sf_dir, "supplier").join(F.broadcast(nation), "s_nationkey").join(F.broadcast(region), "n_regionkey")  # dimensions of fixed size
    merged = G.merged_places(F.array("n_name", F.lit("Onsite")), F.array(F.lower("n_name"), "r_name", F.lit("Remote")))
    return rows.select("s_suppkey", F.array_join(merged, ",").alias("places"))


R.add("SELECT s_suppkey, 'Remote,' || n_name || ',Onsite,' || r_name AS places FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(q_loc_merge)


# matching

def q_fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.fuzzy_pairs(V.table(spark, sf_dir, "part"), "p_name", least=85)


def q_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part")
    return X.best_fuzzy(part.where("p_size <= 25"), part.where("p_size > 25"), "p_name", least=90)


R.queries |= {"q_fuzzy_pairs": q_fuzzy_pairs, "q_fuzzy": q_fuzzy}


@R.add("""
WITH b AS (SELECT user_id % 50 AS g, event_type, event_id % 20 AS voter, max(value) AS w FROM events GROUP BY 1, 2, 3),
s AS (SELECT g, event_type, count(*) AS voters, sum(w) AS weight FROM b GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER o AS rn, lead(voters) OVER o AS nv, lead(weight) OVER o AS nw FROM s WINDOW o AS (PARTITION BY g ORDER BY voters DESC, weight DESC, event_type))
SELECT g, event_type, voters, round(weight, 4) AS weight FROM r WHERE rn = 1 AND (nv IS NULL OR nv <> voters OR nw <> weight)
""")
def q_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("g"), "event_type", (F.col("event_id") % 20).alias("voter"), "value")
    return X.votes(rows, "g", "event_type", "voter", "value").withColumn("weight", F.round("weight", 4))


def q_mail_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages against the jobs of the company whose number they carry; on the fixtures, the conversation's number."""
    names = F.concat(F.lit("Company"), F.col("company_id").cast("string"))
    jobs = V.jobs(spark, sf_dir).select("dedup_key", "company_id", "status", "first_seen", names.alias("company"), F.concat_ws(" ", F.lit("Senior"), "classification").alias("title"))
    domain = F.when(F.col("turn") % 3 == 0, F.lit("greenhouse.io")).when(F.col("turn") % 3 == 1, F.concat(F.lit("company"), F.col("conv_id").cast("string"), F.lit(".com"))).otherwise("example.org")
    mail = V.mail(spark, sf_dir).select(
        "message_id", F.col("conv_id").alias("company_id"), F.concat(F.lit("Your application to Company"), F.col("conv_id").cast("string")).alias("subject"),
        F.concat(F.lit("Thank you for applying as apply. "), "body").alias("body"), F.concat(F.lit("jobs@"), domain).alias("sender"),
        F.timestamp_add("day", (F.col("message_id") % 400).cast("int"), F.lit("1996-01-01").cast("timestamp_ntz")).alias("sent"),
    )
    return X.mail_matches(mail, jobs, "company_id")


R.add("""
WITH m AS (SELECT conv_id * 1000 + turn AS message_id, conv_id, turn, lower('Your application to Company' || conv_id || ' Thank you for applying as apply. ' || coalesce(text, '')) AS body,
  TIMESTAMP '1996-01-01' + ((conv_id * 1000 + turn) % 400)::INT * INTERVAL 1 DAY AS sent FROM conversations),
s AS (SELECT message_id, dedup_key, status, [x FOR x IN ['company', CASE WHEN contains(body, classification) THEN 'title' END,
  CASE WHEN abs(floor((epoch_us(sent) - epoch_us(first_seen)) / 86400000000.0)) <= 60 THEN 'timing' END,
  CASE WHEN turn % 3 = 0 THEN 'ats_domain' END, CASE WHEN turn % 3 = 1 THEN 'sender_company' END] IF x IS NOT NULL] AS signals
  FROM m JOIN v_jobs ON company_id = conv_id),
b AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY len(signals) DESC, (status = 'applied')::INT DESC, dedup_key) AS rn FROM s)
SELECT message_id, dedup_key, len(signals) AS score, array_to_string(signals, ',') AS signals,
  CASE WHEN len(signals) >= 4 OR len(signals) >= 3 AND (list_contains(signals, 'ats_domain') OR list_contains(signals, 'sender_company')) THEN 'auto' ELSE 'pending' END AS action
FROM b WHERE rn = 1
""")(q_mail_match)


@R.add("SELECT message_id, body FROM v_mail QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY body) = 1")
def q_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mail(spark, sf_dir).groupBy("message_id").agg(F.min("body").alias("body"))


@R.add("SELECT source, count(*) AS fetched, count(*) FILTER (lang = 'en') AS matching, count(*) FILTER (NOT known) AS novel FROM (SELECT source, lang, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents) GROUP BY source")
def q_source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = V.table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    rows = V.table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(known, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("fetched"), F.count_if(F.col("lang") == "en").alias("matching"), F.count_if(F.col("known").isNull()).alias("novel"))


# texts

@R.add(r"""
SELECT p_partkey, trim(regexp_replace(trim(lower(regexp_replace(p_name || ', Inc.', '\s+', ' ', 'g'))), '([,\s]+(inc|incorporated|llc|corp|corporation|ltd|limited|co|company|technologies|technology|tech|group|holdings?|services?|solutions?)\.?\s*)+$', '')) AS company_key FROM part
""")
def q_company_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").select("p_partkey", names.company_key(F.concat("p_name", F.lit(", Inc."))).alias("company_key"))


@R.add("SELECT p_partkey, 'senior ' || lower(p_name) || ' engineer' AS title_key FROM part")
def q_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").select("p_partkey", names.title_key(F.concat(F.lit("Sr. "), "p_name", F.lit("  Engineer (IC5)"))).alias("title_key"))


@R.add(r"SELECT doc_id FROM documents WHERE regexp_matches(lower(regexp_replace(text, '[^\p{L}\p{N}_\s]+', ' ', 'g')), '(^|\s)the\s+([^\s]+\s+){0,2}?of(\s|$)')")
def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").where(F.regexp_like(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}_\s]+", " ")), F.lit(names.loose_pattern("the of")))).select("doc_id")


@R.add("""
SELECT doc_id, length(trim(text)) < 200 OR starts_with(h, 'sign in') OR starts_with(h, 'loading') OR starts_with(h, 'open roles at') OR starts_with(h, 'skip to content')
  OR starts_with(h, 'cookie') OR starts_with(h, 'privacy policy') OR starts_with(h, '404') AS junk FROM (SELECT doc_id, text, lower(left(trim(text), 200)) AS h FROM documents)
""")
def q_junk_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", content.is_junk_body(F.col("text")).alias("junk"))


def q_body_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = content.body_verdict(F.col("text"), F.substring_index("text", "\n", 1))
    return V.table(spark, sf_dir, "documents").groupBy("lang", verdict.alias("verdict")).agg(F.count("*").alias("n"))


R.queries["q_body_verdicts"] = q_body_verdicts


@R.add(r"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{3,}'), lambda w: w NOT IN ('the', 'and', 'for', 'senior', 'lead', 'time', 'part', 'head'))) AS n FROM documents")
def q_telling_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in ("the", "and", "for", "senior", "lead", "time", "part", "head")])
    return V.table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(words, lambda w: ~F.array_contains(stop, w))).cast("long").alias("n"))


@R.add(r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)', 1)) AS host, array_to_string(list_slice(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)', 1)), '.'), -2, -1), '.') AS domain FROM pages")
def q_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.domain(F.col("url")).alias("domain"))


@R.add(r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS b, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS p,
  list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('gclid', 'fbclid', 'msclkid', 'ref', 'referer', 'referrer', 'trk', 'source') AND NOT starts_with(lower(x), 'utm_') AND NOT starts_with(lower(x), 'mc_'))) AS q,
  regexp_extract(url, '(#.*)$', 1) AS f FROM pages),
c AS (SELECT page_id, CASE WHEN b = '' THEN url ELSE lower(b) || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END || f END AS url FROM u)
SELECT min(page_id) AS page_id, url FROM c GROUP BY url
""")
def q_canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = V.table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))
    return feeds.first_seen_urls(pages, "url", ["page_id"])


@R.add(r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="[^"]*"[^>]*>.*?</a>', 0, 'is')) AS a FROM pages)
SELECT page_id, count(*) AS links, count(DISTINCT regexp_extract(a, 'href="([^"]*)"', 1, 'i')) AS distinct_links FROM a GROUP BY 1
""")
def q_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.anchors(V.table(spark, sf_dir, "pages").select("page_id", "html")).groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("link").alias("distinct_links"))


@R.add("""
WITH s AS (SELECT dedup_key, salary AS v, CASE dedup_key % 4 WHEN 0 THEN 'annual' WHEN 1 THEN 'monthly' WHEN 2 THEN 'unknown' ELSE 'weekly' END AS period FROM v_jobs),
y AS (SELECT dedup_key, period, v * CASE period WHEN 'monthly' THEN 12 WHEN 'weekly' THEN 52 ELSE 1 END AS year FROM s)
SELECT dedup_key, CASE WHEN year BETWEEN 30000 AND 5000000 THEN trunc(year)::BIGINT END AS salary_min,
       CASE WHEN NOT year BETWEEN 30000 AND 5000000 THEN 'implausible' WHEN period IN ('annual', 'unknown') THEN 'ok' ELSE 'salvaged_' || period END AS resolution FROM y
""")
def q_salary(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = V.mapped((F.col("dedup_key") % 4).cast("string"), {"0": "annual", "1": "monthly", "2": "unknown", "3": "weekly"})
    pair = salary.normalized(F.col("salary"), F.lit(None).cast("double"), period, F.lit("feed_string"))
    return V.jobs(spark, sf_dir).select("dedup_key", pair.alias("x")).select("dedup_key", "x.salary_min", "x.resolution")


@R.add("""
SELECT dedup_key, CASE WHEN salary >= 240000 THEN 100 WHEN salary >= 200000 THEN 85 WHEN salary >= 160000 THEN 50 ELSE 10 END AS factor FROM v_jobs
""")
def q_salary_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jobs(spark, sf_dir).select("dedup_key", fit.salary_factor(F.lit(None).cast("double"), F.col("salary"), 200000).alias("factor"))


@R.add(f"""
WITH a AS (SELECT max(first_seen) AS t FROM v_jobs), d AS (SELECT dedup_key, {_AGE.format(a="t", b="first_seen")} AS days FROM v_jobs, a)
SELECT dedup_key, CASE WHEN days < 1 THEN 100 WHEN days < 3 THEN 85 WHEN days < 7 THEN 65 WHEN days < 14 THEN 40 ELSE 20 END AS factor FROM d
""")
def q_recency_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = V.jobs(spark, sf_dir)
    return jobs.select("dedup_key", fit.recency_factor(F.col("first_seen"), V.newest(jobs, "first_seen")).alias("factor"))


@R.add("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def q_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events").select("event_id", feeds.field(F.col("props"), ("kind", "k")).try_cast("long").alias("k"))


# evaluation

@R.add("SELECT count(*) AS n, round(avg(abs(s1 - s0)), 6) AS mae, round(avg(s1 - s0), 6) AS bias FROM v_axes")
def q_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.errors(V.axes(spark, sf_dir), "s0", "s1")


@R.add("""
WITH m AS (SELECT count(*) AS n, avg(s0) AS ma, avg(s1) AS mb, avg(s0 * s0) AS maa, avg(s1 * s1) AS mbb, sum((s0 - s1) * (s0 - s1)) AS seen FROM v_axes)
SELECT n, round(1 - seen / (n * (maa + mbb - 2 * ma * mb)), 6) AS kappa FROM m
""")
def q_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.weighted_kappa(V.axes(spark, sf_dir), "s0", "s1")


@R.add("""
WITH p AS (SELECT s0::DOUBLE AS x, s1::DOUBLE AS y FROM v_axes), g AS (SELECT count(*) AS n, avg((x + y) / 2) AS m, avg(x) AS mx, avg(y) AS my FROM p),
s AS (SELECT n, 2 * sum(((x + y) / 2 - m) ** 2) AS rows_ss, n * ((any_value(mx) - any_value(m)) ** 2 + (any_value(my) - any_value(m)) ** 2) AS cols_ss, sum((x - m) ** 2 + (y - m) ** 2) AS total FROM p, g GROUP BY n)
SELECT n, round((rows_ss / (n - 1) - (total - rows_ss - cols_ss) / (n - 1)) / (rows_ss / (n - 1) + (total - rows_ss - cols_ss) / (n - 1) + 2 * (cols_ss - (total - rows_ss - cols_ss) / (n - 1)) / n), 6) AS icc FROM s
""")
def q_icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.icc(V.axes(spark, sf_dir), "s0", "s1")


def _classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in ("apply", "consider", "skip", "reject", "low_signal")], "class string")


def _class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return V.axes(spark, sf_dir).select(F.col("classification").alias("gold"), fit.classified([F.col(a) for a in AXES], none, none, F.lit(None).cast("int"), F.lit(False)).alias("guess"))


_PAIRS = """
WITH p AS (SELECT classification AS gold, CASE WHEN s0 = 3 AND s1 = 3 AND s2 = 3 AND s3 = 3 AND s4 = 3 AND s5 = 3 THEN 'low_signal'
  WHEN least(s0, s1, s2, s3, s4, s5) = 1 THEN 'reject'
  WHEN least(s0, s1, s2, s3, s4, s5) >= 3 AND (s0 >= 4)::INT + (s1 >= 4)::INT + (s2 >= 4)::INT + (s3 >= 4)::INT + (s4 >= 4)::INT + (s5 >= 4)::INT >= 3 AND (s0 + s1 + s2 + s3 + s4 + s5) / 6.0 >= 3.5 THEN 'apply'
  ELSE 'consider' END AS guess FROM v_axes), k(class) AS (VALUES ('apply'), ('consider'), ('skip'), ('reject'), ('low_signal'))
"""


@R.add(_PAIRS + "SELECT a.class AS y_true, b.class AS y_pred, (SELECT count(*) FROM p WHERE gold = a.class AND guess = b.class) AS n FROM k a, k b")
def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_class_pairs(spark, sf_dir), _classes(spark), "gold", "guess")


@R.add(_PAIRS + """, s AS (SELECT class, (SELECT count(*) FROM p WHERE gold = class AND guess = class)::DOUBLE AS tp, (SELECT count(*) FROM p WHERE gold = class) AS support, (SELECT count(*) FROM p WHERE guess = class) AS named FROM k),
m AS (SELECT class, coalesce(tp / nullif(named, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r, support FROM s)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, support FROM m""")
def q_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_class(_class_pairs(spark, sf_dir), _classes(spark), "gold", "guess")


@R.add(_PAIRS + "SELECT round(avg((gold <> 'apply')::INT) FILTER (guess = 'apply'), 6) AS rate FROM p")
def q_false_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.false_apply_rate(_class_pairs(spark, sf_dir), "gold", "guess")


@R.add("SELECT lang, source, doc_id FROM documents SEMI JOIN labels USING (doc_id) QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) <= 3")
def q_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed number from each stratum; the order is a key, so it is the same on every run."""
    labelled = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(V.table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return L.newest_per_group(labelled, ["lang", "source"], [F.desc("n_chars"), F.col("doc_id")], 3).select("lang", "source", "doc_id")


# health

@R.add(f"""
WITH a AS (SELECT max(ts) AS t FROM events),
x AS (SELECT 'owner_idle' AS signal, {_AGE.format(a="any_value(t)", b="max(ts)")} AS value, 14.0 AS threshold FROM events, a WHERE event_type IN ('click', 'purchase')
UNION ALL SELECT 'source_deadman', max(d), 2.0 FROM (SELECT {_AGE.format(a="any_value(t)", b="max(ts)")} AS d FROM events, a GROUP BY user_id)
UNION ALL SELECT 'failure_burst', count(*), 4.0 FROM events, a WHERE event_type = 'error' AND {_AGE.format(a="t", b="ts")} < 1)
SELECT signal, round(value, 6)::DOUBLE AS value, threshold::DOUBLE AS threshold, coalesce(value > threshold, false) AS fired FROM x
""")
def q_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    t = V.newest(events, "ts")
    return H.heartbeat(
        H.idle(events, t, F.col("event_type").isin("click", "purchase")), H.deadman(events, t, "user_id", 1.0), H.failure_burst(events, t, F.col("event_type") == "error")
    )


@R.add(_PAIRS + "SELECT 'score_rot' AS signal, round(avg((gold <> guess)::INT), 6) AS value, 0.01::DOUBLE AS threshold, avg((gold <> guess)::INT) > 0.01 AS fired FROM p WHERE gold <> 'low_signal'")
def q_alarm_rot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.score_rot(_class_pairs(spark, sf_dir), "gold", "guess")


@R.add(f"WITH a AS (SELECT max(ts) AS t FROM v_ledger) SELECT 'paid_leak' AS signal, round(coalesce(sum(cost), 0)::DOUBLE, 6) AS value, 0.0::DOUBLE AS threshold, coalesce(sum(cost), 0) > 0 AS fired FROM v_ledger, a WHERE {_AGE.format(a='t', b='ts')} < 7 AND provider <> 'F'")
def q_alarm_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = V.ledger(spark, sf_dir)
    return H.paid_leak(ledger, V.newest(ledger, "ts"), ("F",))


# streams, run over what there is

def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.source(spark, f"{sf_dir}/events*.parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema)


@R.add("SELECT ts::DATE::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.run_once(S.daily(_stream(spark, sf_dir), "event_type"), "daily", mode="update", keys=("day", "event_type"))
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


@R.add("SELECT DISTINCT user_id FROM events")
def q_stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_once(S.exactly_once(_stream(spark, sf_dir), "user_id", ttl="400 days").select("user_id"), "once")


@R.add(_STREAK + "SELECT user_id::VARCHAR AS source, count(*) AS alerts FROM s WHERE broken AND streak = 3 GROUP BY user_id")
def q_stream_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).withColumn("source", F.col("user_id").cast("string"))
    alerts = S.break_alerts(rows, "source", F.col("event_type") == "error", F.col("event_type").isin("purchase", "signup"))
    return S.run_once(alerts, "breaks").groupBy("source").agg(F.count("*").alias("alerts"))
