"""Queries that hold single functions against SQL over whole tables: texts of pages, mail, feeds' records, factors of a score, merged postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hirelake.functions import content, fit, urls
from hirelake.functions.names import ENTITIES
from hirelake.operators import postings as PO
from hirelake.plans import views as V
from hirelake.plans.views import Registry
from hirelake.sources import feeds

R = Registry()

_DECODED = "t"
for _entity, _mark in ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_mark.replace(chr(39), chr(39) * 2)}')"


@R.add(rf"""
WITH a AS (SELECT page_id, regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'gis') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<li\b[^>]*>', E'\n- ', 'gi'), '</(?:p|div|section|article|ul|ol|table|h[1-6])\s*>', E'\n\n', 'gi') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '<br\s*/?>|</(?:tr|li)\s*>', E'\n', 'gi'), '<[^>]+>', '', 'gs') AS t FROM b),
d AS (SELECT page_id, {_DECODED} AS t FROM c),
e AS (SELECT page_id, regexp_replace(regexp_replace(t, '[ \t\x{{00A0}}]+', ' ', 'g'), ' ?\n ?', E'\n', 'g') AS t FROM d)
SELECT page_id, length(x) AS n_chars, md5(x) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(t, '\n{{3,}}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')) AS x FROM e)
""")
def q_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = content.html_to_text(F.col("html"))
    return V.table(spark, sf_dir, "pages").select("page_id", text.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


@R.add(r"""
SELECT conv_id, turn, regexp_replace(regexp_replace('To: a@b.org' || chr(10) || text || ' write to ' || role || '.' || turn || '@mail.example.com now', '^(?:to|cc|bcc|delivered-to|x-original-to|return-path):[^\n]*\n?', '', 'gim'), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[email]', 'g') AS body FROM conversations
""")
def q_scrubbed_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("To: a@b.org\n"), "text", F.lit(" write to "), "role", F.lit("."), F.col("turn").cast("string"), F.lit("@mail.example.com now"))
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", content.scrubbed(text).alias("body"))


@R.add("""
SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'rejection' WHEN turn % 5 = 1 THEN 'interview' WHEN turn % 5 = 2 THEN 'confirmation' WHEN turn % 5 = 3 THEN 'rejection' END AS kind FROM conversations
""")
def q_mail_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of three lists; a mail with phrases of two counts for the first of them."""
    said = V.mapped((F.col("turn") % 5).cast("string"), {"0": "Unfortunately, we went on with others", "1": "Can we schedule time for a phone screen?", "2": "Application received", "3": "Thank you for applying; unfortunately no interview"}, "Hello")
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", content.mail_kind(said, F.lit("")).alias("kind"))


@R.add("""
WITH p AS (SELECT *, p_partkey % 5 AS k FROM part WHERE p_partkey % 11 <> 3)
SELECT p_partkey, p_name AS title, p_brand AS company, CASE WHEN k = 4 THEN 'Remote' ELSE 'City ' || p_size END AS location, 'https://x.org/' || p_partkey AS url FROM p WHERE k <> 3
""")
def q_feed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of all parts under the names that feeds use; some are errors under a good status, some lack a company."""
    names = [("title", "company", "location", "url"), ("position", "company_name", "candidate_required_location", "jobUrl"), ("jobTitle", "companyName", "jobGeo", "link"), ("title", "nothing", "location", "url"), ("name", "organization", "where", "apply_url")]
    key = F.col("p_partkey")
    made = F.lit(None).cast("string")
    for i, (t, c, p, u) in enumerate(names):
        one = F.to_json(F.struct(F.lit(" ").alias("text"), F.col("p_name").alias(t), F.col("p_brand").alias(c), F.concat(F.lit("City "), F.col("p_size")).alias(p), F.concat(F.lit("https://x.org/"), key).alias(u)))
        made = F.when(key % 5 == i, one).otherwise(made)
    payload = F.when(key % 11 == 3, F.lit('{"error": "quota", "title": "x", "company": "y"}')).otherwise(made)
    found = feeds.postings(V.table(spark, sf_dir, "part").select("p_partkey", payload.alias("payload")))
    return found.select("p_partkey", "title", "company", "location", "url")


_SENIOR = "CASE " + " ".join(f"WHEN contains(t, '{w}') THEN 0" for w in fit.PENALTY) + " " + " ".join(f"WHEN contains(t, '{w}') THEN {v}" for w, v in fit.SENIORITY) + " ELSE 40 END"
_LEVELS = ("Director of ", "Senior ", "Intern ", "Staff ", "", "Junior ", "VP ")


@R.add(f"""
WITH p AS (SELECT p_partkey, lower((['{"', '".join(_LEVELS)}'])[p_partkey % {len(_LEVELS)} + 1] || p_name) AS t, lower(p_type) AS d, p_brand FROM part),
f AS (SELECT p_partkey, {_SENIOR} AS seniority, CASE WHEN contains(t, 'gear')::INTEGER + contains(t, 'steel')::INTEGER + contains(t, 'red')::INTEGER >= 2 THEN 100 WHEN contains(t, 'gear') OR contains(t, 'steel') OR contains(t, 'red') THEN 75 ELSE 30 END AS industry,
  CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 0 ELSE 50 END AS company FROM p)
SELECT *, round_even(seniority * 0.5::DOUBLE + industry * 0.3::DOUBLE + company * 0.2::DOUBLE, 1) AS score FROM f
""")
def q_score_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.element_at(F.array(*map(F.lit, _LEVELS)), (F.col("p_partkey") % len(_LEVELS) + 1).cast("int")), "p_name")
    rows = V.table(spark, sf_dir, "part").select(
        "p_partkey", fit.seniority_factor(title).alias("seniority"), fit.industry_factor(title, ("Gear", "Steel", "Red")).alias("industry"), fit.company_factor(F.col("p_brand"), ("BRAND#1", "brand#2")).alias("company")
    )
    return rows.withColumn("score", fit.heuristic_score({n: F.col(n) for n in ("seniority", "industry", "company")}, {"seniority": 0.5, "industry": 0.3, "company": 0.2}))


@R.add(r"""
WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, lower(replace(p_brand, '#', '')) AS b FROM part)
SELECT p_partkey, (['greenhouse', 'lever', 'ashby', 'smartrecruiters', 'workday', NULL])[k + 1] AS platform, CASE WHEN k < 5 THEN b END AS slug,
  CASE k WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN '00000000-0000-0000-0000-' || lpad(p_partkey::VARCHAR, 12, '0') WHEN 2 THEN '00000000-0000-0000-0000-' || lpad(p_partkey::VARCHAR, 12, '0') WHEN 3 THEN '74' || p_partkey WHEN 4 THEN 'JR-' || p_partkey END AS posting_id FROM p
""")
def q_posting_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, slug = F.col("p_partkey").cast("string"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    long = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(key, 12, "0"))
    shapes = [
        F.concat(F.lit("https://boards.greenhouse.io/"), slug, F.lit("/jobs/"), key, F.lit("?gh_src=1")), F.concat(F.lit("https://jobs.lever.co/"), slug, F.lit("/"), long, F.lit("/apply")), F.concat(F.lit("https://jobs.ashbyhq.com/"), slug, F.lit("/"), long),
        F.concat(F.lit("https://jobs.smartrecruiters.com/"), slug, F.lit("/74"), key, F.lit("-title")), F.concat(F.lit("https://"), slug, F.lit(".wd5.myworkdayjobs.com/en-US/x/job/City/Title_JR-"), key), F.concat(F.lit("https://example.org/jobs/"), key),
    ]
    url = F.element_at(F.array(*shapes), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = V.table(spark, sf_dir, "part").select("p_partkey", url.alias("url")).withColumn("b", urls.board(F.col("url")))
    return rows.select("p_partkey", "b.platform", "b.slug", urls.posting_id(F.col("url"), F.col("b.platform")).alias("posting_id"))


_UPSERT = """o AS (SELECT p_partkey AS k, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1 END AS company_id, p_size * 1000.0 AS lo, CASE WHEN p_partkey % 5 = 0 THEN 'archived' ELSE 'reviewing' END AS status, DATE '2024-01-01' + p_size AS seen FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT p_partkey AS k, 'new ' || p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 7 END AS company_id, p_size AS size, DATE '2024-01-21' AS seen FROM part WHERE p_partkey % 3 <> 1)"""


@R.add(f"""
WITH {_UPSERT}, b AS (SELECT coalesce(o.k, n.k) AS k, o.k IS NULL AS fresh, n.k IS NOT NULL AS again, o.title AS ot, n.title AS nt, o.company_id AS oc, n.company_id AS nc, o.status AS os, o.seen AS oseen, n.seen AS nseen FROM o FULL JOIN n ON o.k = n.k)
SELECT k AS dedup_key, coalesce(ot, nt) AS title, coalesce(nc, oc)::BIGINT AS company_id, CASE WHEN fresh THEN 'b' WHEN again THEN 'a,b' ELSE 'a' END AS sources, CASE WHEN fresh OR (again AND os = 'archived') THEN 'discovered' ELSE os END AS status,
  greatest(oseen, nseen) AS last_seen, NOT fresh AND again AND os = 'archived' AS reopened, fresh AS inserted, NOT again AS unchanged FROM b
""")
def q_posting_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    part = V.table(spark, sf_dir, "part")
    types = {"company_id": "long", "sources": "array<string>", "source_urls": "array<string>", "locations_raw": "array<string>", "locations": f"array<{PO.L.KIND}>", "salary_min": "double", "salary_max": "double", "posted_date": "date", "first_seen": "date", "last_seen": "date", "is_stale": "boolean", "expired_at": "date"}
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)

    def whole(df: DataFrame, **own: object) -> DataFrame:
        return df.select(key.alias("dedup_key"), *((own[c] if c in own else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in PO.FIELDS))

    def urls_of(*marks: str):
        return F.array(*(F.concat(F.lit(m), key.cast("string")) for m in marks))

    old = whole(part.where(key % 3 != 0), title=F.col("p_name"), company=F.col("p_brand"), company_id=F.when(key % 4 != 0, 1), sources=F.array(F.lit("a")), source_urls=urls_of("u"), status=F.when(key % 5 == 0, "archived").otherwise("reviewing"), last_seen=day(F.col("p_size")), first_seen=day(F.lit(0)), is_stale=F.lit(False), workplace_type=F.lit("UNSPECIFIED"))
    new = whole(part.where(key % 3 != 1), title=F.concat(F.lit("new "), "p_name"), company=F.col("p_brand"), company_id=F.when(key % 2 == 0, 7), sources=F.array(F.lit("b")), source_urls=urls_of("u", "v"), last_seen=day(F.lit(20)), first_seen=day(F.lit(20)))
    out = PO.upserted(old, new)
    return out.select("dedup_key", "title", "company_id", F.array_join("sources", ",").alias("sources"), "status", "last_seen", "reopened", (F.col("kind") == "inserted").alias("inserted"), (F.col("kind") == "unchanged").alias("unchanged"))
