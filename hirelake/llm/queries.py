"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hirelake.llm import decontaminate, importance, language, line_quality, merkle, ngram_join, packing, secrets, suffix_dedup, token_counts, toxicity, url_filters, warc
from hirelake.llm.shared import new_folder, small_batches, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed values of the contract: host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(_table(spark, sf_dir, "pages"), rules)


SQL_OP6 = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
  FROM cut
), rules(h, p, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM (
  SELECT page_id, host, path,
         (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
          ORDER BY length(h || p) DESC LIMIT 1) AS rule,
         (SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
          ORDER BY length(h || p) DESC LIMIT 1) AS verdict
  FROM parts)
"""


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(_table(spark, sf_dir, "documents"))


SQL_OP9 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id
), norm AS (
  SELECT doc_id, source, text,
         regexp_replace(lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]', '0', 'g') AS line
  FROM (SELECT doc_id, source, text, unnest(lines) AS x FROM d)
), often AS (
  SELECT source, line FROM norm GROUP BY source, line HAVING count(DISTINCT text) > 100
), lost AS (
  SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM norm JOIN often USING (source, line) GROUP BY doc_id
), all_counts AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_removed_words <= 0.5 * n_words AS kept
FROM all_counts
"""


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(documents, toxicity.train(documents, _table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_counts.token_blocks(_table(spark, sf_dir, "documents"))
    return token_counts.count(written(blocks, "tokens"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


SQL_OP3 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), placed AS (
  SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))
), hit AS (
  SELECT doc_id, item_id, i, placed.n FROM placed JOIN win ON placed.g = win.g AND placed.n = win.n
), words AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    captures = warc.assemble(written(warc.read(spark, folder, with_payload=False), "records"))

    def key(head: str) -> Column:
        return F.regexp_extract(head, r"key: (-?\d+)", 1).try_cast("long")

    return captures.select(
        key("metadata.head").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        key("origin.metadata_head").alias("refers_to"),
    )


SQL_OP4 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), j AS (
  SELECT page_id, n, digest, max(page_id) OVER (PARTITION BY digest) AS last FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM j
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(documents, with_ids=False), groups=packing.groups_for(documents))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", suffix_dedup.n_removed().alias("n_removed"), n_spans, "kept_sha256")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(documents, secrets.train(documents)).select("doc_id", "spans")
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.KINDS))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [number(kind) for kind in (*secrets.KINDS, secrets.ADDED)]
    return found.select("doc_id", *kinds, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL_OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM d
  UNION
  SELECT links.b AS node, reach.root FROM reach JOIN links ON links.a = reach.node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(root) FROM reach WHERE node = d.doc_id) AS component_id
FROM d LEFT JOIN sizes USING (doc_id)
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    told = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else c for c in merkle.COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf(told)).otherwise(merkle.leaf(merkle.COLUMNS))
    rows = merkle.manifest(documents, carry={"shown": tampered})
    rows = rows.withColumn("folded_root", merkle.folded(F.col("shown"), F.col("path")))
    proof = F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The table of CRC-32 as a common table expression, and the CRC-32 of a list of bytes.
SQL_CRC = """crc AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM range(256) r(i))
)"""


def _sql_crc(text: str) -> str:
    digits = f"list_transform(range(1, strlen({text}) + 1), lambda i: (instr('0123456789ABCDEF', substr(hex(encode({text})), 2 * i - 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode({text})), 2 * i, 1)) - 1)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda a, b: xor(t[xor(a % 256, b) + 1], a // 256)))"


SQL_OP11 = f"""
WITH RECURSIVE {SQL_CRC}, cut AS (
  SELECT doc_id, source, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
         coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         CASE WHEN {_sql_crc("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown, text
  FROM documents, crc
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS shown,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place
  FROM cut
), tree AS (
  SELECT source, 0 AS level, list(leaf ORDER BY doc_id) AS nodes FROM leaves GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM tree WHERE len(nodes) > 1
), subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place FROM tree WHERE len(nodes) = 1
), top AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM top WHERE len(nodes) > 1
), own AS (
  SELECT doc_id, level, place // (3 ** level)::BIGINT AS p, nodes FROM leaves JOIN tree ON leaves.source IS NOT DISTINCT FROM tree.source WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, 100 + level, subroots.place // (3 ** level)::BIGINT AS p, nodes FROM leaves JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source, top WHERE len(nodes) > 1
), steps AS (
  SELECT doc_id, level, array_to_string(nodes[p - p % 3 + 1:p], '') AS before, array_to_string(nodes[p + 2:p - p % 3 + 3], '') AS after FROM own
), paths AS (
  SELECT doc_id, string_agg(before || after, '' ORDER BY level) AS proof, list(before || '|' || after ORDER BY level) AS steps FROM steps GROUP BY doc_id
), folds AS (
  SELECT leaves.doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_prepend(shown, coalesce(steps, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM leaves JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source LEFT JOIN paths ON paths.doc_id = leaves.doc_id
)
SELECT *, folded_root = root AS verified FROM folds
"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = language.train(documents.where(language.learnable()))
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")
    return language.predict(documents, model).select("doc_id", held_out, "lang_pred", "score")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


SQL_OP13 = f"""
WITH {SQL_CRC}, texts AS (
  SELECT doc_id, false AS target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT NULL, true, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), grams AS (
  SELECT doc_id, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM texts
), counted AS (
  SELECT doc_id, target, g, count(*) AS n FROM grams GROUP BY doc_id, target, g
), hashed AS (
  SELECT g, {_sql_crc("g")} % 10000 AS bucket FROM (SELECT DISTINCT g FROM counted), crc
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS t FROM counted JOIN hashed USING (g) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM sums
), weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
  FROM counted JOIN hashed USING (g) JOIN gains USING (bucket) WHERE NOT target GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (doc_id) WHERE NOT target
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranks USING (doc_id)
"""


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op6_url_filters": op6_url_filters,
    "op9_line_quality": op9_line_quality,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_language_id": op12_language_id,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL = {
    "op3_decontamination": SQL_OP3,
    "op4_warc": SQL_OP4,
    "op6_url_filters": SQL_OP6,
    "op9_line_quality": SQL_OP9,
    "op10_ngram_jaccard_join": SQL_OP10,
    "op11_merkle_manifest": SQL_OP11,
    "op13_importance_resampling": SQL_OP13,
}
