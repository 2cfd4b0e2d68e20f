"""The thin queries over the test tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from percepta.llm import collocations, decontaminate, lattice, line_dedup, minhash, mixing, quality, quality_rules, secrets, toxicity, url_rules, warc, whitening
from percepta.llm.labelled import held_out

#: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_documents(_table(spark, sf_dir, "documents"), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), "start", "n_words")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), share=1.5, weights=(3.0, 1.0, 2.0), most_epochs=2)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"), "quality", 4, 2)
    out = quality.score_quality(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), "toxic", 5, 0)
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate_lines(_table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.MEASURES[:5], "base_failed", "kept")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_warc, op3_minhash_near_dedup, op4_decontamination, op5_secret_scan, op6_mix_sources, op7_url_filter, op8_quality_classifier, op9_toxicity, op10_line_dedup, op11_quality_rules, op12_embedding_whitening, op13_phrase_collocations)}


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

# Base 32 from the hexadecimal digest: five digits give four letters.
OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), r AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM r
"""

OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i, len(l) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents)
), g AS (
  SELECT doc_id, n, x || coalesce(' ' || lead(x, 1) OVER o, '') || coalesce(' ' || lead(x, 2) OVER o, '') || coalesce(' ' || lead(x, 3) OVER o, '') AS s, i
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), s AS (SELECT DISTINCT doc_id, s FROM g WHERE i = 1 OR i <= n - 3),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sized AS (SELECT doc_id, s, n FROM s JOIN z USING (doc_id)),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS m, any_value(b.n) AS n
  FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM met WHERE 100 * shared >= 80 * (m + n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c USING (doc_id) LEFT JOIN z USING (doc_id)
"""

OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u,
         coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (length(text) - length(regexp_replace(text, '[#$%&*<>{}\\[\\]|\\\\^~=_+@]', '', 'g'))) / nullif(length(text), 0))), 1.0::DOUBLE) AS w
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, w, source NULLS LAST) AS k,
         (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget
  FROM s
), g AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f
), h AS (SELECT min(k) AS k FROM g WHERE level * w < cap),
t AS (
  SELECT g.source, g.source_size, CASE WHEN h.k IS NULL OR g.k < h.k THEN g.cap ELSE least(g.cap, g2.level * g.w) END AS target
  FROM g CROSS JOIN h LEFT JOIN g g2 ON g2.k = h.k
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.w, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((epochs + CASE WHEN target - epochs * source_size > 0 AND start + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""

OP7_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.v,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST, length(r.h) DESC) AS k
  FROM u LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""

_TRIM = "trim({}, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"

OP10_SQL = f"""
WITH pages AS (
  SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL
), total AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
lines AS (
  SELECT source, line, count(*) AS n
  FROM (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format("x")}))) AS line FROM pages)
  WHERE line <> '' GROUP BY source, line
), common AS (
  SELECT l.source, list(l.line) AS c FROM lines l JOIN total t ON l.source IS NOT DISTINCT FROM t.source
  WHERE l.n > 1 AND l.n > t.n * 0.1::DOUBLE GROUP BY l.source
), d AS (
  SELECT doc_id, d.source, text, coalesce(c, []) AS c, string_split(text, chr(10)) AS l
  FROM documents d LEFT JOIN common k ON d.source IS NOT DISTINCT FROM k.source
), x AS (SELECT *, list_filter(l, lambda x: NOT list_contains(c, {_TRIM.format("x")}) OR {_TRIM.format("x")} = '') AS kept FROM d)
SELECT doc_id, source, CASE WHEN len(kept) < len(l) THEN array_to_string(kept, chr(10)) ELSE text END AS text,
       CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l) - len(kept), 0) AS BIGINT) AS n_dropped
FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op3_minhash_near_dedup": OP3_SQL, "op6_mix_sources": OP6_SQL, "op7_url_filter": OP7_SQL, "op10_line_dedup": OP10_SQL, "op11_quality_rules": quality_rules.SQL, "op13_phrase_collocations": collocations.SQL}
