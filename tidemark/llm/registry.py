"""The queries op1 to op10, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, license_scan, line_dedup, near_dedup, piece_sampling, quality_rules, suffix_dedup, token_output, url_filter


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; it is read in place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), hot AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), j AS (
  SELECT k.doc_id, k.line, k.pos, hot.key IS NOT NULL AS dropped FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(quality_rules.statistics(docs), rules).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents")).drop("row", "row2")


OP3_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS g FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), rare AS (
  SELECT s.doc_id, s.g, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.c, s.g) AS r, n.n FROM s JOIN (SELECT g, count(*) AS c FROM s GROUP BY g) f ON s.g = f.g JOIN n ON s.doc_id = n.doc_id
), p AS (
  SELECT * FROM rare WHERE r <= n - ceil(0.8 * n - 1e-9) + 1
), c AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), i AS (
  SELECT c.a, c.b, count(*) AS x FROM c JOIN s y ON y.doc_id = c.a JOIN s z ON z.doc_id = c.b AND z.g = y.g GROUP BY c.a, c.b
), e AS (
  SELECT i.a, i.b FROM i JOIN n p ON p.doc_id = i.a JOIN n q ON q.doc_id = i.b WHERE 100 * i.x >= 80 * (p.n + q.n - i.x)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), best AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, best.component_id, d.doc_id = best.component_id AS kept
FROM documents d JOIN best ON best.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.segment(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, where=~language_id.held_out())
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), kept=False)


#: Windows are told apart by 64-bit hashes of their bytes.
OP9_SQL = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, unnest(range(0, n - 199)) AS i, b FROM d WHERE n >= 200
), k AS (
  SELECT doc_id, i, hash(b[i + 1:i + 200]) AS m FROM w
), r AS (
  SELECT doc_id, i FROM k JOIN (SELECT m FROM k GROUP BY m HAVING count(*) > 1) USING (m)
), n AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM r
), g AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n
), s AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 200 AS e FROM g GROUP BY doc_id, run
), p AS (
  SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s
), t AS (
  SELECT p.doc_id, sum(p.e - a) AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN a > before THEN hex(b[before + 1:a]) ELSE '' END, '' ORDER BY a) || CASE WHEN max(p.e) < any_value(n) THEN hex(any_value(b)[max(p.e) + 1:any_value(n)]) ELSE '' END AS kept FROM p JOIN d USING (doc_id) GROUP BY p.doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN kept IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_near_dedup, op4_sentencepiece, op5_decontaminate, op6_language_id, op7_token_output, op8_url_filter, op9_suffix_dedup, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op3_near_dedup": OP3_SQL, "op9_suffix_dedup": OP9_SQL}
