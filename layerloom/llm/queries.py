"""The registered queries of this subpackage: op1 to op10 over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom.llm import language_id, license_scan, quality_classifier, quality_rules
from layerloom.llm._spark import held_out
from layerloom.llm.bpe import bpe_round_trip
from layerloom.llm.html_text import html_text
from layerloom.llm.media import media_columns
from layerloom.llm.near_dedup import near_dedup
from layerloom.llm.packing import best_fit_packing
from layerloom.llm.substring_dedup import substring_dedup


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = license_scan.license_scan(docs, license_scan.learn_from(docs))
    return out.withColumn("families", F.array_join("families", ",")).drop("licensed")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.learn_from(docs, _table(spark, sf_dir, "labels"))
    scored = quality_classifier.quality_scores(docs.select("doc_id", "text"), model)
    return scored.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", "predicted")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), ngram=3, percent=85)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.learn_from(docs, ~held_out("doc_id"))
    out = language_id.identify(docs.select("doc_id", "text"), model, keep_spans=False)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_table(spark, sf_dir, "documents"), keep_media=False)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"), VOCABULARY, keep_ids=False)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.learn_from(docs, _table(spark, sf_dir, "labels")))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(_table(spark, sf_dir, "documents"), VOCABULARY, keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_html_extraction": op4_html_extraction,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_language_id": op6_language_id,
        "op7_media_columns": op7_media_columns,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_quality_rules": op9_quality_rules,
        "op10_bpe_round_trip": op10_bpe_round_trip,
    }


_OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d) t),
firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hits, range(0, 13) r(k)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(counts.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN counts ON d.doc_id = counts.doc_id
"""
_OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) t
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs p JOIN sizes x ON p.a = x.doc_id JOIN sizes y ON p.b = y.doc_id WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, s.b FROM reach r JOIN steps s ON r.y = s.a),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least ON d.doc_id = least.x LEFT JOIN sizes ON d.doc_id = sizes.doc_id
"""
#: What SQL can say of op9: its base counts and verdict (tests compare them; `kept` is learned).
OP9_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM lines GROUP BY doc_id),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d) x),
twice AS (SELECT doc_id, s FROM windows GROUP BY ALL HAVING count(*) > 1),
inside AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows JOIN twice USING (doc_id, s), range(0, 3) r(k) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(inside.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN inside ON d.doc_id = inside.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
"""


def oracle_sql() -> dict[str, str]:
    """Learned models, tokenizers, JPEGs and packing have no SQL; tests hold them against brute force instead."""
    return {"op2_substring_dedup": _OP2_SQL, "op5_minhash_near_dedup": _OP5_SQL}
