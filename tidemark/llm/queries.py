"""The digest queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import read_digest, write_order

    return read_digest(write_order(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.shingle_join import jaccard_groups

    return jaccard_groups(_table(spark, sf_dir, "documents"), k=5, percent=80)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_output import read_digest, write_tokens

    return read_digest(write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import identify_languages, train_language

    docs = _table(spark, sf_dir, "documents")
    return identify_languages(docs, train_language(docs))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import judge

    trusted = _table(spark, sf_dir, "labels").filter("quality = 1")
    judged = judge(_table(spark, sf_dir, "documents"), trusted)
    return judged.select("doc_id", "perplexity", "threshold", "trusted", "kept")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_extract import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_counts import count_tokens

    counted = count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), budget=4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "fits_chars")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("tiles")


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_output": op4_token_output,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_html_text": op7_html_text,
    "op8_token_counts": op8_token_counts,
    "op9_license_scan": op9_license_scan,
    "op10_decontaminate": op10_decontaminate,
}
SQL = {
    "op2_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rnk FROM per),
weighed AS (
  SELECT *, CASE rnk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         CASE rnk % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope
  FROM ranked),
leveled AS (
  SELECT *, 3 * source_size / w AS ratio,
         ((SELECT sum(source_size) FROM per) - 3 * coalesce(sum(source_size) OVER (ORDER BY 3 * source_size / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY 3 * source_size / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
water AS (SELECT min_by(level, ratio) AS level FROM leveled WHERE level <= ratio),
aimed AS (
  SELECT source, source_size, slope, least(3.0::DOUBLE * source_size, coalesce((SELECT level FROM water), 0) * w)::DOUBLE AS target FROM leveled),
targets AS (
  SELECT source, source_size, target, round(slope - coalesce((SELECT sum(target * slope) / nullif(sum(target), 0) FROM aimed), 0), 9) AS slope FROM aimed),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.slope,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
took AS (
  SELECT *, least(whole * size + greatest(0, least(size, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) - before)), 3 * size) AS taken,
         least(1.0::DOUBLE, greatest(0.0::DOUBLE, before::DOUBLE / target)) AS u
  FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN u
         ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END END AS position
FROM took""",
}
