"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, kn_quality, line_dedup, ngram_join, packing, quality_rules, secrets, token_counts, toxicity, training_order
from .common import documents


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(documents(spark, sf_dir), k=3, num=90, den=100)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(documents(spark, sf_dir)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.verdict(quality_rules.ledger(documents(spark, sf_dir)))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.md5("text").alias("text_md5"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.digest(spark, *training_order.training_order(documents(spark, sf_dir)))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    return found.select("doc_id", F.sha2("secret", 256).alias("secret_sha256"), F.length("secret").cast("long").alias("n_chars"), "probability")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op")}
    return {k: found[k] for k in sorted(found, key=lambda k: int(k[2:].split("_")[0]))}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express."""
    op5 = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
    win AS (
      SELECT r, p, array_to_string(w[p:p + 4], ' ') AS g
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1))) AS p FROM d WHERE len(w) >= 5)
    ),
    hit AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
    covered AS (SELECT r, count(DISTINCT p + o) AS n_repeat FROM hit, (SELECT unnest(range(0, 5)) AS o) GROUP BY r),
    m AS (
      SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
        coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN covered USING (r)
    ),
    f AS (SELECT *, ({" + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(quality_rules.RULES.values()))})::BIGINT AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      (failed & {quality_rules.mask("base")}) <> 0 AS base_failed, (failed & {quality_rules.mask("v1") | quality_rules.mask("base")}) = 0 AS kept, failed
    FROM f
    """
    op6 = r"""
    WITH l AS (
      SELECT doc_id, text, i, x FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)
    ),
    w AS (
      SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')) AS k
      FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
    ),
    g AS (
      SELECT doc_id, p, k || chr(10) || lead(k) OVER d || chr(10) || lead(k, 2) OVER d AS g FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY p)
    ),
    again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
    gone AS (SELECT DISTINCT w.doc_id, w.i FROM again JOIN w ON w.doc_id = again.doc_id AND w.p BETWEEN again.p AND again.p + 2),
    kept AS (
      SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS t FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i WHERE gone.i IS NULL GROUP BY l.doc_id
    )
    SELECT documents.doc_id, length(coalesce(t, ''))::BIGINT AS n_chars, md5(coalesce(t, '')) AS text_md5 FROM documents LEFT JOIN kept USING (doc_id)
    """
    return {"op5_quality_rules": op5, "op6_line_dedup": op6}
