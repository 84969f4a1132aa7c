"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination
and best-fit packing, each a stage whose result is written as Parquet and read by the next.

Each function takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``.

Defined results: a null or empty text, or one of fewer than ten words, goes with the quality rules;
an empty table passes through all stages and packs to no rows; columns beyond those of documents are
carried along, whatever their names, to the last stage, which returns pieces alone; rows are told
apart by doc_id and text, so of rows equal in both one stays, and a repeated doc_id with another text
is a document of its own; a null doc_id is ordered last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import decontam, line_dedup, ngram_join, packing, quality_rules
from kindred.llm.common import scope, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality_rules.keep(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; no document does."""
    return line_dedup.dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more one document stays, that of the
    smallest doc_id; documents without words stay."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its error budget, go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", lines_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express tokenization or the packing; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each settled as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        with scope():  # what a stage settles or broadcasts goes once its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
    return docs
