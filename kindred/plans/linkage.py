"""End-to-end plans: read, block, label, score, decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocking, decide, evaluate, features, learn


def exact_key_linkage(s1: DataFrame, target: DataFrame, truth: DataFrame, rules: Sequence[str] = ("E",)) -> DataFrame:
    """Macro F0.5 of predicting every pair that the rules find: one row."""
    universe = s1.select(F.col("entity_id").alias("s1_id"))
    return evaluate.score(evaluate.entity_counts(universe, truth, blocking.union_rules(s1, target, rules)))


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    t = truth.select("s1_id", "target_id").distinct().withColumn("kd_t", F.lit(1))
    return pairs.join(t, ["s1_id", "target_id"], "left").withColumn("label", F.col("kd_t").isNotNull().cast("int")).drop("kd_t")


def model_linkage(s1: DataFrame, target: DataFrame, truth: DataFrame, rules: Sequence[str], threshold: float = 0.5, **params) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scored pairs, and the submission that a threshold makes of them."""
    pairs = label(blocking.union_rules(s1, target, rules), truth)
    rows = features.canonical(features.attach(learn.with_folds(pairs), s1, target))
    scored, _ = learn.out_of_fold(rows, features.NAMES, **params)
    scored = scored.withColumn("source", F.substring("target_id", 1, 2))
    chosen = decide.exclusive(scored.where(F.col("score") >= threshold))
    return scored, decide.submission(s1.select(F.col("entity_id").alias("s1_id")), chosen)
