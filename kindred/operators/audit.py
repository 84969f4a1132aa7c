"""Audits of tables: duplicates, missing fields, lengths, ids, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: rows, missing, blank, distinct, shortest, longest and mean length. One scan."""
    x = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*")
    return x.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"), F.count(F.when(F.trim("v") == "", 1)).alias("blank"), F.countDistinct("v").alias("distinct_values"), F.min(F.length("v")).alias("shortest"), F.max(F.length("v")).alias("longest"), F.avg(F.length("v")).alias("mean_length"))


def duplicates(df: DataFrame, *by: str) -> DataFrame:
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("groups"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("surplus_rows"), F.max("n").alias("largest"))


def candidate_set(pairs: DataFrame, s1: DataFrame, target: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of integrity counts and recall of a candidate table ``s1_id, target_id``."""
    a, b = s1.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("c1")), target.select(F.col("entity_id").alias("target_id"), F.col("country").alias("c2"))
    t = truth.select("s1_id", "target_id").distinct()
    x = pairs.join(a, "s1_id", "left").join(b, "target_id", "left").join(t.withColumn("t", F.lit(1)), ["s1_id", "target_id"], "left")
    out = x.agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct(F.struct("s1_id", "target_id")).alias("distinct_pairs"), F.count(F.when(F.col("s1_id").isNull() | F.col("target_id").isNull(), 1)).alias("null_ids"), F.count(F.when(F.col("s1_id") == F.col("target_id"), 1)).alias("self_matches"),
        F.count(F.when(F.col("c1").isNull(), 1)).alias("unknown_s1"), F.count(F.when(F.col("c2").isNull(), 1)).alias("unknown_target"), F.count(F.when(F.col("c1") != F.col("c2"), 1)).alias("cross_country"), F.countDistinct(F.when(F.col("t") == 1, F.struct("s1_id", "target_id"))).alias("true_pairs"),
    )
    return out.crossJoin(t.agg(F.count(F.lit(1)).alias("truths"))).withColumn("recall", F.when(F.col("truths") > 0, F.col("true_pairs") / F.col("truths")))


def malformed(df: DataFrame, ident: str) -> DataFrame:
    dirty = F.col(ident).rlike(r"[\r\n]|^[ \t]+|[ \t]+$")
    return df.agg(F.count(F.when(~F.col(ident).rlike(r"^S[123]-[0-9]+\z"), 1)).alias("malformed"), F.count(F.when(dirty, 1)).alias("dirty_whitespace"))


def key_agreement(pairs: DataFrame, keys: dict) -> DataFrame:
    """``label`` and, for each key, the share of pairs that agree in it (non-empty on both sides)."""
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), *(F.avg(F.coalesce(((a != "") & (a == b)).cast("double"), F.lit(0.0))).alias(n) for n, (a, b) in keys.items()))


def missing_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.count(F.when(K.is_missing(c), 1)).alias(f"missing_{c}") for c in columns))
