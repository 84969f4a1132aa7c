"""Decision rules over ``s1_id, target_id, source, score``. Order matters (a cap before or after
exclusivity gives other rows), so each step is its own function."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

def _best():
    return F.desc_nulls_last("score"), F.asc("target_id")


def top(pairs: DataFrame, k: int, *extra: str) -> DataFrame:
    """The k best of each entity (and of each of its ``extra`` groups)."""
    return pairs.withColumn("kd_r", F.row_number().over(W.partitionBy("s1_id", *extra).orderBy(*_best()))).where(F.col("kd_r") <= k).drop("kd_r")


def exclusive(pairs: DataFrame) -> DataFrame:
    """Each target to the entity that scores it best; equal scores go to the smaller id."""
    return pairs.withColumn("kd_r", F.row_number().over(W.partitionBy("target_id").orderBy(F.desc_nulls_last("score"), F.asc("s1_id")))).where("kd_r = 1").drop("kd_r")


def tied_claims(pairs: DataFrame) -> DataFrame:
    """Targets whose best score several entities share."""
    r = F.dense_rank().over(W.partitionBy("target_id").orderBy(F.desc_nulls_last("score")))
    return pairs.withColumn("r", r).where("r = 1 and score is not null").groupBy("target_id").agg(F.count(F.lit(1)).alias("claims"), F.max("score").alias("score")).where("claims > 1")


def resolve_claims(pairs: DataFrame) -> DataFrame:
    """Targets of one claim stay; of several claims without any score all stay, else the best one.
    ``position`` breaks ties of scores, then the id."""
    w = W.partitionBy("target_id")
    x = pairs.withColumns({"kd_n": F.size(F.collect_set("s1_id").over(w)), "kd_s": F.count("score").over(w), "kd_r": F.row_number().over(w.orderBy(F.desc_nulls_last("score"), F.asc("position"), F.asc("s1_id")))})
    return x.where("kd_n = 1 or kd_s = 0 or kd_r = 1").drop("kd_n", "kd_s", "kd_r")


def fill_empty(universe: DataFrame, chosen: DataFrame, scored: DataFrame, least: float) -> DataFrame:
    """For entities without a choice: targets not in use, scored ``least`` or more, the best of each source."""
    free = scored.where(F.col("score") >= least).join(universe.select("s1_id").join(chosen, "s1_id", "left_anti"), "s1_id", "left_semi")
    return top(free.join(chosen.select("target_id").distinct(), "target_id", "left_anti"), 1, "source")


def add_exclusive(chosen: DataFrame, scored: DataFrame, pool: float, least: float, most: int) -> DataFrame:
    """For entities with a choice: new targets of the pool, each to its best entity, then the best few."""
    new = scored.where(F.col("score") >= pool).join(chosen.select("target_id").distinct(), "target_id", "left_anti").join(chosen.select("s1_id").distinct(), "s1_id", "left_semi")
    return top(exclusive(new).where(F.col("score") >= least), most)


def prune(pairs: DataFrame, least: float) -> DataFrame:
    """Scored below ``least`` goes; unscored stays."""
    return pairs.where(F.col("score").isNull() | (F.col("score") >= least))


def ranked(pairs: DataFrame, most: int = 20) -> DataFrame:
    """One row a pair (its best score), the best ``most`` of an entity, with ``rank`` from 0 and ``smax``."""
    one = pairs.groupBy("s1_id", "target_id").agg(F.max("score").alias("score"), F.first("source").alias("source"))
    w = W.partitionBy("s1_id").orderBy(*_best())
    x = one.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < most)
    return x.withColumn("smax", F.max("score").over(W.partitionBy("s1_id")))


def rule_thresholds(r: DataFrame, t2: float, t3: float, t_row: float = 0.0, relative: float = 0.0, k: int = 0, only_one: bool = False) -> DataFrame:
    """A threshold for each source, a gate on the entity's best, a cut relative to it; the best itself
    passes its source's threshold. Then the cap, then exclusivity."""
    ok = F.col("score") >= F.when(F.col("source") == "S2", t2).otherwise(t3)
    ok = ok & (F.col("score") >= relative * F.col("smax"))
    x = r.where((F.col("smax") >= t_row) & ((F.col("rank") == 0) | ok))
    x = top(x, k) if k else x
    return exclusive(x) if only_one else x


def rule_expected(r: DataFrame, lam: float = 1.0, missing: float = 0.0, k: int = 0, only_one: bool = False) -> DataFrame:
    """The prefix of an entity's ranking with the greatest expected F0.5, if that beats ``lam`` times the
    chance that it has no match. ``r`` has calibrated ``prob``; running sums give all prefixes at once."""
    w = W.partitionBy("s1_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    g = W.partitionBy("s1_id")
    p = F.greatest(F.least(F.col("prob"), F.lit(1 - 1e-6)), F.lit(1e-6))
    x = r.withColumn("q", p).withColumns({"sk": F.sum("q").over(w), "sp": F.sum("q").over(g), "p0": F.exp(F.sum(F.log1p(-F.col("q"))).over(g) - missing)})
    truths = (F.col("sp") + missing) / F.greatest(1 - F.col("p0"), F.lit(1e-9))
    x = x.withColumn("e", 1.25 * F.col("sk") / (0.25 * truths + F.col("rank") + 1))
    x = x.withColumn("best", F.max("e").over(g)).withColumn("cut", F.min(F.when(F.col("e") >= F.col("best"), F.col("rank"))).over(g))
    x = x.where((F.col("best") > lam * F.col("p0")) & (F.col("rank") <= F.col("cut"))).drop("q", "sk", "sp", "p0", "e", "best", "cut")
    x = top(x, k) if k else x
    return exclusive(x) if only_one else x


def submission(universe: DataFrame, chosen: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row for every entity: its targets as a comma list, best first, empty when it has none."""
    listed = chosen.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("score", F.lit(-1e9))).alias("o"), F.col("target_id").alias("t")))), lambda x: x["t"]), ",").alias(name))
    return universe.select("s1_id").distinct().join(listed, "s1_id", "left").select("s1_id", F.coalesce(name, F.lit("")).alias(name))


def submission_of(universe: DataFrame, parts: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """``submission`` from ``s1_id, part``: sorted lists of ``(o, t)``, score times -1 and target."""
    whole = F.array_sort(F.flatten(F.collect_list("part")))
    listed = parts.groupBy("s1_id").agg(F.array_join(F.transform(whole, lambda x: x["t"]), ",").alias(name))
    return universe.select("s1_id").distinct().join(listed, "s1_id", "left").select("s1_id", F.coalesce(name, F.lit("")).alias(name))


def validate(sub: DataFrame, universe: DataFrame, targets: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """``check, failures``: named checks of a submission."""
    ids = sub.select("s1_id", F.explode(F.split(name, ",")).alias("t")).where("t <> ''")
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(c).alias("check"), "failures")
    known = targets.select(F.col("entity_id").alias("t")).distinct()
    checks = [
        n(sub.groupBy("s1_id").count().where("count > 1"), "duplicate_rows"), n(sub.where("s1_id is null"), "null_ids"), n(universe.select("s1_id").join(sub, "s1_id", "left_anti"), "missing_rows"),
        n(sub.join(universe.select("s1_id"), "s1_id", "left_anti"), "unknown_rows"), n(ids.groupBy("s1_id", "t").count().where("count > 1"), "duplicate_matches"), n(ids.where(~F.col("t").rlike(r"^S[23]-[0-9]+\z")), "malformed_ids"), n(ids.join(known, "t", "left_anti"), "unknown_targets"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
