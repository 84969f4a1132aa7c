"""Scoring and evaluation: pairs in, one aggregate per question out.

F0.5 of an entity with A true, P predicted and TP shared matches is 5 TP / (A + 4 P); with neither it
is 1, with predictions alone or truths alone 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def f05(a="a", p="p", tp="tp") -> Column:
    a, p, tp = F.col(a), F.col(p), F.col(tp)
    return F.when((a == 0) & (p == 0), 1.0).when(tp == 0, 0.0).otherwise(5.0 * tp / (a + 4.0 * p))


def entity_counts(universe: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """``s1_id, a, p, tp`` for every entity of the universe; pairs are ``(s1_id, target_id)``, as sets."""
    both = truth.select("s1_id", "target_id").distinct().withColumn("t", F.lit(1)).join(predicted.select("s1_id", "target_id").distinct().withColumn("q", F.lit(1)), ["s1_id", "target_id"], "full_outer")
    per = both.groupBy("s1_id").agg(F.count("t").alias("a"), F.count("q").alias("p"), F.count(F.when(F.col("t").isNotNull() & F.col("q").isNotNull(), 1)).alias("tp"))
    return universe.select("s1_id").distinct().join(per, "s1_id", "left").na.fill(0, ["a", "p", "tp"])


def score(counts: DataFrame) -> DataFrame:
    """One row: macro F0.5, micro precision, recall and F0.5, pooled counts, no-match decisions."""
    s = counts.withColumn("f", f05()).agg(
        F.count(F.lit(1)).alias("entities"), F.avg("f").alias("macro_f05"), F.sum("tp").alias("tp"), F.sum(F.col("p") - F.col("tp")).alias("fp"), F.sum(F.col("a") - F.col("tp")).alias("fn"),
        F.count(F.when((F.col("a") == 0) & (F.col("p") == 0), 1)).alias("correct_no_match"), F.count(F.when((F.col("a") > 0) & (F.col("p") == 0), 1)).alias("false_no_match"),
    )
    div = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return s.withColumns({"micro_precision": div(F.col("tp"), F.col("tp") + F.col("fp")), "micro_recall": div(F.col("tp"), F.col("tp") + F.col("fn")), "micro_f05": div(5.0 * F.col("tp"), 5.0 * F.col("tp") + 4.0 * F.col("fp") + F.col("fn"))})


def blocking_metrics(truth: DataFrame, pairs: DataFrame, n_s1: int | Column, n_target: int | Column) -> DataFrame:
    """Pair completeness, quality, reduction ratio, and entities with some or all truths found."""
    hit = truth.join(pairs.select("s1_id", "target_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "target_id"], "left")
    per = hit.groupBy("s1_id").agg(F.count(F.lit(1)).alias("a"), F.count("hit").alias("k"))
    t = per.agg(F.sum("a").alias("truths"), F.sum("k").alias("found"), F.avg((F.col("k") > 0).cast("double")).alias("any"), F.avg((F.col("k") == F.col("a")).cast("double")).alias("all"))
    c = pairs.agg(F.count(F.lit(1)).alias("candidates"))
    return t.crossJoin(c).select("truths", "found", "candidates", F.round(F.col("found") / F.col("truths"), 6).alias("pair_completeness"), F.round(F.col("found") / F.col("candidates"), 6).alias("pair_quality"), F.round(1 - F.col("candidates") / (F.lit(n_s1).cast("double") * F.lit(n_target)), 8).alias("reduction_ratio"), F.round("any", 4).alias("query_coverage"), F.round("all", 4).alias("full_query_coverage"))


def fanout(universe: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row about candidates an entity, entities without any included."""
    return fanout_of(universe, pairs.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")))


def fanout_of(universe: DataFrame, counts: DataFrame) -> DataFrame:
    """``fanout`` from the number ``n`` of candidates of each entity that has any."""
    n = universe.select("s1_id").join(counts, "s1_id", "left").na.fill(0, ["n"])
    q = F.percentile("n", F.array(*(F.lit(x) for x in (0.5, 0.9, 0.95, 0.99))))
    return n.agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("pairs"), F.avg("n").alias("mean"), q.alias("q"), F.max("n").alias("largest"), F.count(F.when(F.col("n") == 0, 1)).alias("empty"), F.count(F.when(F.col("n") >= 300, 1)).alias("ge300")).select("entities", "pairs", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p95"), F.col("q")[3].alias("p99"), "largest", "empty", "ge300")


def attribution(channels: DataFrame, truth: DataFrame, names: list[str]) -> DataFrame:
    """For each channel in order: pairs, true pairs, and those that no earlier channel had. A pair
    belongs to its lowest bit, so one pass replaces a chain of anti-joins."""
    marked = channels.join(truth.select("s1_id", "target_id").distinct().withColumn("t", F.lit(1)), ["s1_id", "target_id"], "left")
    first = marked.withColumn("first", F.col("channels").bitwiseAND(-F.col("channels")))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("channel"), F.lit(1 << i).cast("long").alias("bit"), F.lit(i).alias("step")) for i, n in enumerate(names))))
    x = first.withColumn("r", rows).where(F.col("channels").bitwiseAND(F.col("r.bit")) != 0)
    return x.groupBy(F.col("r.step").alias("step"), F.col("r.channel").alias("channel")).agg(F.count(F.lit(1)).alias("pairs"), F.count("t").alias("true_pairs"), F.count(F.when(F.col("first") == F.col("r.bit"), 1)).alias("new_pairs"), F.count(F.when(F.col("first") == F.col("r.bit"), F.col("t"))).alias("new_true_pairs"))


def ablation(attributed: DataFrame) -> DataFrame:
    """Volume and true pairs as channels are added one by one."""
    w = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)  # one row a channel
    return attributed.select("step", "channel", F.sum("new_pairs").over(w).alias("volume"), F.sum("new_true_pairs").over(w).alias("captured"))


def capture(a="a", k="k") -> Column:
    a, k = F.col(a), F.col(k)
    return F.when(a == 0, "NO_TRUTH").when(k == 0, "ZERO").when(k < a, "PARTIAL").otherwise("FULL")


def oracles(universe: DataFrame, truth: DataFrame, scored: DataFrame) -> DataFrame:
    """``s1_id, a, k, candidate_oracle, ranking_oracle``: the best F0.5 that the candidates allow, and that
    a cut of their ranking allows. ``scored`` has ``s1_id, target_id, score``."""
    hit = scored.join(truth.select("s1_id", "target_id").distinct().withColumn("t", F.lit(1)), ["s1_id", "target_id"], "left")
    w = W.partitionBy("s1_id").orderBy(F.desc_nulls_last("score"), F.asc("target_id"))
    ranked = hit.withColumn("rank", F.row_number().over(w)).where("t = 1").withColumn("j", F.row_number().over(w))
    a = truth.groupBy("s1_id").agg(F.countDistinct("target_id").alias("a"))
    best = ranked.join(a, "s1_id").groupBy("s1_id").agg(F.count(F.lit(1)).alias("k"), F.max(5.0 * F.col("j") / (F.col("a") + 4.0 * F.col("rank"))).alias("r"))
    out = universe.select("s1_id").distinct().join(a, "s1_id", "left").join(best, "s1_id", "left").na.fill(0, ["a", "k", "r"])
    return out.select("s1_id", "a", "k", F.when(F.col("a") == 0, 1.0).otherwise(5.0 * F.col("k") / (F.col("a") + 4.0 * F.col("k"))).alias("candidate_oracle"), F.when(F.col("a") == 0, 1.0).otherwise(F.col("r")).alias("ranking_oracle"))


def threshold_counts(universe: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """``s1_id, a`` and ``p_i, tp_i`` for each threshold, all in one pass over the scores."""
    hit = scored.join(truth.select("s1_id", "target_id").distinct().withColumn("t", F.lit(1)), ["s1_id", "target_id"], "left")
    aggs = [x for i, t in enumerate(thresholds) for x in (F.count(F.when(F.col("score") >= t, 1)).alias(f"p_{i}"), F.count(F.when(F.col("score") >= t, F.col("t"))).alias(f"tp_{i}"))]
    a = truth.groupBy("s1_id").agg(F.countDistinct("target_id").alias("a"))
    return universe.select("s1_id").distinct().join(a, "s1_id", "left").join(hit.groupBy("s1_id").agg(*aggs), "s1_id", "left").na.fill(0)


def sweep(counts: DataFrame, thresholds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each threshold (and group): entities, macro F0.5, precision, recall, non-empty rows."""
    s = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"p_{i}").alias("p"), F.col(f"tp_{i}").alias("tp")) for i, t in enumerate(thresholds))))
    x = counts.select(*by, "a", s.alias("s")).select(*by, "a", "s.*")
    return x.groupBy(*by, "threshold").agg(F.count(F.lit(1)).alias("entities"), F.sum(f05()).alias("f_sum"), F.avg(f05()).alias("macro_f05"), F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("a").alias("a"), F.count(F.when(F.col("p") > 0, 1)).alias("non_empty"))


def nested(swept: DataFrame) -> DataFrame:
    """``fold, threshold, macro_f05``: for each fold the threshold best on all other folds (the lower of
    equals), with its score on the fold itself. ``swept`` is a sweep by fold: folds x thresholds rows."""
    total = swept.groupBy("threshold").agg(F.sum("f_sum").alias("all_f"), F.sum("entities").alias("all_n"))
    rest = swept.join(total, "threshold").withColumn("rest", F.round((F.col("all_f") - F.col("f_sum")) / (F.col("all_n") - F.col("entities")), 12))
    best = rest.withColumn("r", F.row_number().over(W.partitionBy("fold").orderBy(F.desc("rest"), F.asc("threshold")))).where("r = 1")
    return best.select("fold", "threshold", "entities", "macro_f05")


def margin_counts(scored: DataFrame, threshold: float, delta: float) -> DataFrame:
    """Pairs at or above a threshold and within ``delta`` of their entity's best score."""
    return scored.withColumn("gap", F.max("score").over(W.partitionBy("s1_id")) - F.col("score")).where((F.col("score") >= threshold) & (F.col("gap") <= delta))


def loss(oracle: DataFrame, macro: float | Column) -> DataFrame:
    """What is lost in blocking, in ranking and in the decision."""
    o = oracle.agg(F.avg("candidate_oracle").alias("c"), F.avg("ranking_oracle").alias("r"))
    return o.select((1 - F.col("c")).alias("blocking_loss"), (F.col("c") - F.col("r")).alias("ranking_loss"), (F.col("r") - F.lit(macro)).alias("decision_loss"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.avg("label").alias("rate"), F.avg("score").alias("mean_score"))


def calibration_of(histogram: DataFrame, bins: int = 10) -> DataFrame:
    """``calibration`` from ``score, n, positives``: a row for each distinct score."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    scored = F.sum(F.when(F.col("score").isNotNull(), F.col("n")))
    return histogram.groupBy(b.alias("bucket")).agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"), (F.sum("positives") / F.sum("n")).alias("rate"), (F.sum(F.col("score") * F.col("n")) / scored).alias("mean_score"))


def entity_counts_of(universe: DataFrame, truths: DataFrame, predicted: DataFrame) -> DataFrame:
    """``entity_counts`` from the number ``a`` of truths and ``p, tp`` of predictions of each entity that has any."""
    return universe.select("s1_id").distinct().join(truths.select("s1_id", "a"), "s1_id", "left").join(predicted.select("s1_id", "p", "tp"), "s1_id", "left").na.fill(0, ["a", "p", "tp"])


def confusion(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    t = F.explode(F.array(*map(F.lit, map(float, thresholds))))
    c = scored.select("score", "label", t.alias("threshold")).groupBy("threshold").agg(*(F.count(F.when((F.col("score") >= F.col("threshold")) == hit, F.when(F.col("label") == y, 1))).alias(n) for n, hit, y in (("tp", True, 1), ("fp", True, 0), ("fn", False, 1), ("tn", False, 0))))
    div = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return c.withColumns({"precision": div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": div(F.col("tp"), F.col("tp") + F.col("fn")), "f1": div(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), "f05": div(1.25 * F.col("tp"), 1.25 * F.col("tp") + F.col("fp") + 0.25 * F.col("fn"))})


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: the sum over distinct scores of precision times the recall gained there. Scores are
    aggregated first; cumulative sums run over distinct scores."""
    s = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    w = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    c = s.select("y", F.sum("n").over(w).alias("cn"), F.sum("y").over(w).alias("cy"), F.sum("y").over(W.partitionBy(F.lit(0))).alias("total"))
    return c.agg(F.sum(F.col("y") / F.col("total") * F.col("cy") / F.col("cn")).alias("average_precision"))


def parity(a: DataFrame, b: DataFrame, columns: list[str], shift: float = 25.0) -> DataFrame:
    """A row for each column: mean, median and 90th percentile in both tables, and whether the mean
    moved by more than ``shift`` per cent."""
    def profile(df: DataFrame, p: str) -> DataFrame:
        long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
        return long.groupBy("feature").agg(F.avg("v").alias(f"{p}_mean"), F.percentile("v", F.lit(0.5)).alias(f"{p}_p50"), F.percentile("v", F.lit(0.9)).alias(f"{p}_p90"))

    x = profile(a, "a").join(profile(b, "b"), "feature")
    d = F.when(F.col("a_mean") != 0, (F.col("b_mean") - F.col("a_mean")) / F.abs("a_mean") * 100)
    return x.withColumn("delta_pct", d).withColumn("shifted", F.coalesce(F.abs("delta_pct") > shift, F.lit(False)))


def score_difference(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    x = a.select("s1_id", "target_id", F.col("score").alias("x")).join(b.select("s1_id", "target_id", F.col("score").alias("y")), ["s1_id", "target_id"])
    return x.agg(F.count(F.lit(1)).alias("pairs"), F.max(F.abs(F.col("x") - F.col("y"))).alias("largest"), F.percentile(F.abs(F.col("x") - F.col("y")), F.lit(0.5)).alias("median"), F.count(F.when((F.col("x") >= threshold) != (F.col("y") >= threshold), 1)).alias("flips"))


def slices(counts: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """A row for each named slice of ``counts(a, p, tp)``: entities, macro F0.5, least and greatest F,
    truths and predictions. Rows are spread over their slices once, so one aggregate answers all."""
    of = F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())), lambda x: x.isNotNull()))
    x = counts.withColumn("f", f05()).withColumn("slice", of)
    return x.groupBy("slice").agg(
        F.count(F.lit(1)).alias("entities"), F.avg("f").alias("macro_f05"), F.min("f").alias("least"), F.max("f").alias("greatest"),
        F.sum("a").alias("truths"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"),
    )


def missed_pairs(truth: DataFrame, pairs: DataFrame, s1: DataFrame, target: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` true pairs, by id, that no candidate covers, with names and addresses of both."""
    gone = truth.select("s1_id", "target_id").distinct().join(pairs, ["s1_id", "target_id"], "left_anti").orderBy("s1_id", "target_id").limit(most)
    side = lambda df, i, p: df.select(F.col("entity_id").alias(i), F.col("name").alias(f"{p}_name"), F.col("address").alias(f"{p}_address"))
    return gone.join(side(s1, "s1_id", "s1"), "s1_id", "left").join(side(target, "target_id", "tgt"), "target_id", "left")


def labelled_sample(labelled: DataFrame, positives: int, negatives: int) -> DataFrame:
    """So many pairs of either label, those with the smallest hash of both ids."""
    x = labelled.withColumn("kd_h", F.sha2(F.concat_ws("|", "s1_id", "target_id"), 256))
    # each task keeps its own first few; no pair is sorted or moved beyond those
    first = lambda y, n: x.where(F.col("label") == y).orderBy("kd_h").limit(n).drop("kd_h")
    return first(1, positives).unionByName(first(0, negatives))


def margin_grid(universe: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: list[float], margins: list[float]) -> DataFrame:
    """``threshold, margin`` and macro F0.5 of predicting what reaches the threshold and lies within
    the margin of its record's best: the best is a window, each pair is dealt to the settings it meets."""
    t = truth.select("s1_id", "target_id").distinct()
    a = t.groupBy("s1_id").agg(F.count(F.lit(1)).alias("a"))
    grid = F.explode(F.array(*(F.struct(F.lit(x).alias("threshold"), F.lit(y).alias("margin")) for x in thresholds for y in margins))).alias("g")
    x = scored.withColumn("gap", F.round(F.max("score").over(W.partitionBy("s1_id")) - F.col("score"), 9)).join(t.withColumn("t", F.lit(1)), ["s1_id", "target_id"], "left")
    met = x.select("s1_id", "score", "gap", "t", grid).where("score >= g.threshold and gap <= g.margin").groupBy("s1_id", "g").agg(F.count(F.lit(1)).alias("p"), F.count("t").alias("tp"))
    every = universe.select("s1_id").distinct().join(a, "s1_id", "left").select("s1_id", "a", grid)
    rows = every.join(met, ["s1_id", "g"], "left").na.fill(0, ["a", "p", "tp"]).withColumn("f", f05())
    return rows.groupBy("g.threshold", "g.margin").agg(F.avg("f").alias("macro_f05"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))


def margin_grid_of(universe: DataFrame, truths: DataFrame, counts: DataFrame, cells: list[tuple[float, float]]) -> DataFrame:
    """``margin_grid`` from the truths ``a`` of each entity and its ``p_i, tp_i`` in each cell ``(threshold, margin)``."""
    every = universe.select("s1_id").distinct().join(truths.select("s1_id", "a"), "s1_id", "left").join(counts, "s1_id", "left").na.fill(0)
    cell = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(m).alias("margin"), F.col(f"p_{i}").alias("p"), F.col(f"tp_{i}").alias("tp")) for i, (t, m) in enumerate(cells))))
    x = every.select("a", cell.alias("g")).select("a", "g.*").withColumn("f", f05())
    return x.groupBy("threshold", "margin").agg(F.avg("f").alias("macro_f05"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
