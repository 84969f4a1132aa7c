"""Candidate generation: blocking rules as data, each an equi-join on derived keys.

A rule names the keys, the guards on them, a residual test after the join and a cap on what one
record may gather. Rules are joined one by one and united: an OR of rules as one join condition
would be a nested loop.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import normal as N
from ..functions import similarity as S

KEYS: dict[str, Callable[[], Column]] = {
    "country": lambda: F.col("country"), "prefix2": lambda: F.substring(K.clean("name"), 1, 2), "prefix3": lambda: K.prefix("name", 3), "prefix4": lambda: K.prefix("name", 4),
    "token1": lambda: K.first_token("name"), "root": lambda: K.root_token("name"), "house": lambda: K.house("address"), "house_norm": lambda: K.house_norm("address"),
    "name": lambda: F.trim("name"), "addr": lambda: F.trim("address"), "clean_name": lambda: K.clean("name"), "clean_addr": lambda: K.clean("address"),
    "core": lambda: K.core_name("name"), "zip": lambda: K.postal_code("address"), "addr10": lambda: F.substring(K.clean("address"), 1, 10), "cprefix3": lambda: F.substring(K.clean("name"), 1, 3),
    "translit_name": lambda: K.clean(N.transliterate_devanagari("name")), "translit4": lambda: F.substring(K.clean(N.transliterate_devanagari("name")), 1, 4),
    "no_suffix": lambda: K.name_no_suffix("name"), "raw_name": lambda: F.col("name"), "raw_addr": lambda: F.col("address"),
}


@dataclass(frozen=True)
class Rule:
    """``keys`` must be equal and not empty; ``least`` gives smallest lengths; ``similar`` a least
    Jaro-Winkler similarity of clean names; ``cap`` drops S1 records with more candidates; ``cluster``
    drops keys that more targets share."""

    name: str
    keys: tuple[str, ...]
    least: tuple[tuple[str, int], ...] = ()
    similar: float | None = None
    cap: int | None = None
    cluster: int | None = None


RULES = {r.name: r for r in (
    Rule("A", ("country", "prefix4", "house")),
    Rule("B", ("country", "addr")),
    Rule("C", ("country", "token1", "house")),
    Rule("D", ("country", "name")),
    Rule("E", ("country", "clean_name"), (("clean_name", 3),)),
    Rule("F1", ("country", "prefix4", "house_norm")),
    Rule("F2", ("country", "token1", "house_norm")),
    Rule("G", ("country", "root", "house_norm"), (("root", 3),)),
    Rule("H", ("country", "clean_addr"), (("clean_addr", 6),)),
    Rule("I", ("country", "zip", "prefix3"), (("zip", 5), ("prefix3", 3))),
    Rule("EXP1", ("country", "core"), (("core", 5),), cap=100),
    Rule("EXP2", ("country", "house_norm", "prefix2"), (), similar=0.80, cap=50),
    Rule("EXP4a", ("country", "addr10", "cprefix3"), (("addr10", 10), ("cprefix3", 3))),
    Rule("EXP4b", ("country", "zip", "root"), (("zip", 5), ("root", 4))),
    Rule("E1_no_suffix", ("country", "no_suffix"), cluster=5),
    Rule("E2_name5", ("country", "translit_name"), cluster=5),
    Rule("E2_name10", ("country", "translit_name"), cluster=10),
    Rule("E1_pin_house", ("country", "zip", "house")),
    Rule("E1_raw_name", ("country", "raw_name"), (("raw_name", 6),)),
    Rule("E1_raw_addr", ("country", "raw_addr"), (("raw_addr", 12),)),
    Rule("E1_pin_token", ("country", "zip", "token1"), (("token1", 4),)),
)}


def _keyed(df: DataFrame, rule: Rule, ident: str) -> DataFrame:
    cols = [KEYS[k]().alias(f"k{i}") for i, k in enumerate(rule.keys)]
    extra = [K.clean("name").alias(f"{ident}_clean")] if rule.similar is not None else []
    out = df.select(F.col("entity_id").alias(ident), *cols, *extra)
    least = dict(rule.least)
    for i, k in enumerate(rule.keys):
        out = out.where(F.length(f"k{i}") >= least[k] if k in least else F.col(f"k{i}") != "")
    return out


def candidates(s1: DataFrame, target: DataFrame, rule: Rule) -> DataFrame:
    """Distinct ``s1_id, target_id`` of one rule; ``s1`` and ``target`` have ``entity_id, name, address,
    country``."""
    on = [f"k{i}" for i in range(len(rule.keys))]
    left, right = _keyed(s1, rule, "s1_id"), _keyed(target, rule, "target_id")
    if rule.cluster is not None:
        right = right.join(right.groupBy(*on).count().where(F.col("count") <= rule.cluster).drop("count"), on)
    pairs = left.join(right, on).where("s1_id <> target_id")
    if rule.similar is not None:
        pairs = pairs.where(S.jaro_winkler("s1_id_clean", "target_id_clean") >= rule.similar)
    pairs = pairs.select("s1_id", "target_id").distinct()
    return cap_fanout(pairs, rule.cap) if rule.cap is not None else pairs


def cap_fanout(pairs: DataFrame, cap: int, by: str = "s1_id") -> DataFrame:
    """Pairs of records that have at most ``cap`` of them; others lose all of theirs."""
    return pairs.withColumn("kd_n", F.count(F.lit(1)).over(W.partitionBy(by))).where(F.col("kd_n") <= cap).drop("kd_n")


def union_rules(s1: DataFrame, target: DataFrame, names: Iterable[str]) -> DataFrame:
    """Distinct pairs of any of the rules."""
    return functools.reduce(DataFrame.unionByName, (candidates(s1, target, RULES[n]) for n in names)).distinct()


def provenance(s1: DataFrame, target: DataFrame, names: list[str]) -> DataFrame:
    """``s1_id, target_id, channels``: a bit for each rule that finds the pair."""
    each = (candidates(s1, target, RULES[n]).withColumn("bit", F.lit(1 << i).cast("long")) for i, n in enumerate(names))
    return functools.reduce(DataFrame.unionByName, each).groupBy("s1_id", "target_id").agg(F.bit_or("bit").alias("channels"))


def siblings(found: DataFrame, targets: DataFrame, key: Column, least: int, cluster: int | None = None) -> DataFrame:
    """Targets of the other source that share a key with a target already found."""
    t = targets.select(F.col("entity_id"), F.col("source"), "country", key.alias("k")).where(F.length("k") >= least)
    other = t.select(F.col("entity_id").alias("other_id"), F.col("source").alias("other_source"), "country", "k")
    if cluster is not None:
        other = other.join(other.groupBy("country", "k").count().where(F.col("count") <= cluster).drop("count"), ["country", "k"])
    seen = found.join(t.withColumnRenamed("entity_id", "target_id"), "target_id")
    return seen.join(other, ["country", "k"]).where("source <> other_source").select("s1_id", F.col("other_id").alias("target_id")).distinct()


def standard_blocks(s1: DataFrame, target: DataFrame, mode: str, most: int = 1000) -> DataFrame:
    """Pairs of equal standard keys, without keys that more than ``most`` targets share."""
    key = lambda df, i: df.select(F.col("entity_id").alias(i), K.standard_key("name", "country", mode).alias("block_key")).where("block_key is not null")
    right = key(target, "target_id")
    fine = right.groupBy("block_key").count().where(F.col("count") <= most).drop("count")
    return key(s1, "s1_id").join(right.join(fine, "block_key"), "block_key").where("s1_id <> target_id").select("s1_id", "target_id", "block_key")


def block_statistics(df: DataFrame, key: str) -> DataFrame:
    """One row about the blocks of a key: how many, rows, largest, mean, median, pairs."""
    n = df.where((F.col(key).isNotNull()) & (F.col(key) != "")).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("rows"), F.max("n").alias("largest"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("pairs"))


def random_pairs(a: DataFrame, b: DataFrame, modulo: int = 100, keep: int = 1000) -> DataFrame:
    """Pairs at random for negatives: of the ``keep`` first records of either side by hash, the pairs
    whose hashes agree modulo ``modulo``. An equi-join finds them, not a product of both samples."""
    bucket = F.pmod(F.conv(F.substring(F.sha2("entity_id", 256), 17, 8), 16, 10).cast("bigint"), F.lit(modulo))
    some = lambda df, i: df.orderBy(F.sha2("entity_id", 256)).limit(keep).select(F.col("entity_id").alias(i), bucket.alias("r"))
    return some(a, "s1_id").join(some(b, "target_id"), "r").drop("r")


def transliterated(s1: DataFrame, target: DataFrame, country: str = "India", similar: float = 0.80, cap: int = 50) -> DataFrame:
    """Equal house number and first two letters of the transliterated name, names alike; united, for
    one country, with equal house number and postal code. Two equi-joins, then one cap."""

    def side(df: DataFrame, ident: str) -> DataFrame:
        name = K.clean(N.transliterate_devanagari("name"))
        out = df.select(F.col("entity_id").alias(ident), "country", K.house_norm("address").alias("house"), K.postal_code("address").alias("postal"), name.alias(f"{ident}_n"))
        return out.where("house <> ''").withColumn("start", F.substring(f"{ident}_n", 1, 2))

    left, right = side(s1, "s1_id"), side(target, "target_id")
    named = left.where("start <> ''").drop("postal").join(right.drop("postal"), ["country", "house", "start"])
    named = named.where(S.jaro_winkler("s1_id_n", "target_id_n") >= similar).select("s1_id", "target_id")
    placed = left.where((F.col("country") == country) & (F.col("postal") != "")).join(right, ["country", "house", "postal"])
    return cap_fanout(named.unionByName(placed.select("s1_id", "target_id")).distinct(), cap)


def shared_address_tokens(s1: DataFrame, target: DataFrame, least: int = 2) -> DataFrame:
    """Equal first four letters of the transliterated name and at least so many address words in common."""
    side = lambda df, i: df.select(F.col("entity_id").alias(i), "country", KEYS["translit4"]().alias("k"), F.split("address", " ").alias(f"{i}_w")).where("k <> ''")
    pairs = side(s1, "s1_id").join(side(target, "target_id"), ["country", "k"])
    return pairs.where(F.size(F.array_intersect("s1_id_w", "target_id_w")) >= least).select("s1_id", "target_id")
