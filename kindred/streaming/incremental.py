"""Incremental linkage, an extension of this engine: records that arrive are blocked against a fixed
target table as a stream-static equi-join. The batch operators above need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.blocking import RULES, _keyed


def link_stream(arriving: DataFrame, target: DataFrame, rule: str = "E") -> DataFrame:
    """Pairs of each micro-batch; append mode, no state, so a restart from its checkpoint repeats nothing."""
    r = RULES[rule]
    on = [f"k{i}" for i in range(len(r.keys))]
    return _keyed(arriving, r, "s1_id").join(_keyed(target, r, "target_id"), on).where("s1_id <> target_id").select("s1_id", "target_id")
