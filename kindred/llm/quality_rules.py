"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit a
rule. A policy is a version name with a mask of the bits that reject: verdicts under any policy,
and how many documents each rule alone rejects (an ablation), are bitwise arithmetic over the
ledger, without reading a text again.

Defined results: a null or text without words has all measurements 0 and fails ``few_words``;
rows are independent, so repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, windows, word_hashes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: name -> the condition under which a document fails; the position is the bit. All in integers.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_words": "n_words > 100000",
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines > 3 AND 20 * n_dup_lines > n_words",
}

#: policy version -> the rules that reject
POLICIES = {
    "v1": ("few_words", "repeated_windows", "many_words", "short_mean_word", "long_mean_word", "symbols", "duplicate_lines"),
    "base": ("few_words", "repeated_windows"),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WINDOW = 5


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def _measure(text: str | None) -> tuple[int, int, int, int, int]:
    raw = (text or "").encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols = int(seen[_SYMBOL].sum())
    words = word_hashes(raw)
    n = len(words)
    if not n:
        return 0, 0, symbols, 0, 0
    # code points: every byte that does not continue one, without white space
    chars = int(seen.sum() - seen[0x80:0xC0].sum() - seen[0x20] - seen[0x09:0x0E].sum())
    dup = 0
    if seen[10]:
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        dup = len(lines) - len(set(lines))
    repeat = 0
    if n > _WINDOW:
        h = windows(words, _WINDOW)
        s = np.sort(h)
        again = s[1:][s[1:] == s[:-1]]
        if len(again):
            at = np.flatnonzero(np.isin(h, again))
            edge = np.zeros(n + 1, np.int64)
            edge[at] += 1
            edge[at + _WINDOW] -= 1
            repeat = int((np.cumsum(edge[:n]) > 0).sum())
    return n, chars, symbols, dup, repeat


def _measures():
    """An Arrow function text -> measurements; the other columns stay in the JVM."""
    kind = pa.struct([(m, pa.int64()) for m in MEASURES])

    @F.arrow_udf("struct<" + ", ".join(f"{m}: long" for m in MEASURES) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = [_measure(t) for t in b.to_pylist()]
            cols = list(zip(*rows)) or [()] * len(MEASURES)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(kind))

    return run


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements, a pass over whole texts."""
    small_batches(docs.sparkSession)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _measures()("text").alias("kd"))
    return got.select("doc_id", *(F.col(f"kd.{m}").alias(m) for m in MEASURES))


def _failed() -> Column:
    """The mask of failed rules, from the measurements."""
    bits = (F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, cond in enumerate(RULES.values()))
    return sum(bits, F.lit(0)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, measurements and ``failed``, the mask of failed rules."""
    return measure(docs).withColumn("failed", _failed())


def verdict(led: DataFrame, policy: str = "v1") -> DataFrame:
    """``led`` with ``base_failed`` and ``kept`` under a policy."""
    return led.withColumn("base_failed", F.col("failed").bitwiseAND(mask("base")) != 0).withColumn("kept", F.col("failed").bitwiseAND(mask(policy) | mask("base")) == 0)


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """A row for each rule of the policy: documents that fail it, and those only it rejects."""
    m = mask(policy)
    hit = led.select(F.col("failed").bitwiseAND(m).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))  # at most 2^rules rows
    names = list(RULES)
    spread = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy])))
    return hit.select("f", "n", spread.alias("r")).groupBy("r.rule").agg(
        F.coalesce(F.sum(F.when(F.col("f").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("f") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
    )


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """``docs`` without the documents that the policy rejects, other columns as they were: the
    ledger's bits are read beside the document, which moves nowhere."""
    small_batches(docs.sparkSession)
    whole = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("kd_doc"), F.col("text").alias("kd_text"))
    rows = whole.select("kd_doc", _measures()("kd_text").alias("kd")).select("kd_doc", "kd.*").withColumn("failed", _failed())
    return verdict(rows, policy).where("kept").select("kd_doc.*")
