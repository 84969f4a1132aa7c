"""Token counts: an exact length histogram and its suffix sums.

Every document is encoded once and only its length kept (the histogram is settled before it is
summed in two ways); documents are then aggregated by length,
and suffix sums over the histogram answer totals, quantiles and truncated totals for every context
limit at once. The histogram has a row for each distinct length, not for each document, and its
suffix sums are taken in blocks of BLOCK lengths, so no single task holds it all.

Defined results: a null or empty text has length 0; repeated rows count as often as they come; an
empty table gives an empty histogram and no totals.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import settle, small_batches
from .encode import DEFAULT_TOKENIZER, encoder

BLOCK = 1024


def token_lengths(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of each document."""
    small_batches(docs.sparkSession)

    def count(batches):
        enc = encoder(tokenizer)
        for b in batches:
            n = [len(enc.packed(t)) // 4 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, docs, docs_at_least, tokens_at_least, tokens_within, truncated_tokens``, a row for
    each distinct length L: documents and tokens of those of L or more, tokens of documents of at
    most L, and the tokens that remain when every document is cut at L."""
    hist = settle(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")))
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)  # one row a block: at most longest text / BLOCK
    total = W.partitionBy(F.lit(0))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"), F.sum("t").over(total).alias("all_t"))
    here = W.partitionBy("block").orderBy(F.desc("n_tokens"))
    at_least = hist.join(blocks, "block").select(
        "n_tokens", "docs", "all_t",
        (F.col("d") + F.sum("docs").over(here)).alias("docs_at_least"),
        (F.col("t") + F.sum(F.col("docs") * F.col("n_tokens")).over(here)).alias("tokens_at_least"),
    )
    below = F.col("all_t") - F.col("tokens_at_least")
    return at_least.select(
        "n_tokens", "docs", "docs_at_least", "tokens_at_least",
        (below + F.col("docs") * F.col("n_tokens")).alias("tokens_within"),
        (below + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
    )


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row ``n_tokens``: the smallest length within which at least a share q of documents lies."""
    total = histogram.agg(F.sum("docs").alias("total"))
    return histogram.crossJoin(F.broadcast(total)).where(F.col("total") - F.col("docs_at_least") + F.col("docs") >= F.col("total") * q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row ``tokens``: what remains when every document is cut at ``limit``."""
    return histogram.agg(F.sum(F.col("docs") * F.least("n_tokens", F.lit(limit))).alias("tokens"))
