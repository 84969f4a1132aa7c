"""Benchmark decontamination by pigeonhole edit matching.

An item of length m may differ from a passage by at most e = floor(m * RATE) edits. Cut into e + 1
pieces, one piece of it must occur unchanged in the passage. Pieces of all items are searched at
once (Aho-Corasick); each hit names where the item would lie, and Myers' bit-parallel algorithm
verifies the least edit distance of the item to any substring there. Items are a stated query set
against all documents: they are broadcast in blocks of at most BLOCK_CHARS, one block at a time, and
documents never move.

Texts are compared in lower case with each run of white space as one space. Defined results: null
and empty texts match nothing; an item without a word is skipped; repeated rows are matched like
any other; empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, share, small_batches

#: edits allowed for each character of an item
RATE = 0.05
#: characters of items broadcast at once
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def split_item(item: str, rate: float = RATE) -> tuple[int, list[tuple[int, str]]]:
    """Error budget e and e + 1 pieces as (offset, piece), as even as can be."""
    e = int(len(item) * rate)
    cut = [len(item) * i // (e + 1) for i in range(e + 2)]
    return e, [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def myers(pattern: str, text: str, limit: int, peq: dict[str, int] | None = None) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text`` (Myers 1999), or limit + 1."""
    m = len(pattern)
    if peq is None:
        peq = {}
        for i, c in enumerate(pattern):
            peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best = score
            if not best:
                break
    return best if best <= limit else limit + 1


class Matcher:
    """All items of a block, ready to search."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items, self.auto, self.peq = [], ahocorasick.Automaton(), []
        where: dict[str, list[tuple[int, int]]] = {}
        for ident, text in items:
            text = normal(text)
            if not text:
                continue
            e, pieces = split_item(text, rate)
            for at, piece in pieces:
                where.setdefault(piece, []).append((len(self.items), at))
            self.items.append((ident, text, e))
            self.peq.append(None)
        for piece, found in where.items():
            self.auto.add_word(piece, (len(piece), found))
        if where:
            self.auto.make_automaton()

    def search(self, text: str | None) -> dict[int, int]:
        """item id -> least distance, of the items within budget."""
        if not self.items or not text:
            return {}
        text = normal(text)
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (size, found) in self.auto.iter(text):
            for i, at in found:
                start = end + 1 - size - at
                e, m = self.items[i][2], len(self.items[i][1])
                spans.setdefault(i, []).append((max(0, start - e), start + m + e))
        out: dict[int, int] = {}
        for i, places in spans.items():
            ident, item, e = self.items[i]
            if self.peq[i] is None:
                table: dict[str, int] = {}
                for j, c in enumerate(item):
                    table[c] = table.get(c, 0) | 1 << j
                self.peq[i] = table
            best, done = e + 1, -1
            for lo, hi in sorted(set(places)):
                if hi <= done:
                    continue
                best, done = min(best, myers(item, text[lo:hi], e, self.peq[i])), hi
                if not best:
                    break
            if best <= e:
                out[ident] = min(best, out.get(ident, best))
        return out


def _blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items, a block of bounded size at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct().toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(spark: SparkSession, items: list[tuple[int, str]], rate: float):
    """An Arrow function text -> [(item_id, distance)] of a block of items, and its broadcast."""
    held = share(spark, items)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64())]))

    @F.arrow_udf("array<struct<item_id: long, distance: long>>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(held.value, rate)
        for b in batches:
            hits = (sorted(matcher.search(t).items(), key=str) for t in b.to_pylist())
            yield pa.array([[{"item_id": k, "distance": v} for k, v in h] for h in hits], kind)

    return search, held


def _each_block(docs: DataFrame, benchmark: DataFrame, rate: float, found) -> Iterator[DataFrame]:
    """``found(docs, search)`` for each block of items. All but the last are settled, so that their
    items leave the workers before the next block comes."""
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark)
    items = next(blocks, None)
    while items is not None:
        search, held = _search(docs.sparkSession, items, rate)
        out, items = found(search), next(blocks, None)
        if items is not None:
            out = settle(out)
            held.unpersist()
        yield out


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance``: every document that holds an item within its error budget."""

    def found(search):
        hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(search("text")).alias("kd"))
        return hits.select("doc_id", "kd.item_id", "kd.distance")

    parts = list(_each_block(docs, benchmark, rate, found))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance long")
    return functools.reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    cols, left = docs.columns, docs

    def found(search):
        return left.withColumn("__kindred", search("text")).where(F.size("__kindred") == 0).select(*cols)

    for left in _each_block(docs, benchmark, rate, found):
        pass
    return left
