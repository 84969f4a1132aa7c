"""Quality by an interpolated modified Kneser-Ney model over the code points of trusted text.

Trusted text (``labels.quality = 1``) is counted in ORDER-grams of code points as they stand, of any
script, so the count tables grow with the corpus. Lower orders, contexts and discounts come from
equi-joins of count tables sharded by n-gram. Documents are packed into blocks of up to BLOCK code
points; a block asks for each of its distinct n-grams once, the n-grams that any block asks for meet
the count tables order by order, and the answers go back to the blocks, where whole texts are scored.
Nothing is collected but counts of counts (ten numbers an order), nothing broadcast but two bit filters
of ids, whose size is fixed.

No document is scored by counts of its own text: documents fall into two halves by crc32 of doc_id,
and each half is scored by the trusted text of the other. So the threshold of a language, a quantile
of the perplexity of its trusted documents, holds for documents that nobody labelled.

Defined results: null and empty texts have no bits and are not kept; a null language is one of its
own; a language without trusted text takes the threshold of all; without any trusted text all
texts with a character are kept; a null doc_id is in the first half; a half whose other half has no
trusted text has uniform bits; rows are independent, repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import SIFT_BITS, bit_table, settle, share, sift, small_batches

ORDER = 4
QUANTILE = 0.995
#: bits are whole thousandths
UNIT = 1000
#: code points of a block of documents, of a run of them held as text, and of what is numbered at once (a longer text is a run of its own)
BLOCK = 1 << 24
RUN = 1 << 20
PIECE = 1 << 18
#: largest table by which numbers are ranked without sorting them
TABLE = 1 << 21
#: n-grams that a counting task holds before it hands them on
HELD = 1 << 20
#: stands ORDER - 1 times before each text
START = "\x02"


def half() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(2)).cast("int")


def pieces(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams that end at each code point of the texts, by pieces of about PIECE code points:
    distinct n-grams, the number of each in order of place, the texts and where each begins there."""
    pad = np.full(ORDER - 1, ord(START), "<u4")
    held, owner, size = [], [], 0
    for i, t in enumerate(texts):
        c = np.concatenate([pad, np.frombuffer(t.encode("utf-32-le", "replace"), "<u4")])
        for at in range(0, len(c) - ORDER + 1, PIECE):
            held.append(c[at : at + PIECE + ORDER - 1])
            owner.append(i)
            size += len(held[-1])
            if size >= PIECE:
                yield _numbered(held, owner)
                held, owner, size = [], [], 0
    if held:
        yield _numbered(held, owner)


def _ranks(code: np.ndarray, bound: int) -> tuple[np.ndarray, int]:
    """Numbers below ``bound`` by their rank among those that occur, and how many occur."""
    if bound > TABLE:
        seen, rank = np.unique(code, return_inverse=True)
        return rank, len(seen)
    there = np.zeros(bound, bool)
    there[code] = True
    rank = np.cumsum(there, dtype=np.int32) - 1
    return rank[code].astype(np.int64), int(rank[-1]) + 1


def _numbered(held: list[np.ndarray], owner: list[int]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    c = np.concatenate(held)
    sizes = np.array([len(h) for h in held])
    letter, letters = _ranks(c, int(c.max()) + 1)
    n = len(c) - ORDER + 1
    code, many = letter[:n], letters
    for j in range(1, ORDER):
        code, many = _ranks(code * letters + letter[j : j + n], many * letters)
    inside = np.ones(n, bool)
    for back in range(1, ORDER):  # n-grams across two texts
        inside[np.cumsum(sizes)[:-1] - back] = False
    place = np.flatnonzero(inside)
    number, many = _ranks(code[place], many)
    of = np.empty(many, np.int64)
    of[number] = place  # any place of each will do
    flat = c[of[:, None] + np.arange(ORDER)].astype("<u4").tobytes().decode("utf-32-le")
    begins = np.cumsum(sizes - ORDER + 1) - (sizes - ORDER + 1)
    return [flat[i : i + ORDER] for i in range(0, len(flat), ORDER)], number, np.array(owner), begins


def joined_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``m, g, n``: n-grams over the documents of ``trusted(doc_id)``, m the half they score (the one
    they are not in). Texts that may be trusted travel compressed to the join, the others not at all."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def squeeze(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.array([z.compress((t or "").encode()) for t in b.to_pylist()], pa.binary())

    def count(batches):
        z = zstandard.ZstdDecompressor()
        total = ({}, {})

        def hand_on(m):
            t = total[m]
            keys, values = list(t), list(t.values())
            t.clear()
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(part), pa.int32()), pa.array(part), pa.array(values[i : i + 50_000], pa.int64())], names=["m", "g", "n"])

        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for m in (0, 1):
                t = total[m]
                for grams, number, _, _ in pieces([z.decompress(x).decode() for h, x in rows if h == 1 - m]):
                    for g, n in zip(grams, np.bincount(number).tolist()):
                        t[g] = t.get(g, 0) + n
                    if len(t) >= HELD:
                        yield from hand_on(m)
        yield from hand_on(0)
        yield from hand_on(1)

    few, _ = sift(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), trusted, "doc_id")
    texts = few.select("doc_id", half().alias("half"), squeeze("text").alias("z")).join(trusted.hint("merge"), "doc_id", "left_semi")
    return texts.select("half", "z").mapInArrow(count, "m int, g string, n long").groupBy("m", "g").agg(F.sum("n").alias("n"))


def _cut(n: Column, d: dict) -> Column:
    """The discount of a count, by model."""
    out = F.lit(0.0)
    for (m, i), v in d.items():
        out = F.when((F.col("m") == m) & (F.least(n, F.lit(3)) == i), v).otherwise(out)
    return out


def bits_of(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """``m, g, bits`` for each distinct row of ``asked(m, g)``: the interpolated modified Kneser-Ney cost
    of the last code point of g, in 1/UNIT bits, by joins of count tables on n-grams. What counts do not
    hold backs off to lower orders, at last to one of the code points known or any other."""
    tables, wanted = {ORDER: counts}, {ORDER: asked}
    for k in range(ORDER - 1, 0, -1):  # how many code points precede: continuation counts
        tables[k] = settle(tables[k + 1].groupBy("m", F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).alias("n")))
        wanted[k] = wanted[k + 1].select("m", F.substring("g", 2, k).alias("g")).distinct()
    known = dict(tables[1].groupBy("m").count().collect())
    p = None
    for k in range(1, ORDER + 1):
        t = tables[k]
        of = {(r[0], r[1]): r[2] for r in t.where("n <= 4").groupBy("m", "n").count().collect()}
        d = {}
        for m in (0, 1):
            n = [of.get((m, i), 0) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
            for i in range(3):
                d[m, i + 1] = min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.0), i + 1.0) if n[i] else y
        cut = _cut(F.col("n"), d)
        sums = t.groupBy("m", F.substring("g", 1, k - 1).alias("h")).agg(F.sum("n").alias("total"), F.sum(cut).alias("freed"))
        seen = t.select("m", "g", (F.col("n") - cut).alias("left"))
        q = wanted[k].join(seen, ["m", "g"], "left").withColumn("h", F.substring("g", 1, k - 1)).join(sums, ["m", "h"], "left")
        if p is None:
            q = q.withColumn("q", F.lit(1.0) / (F.when(F.col("m") == 0, known.get(0, 0)).otherwise(known.get(1, 0)) + 1))
        else:
            q = q.withColumn("s", F.substring("g", 2, k - 1)).join(p.select("m", F.col("g").alias("s"), F.col("p").alias("q")), ["m", "s"])
        p = q.select("m", "g", F.coalesce((F.coalesce("left", F.lit(0.0)) + F.col("freed") * F.col("q")) / F.col("total"), F.col("q")).alias("p"))
    return p.select("m", "g", F.round(-F.log2(F.greatest("p", F.lit(1e-12))) * UNIT).cast("int").alias("bits"))


def _slot(salt: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(salt)), F.lit(SIFT_BITS))


def gather(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``blocks`` of ``docs`` and ``m, g, n``, the n-grams of the documents of ``trusted(doc_id)``.

    Texts need not meet the trusted ids in a join: a bit filter marks rows that may be trusted, a second
    one the rows that the first marks wrongly, which joins of ids alone find out. What only the first
    marks is trusted for sure and counted while it is packed; the few trusted rows that both mark are
    counted by a join."""
    spark = docs.sparkSession
    first = share(spark, bit_table(trusted.select(_slot(0).alias("s")), SIFT_BITS))  # SIFT_BITS / 4 bytes each

    @F.arrow_udf("boolean")
    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(_among(first.value, b.to_numpy()))

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    wrong = ids.where(marked(_slot(0))).join(trusted.hint("merge"), "doc_id", "left_anti").distinct()
    wrong = settle(wrong)
    second = share(spark, bit_table(wrong.select(_slot(1).alias("s")), SIFT_BITS))

    @F.arrow_udf("boolean")
    def unsure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(_among(second.value, b.to_numpy()))

    packed = settle(blocks(docs, first, second))
    counts = packed.select(F.expr("1 - m").alias("kd_of"), F.explode(F.arrays_zip("grams", "counts")).alias("kd")).where("kd.counts > 0")
    # the texts of one half score the other
    counts = counts.select(F.col("kd_of").alias("m"), F.col("kd.grams").alias("g"), F.col("kd.counts").alias("n"))
    both = settle(trusted.where(unsure(_slot(1))))
    if not wrong.isEmpty() and not both.isEmpty():
        counts = counts.unionByName(joined_counts(docs, both))
    return packed, settle(counts.groupBy("m", "g").agg(F.sum("n").alias("n")))


def _among(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at // 32] >> (at % 32).astype(np.uint64)) & np.uint64(1) == 1


def blocks(docs: DataFrame, first, second) -> DataFrame:
    """``block, m, ids, langs, sizes, blobs, grams, counts``: documents of one half and task, their texts
    compressed by runs of documents, the distinct n-grams in them, and how often each is in documents
    that the bit set ``first`` marks and ``second`` does not. Texts are held one run at a time."""
    small_batches(docs.sparkSession)

    def pack(batches):
        made = TaskContext.get().partitionId() << 32
        rows = [None, None]

        def fresh():
            return {"ids": [], "langs": [], "sizes": [], "blobs": [], "counts": {}, "run": [], "sure": [], "held": 0, "all": 0}

        def end_run(r):
            for texts, times in (([t for t, y in zip(r["run"], r["sure"]) if y], 1), ([t for t, y in zip(r["run"], r["sure"]) if not y], 0)):
                for grams, number, _, _ in pieces(texts):
                    for g, n in zip(grams, np.bincount(number).tolist()):
                        r["counts"][g] = r["counts"].get(g, 0) + n * times
            r["blobs"].append(bz2.compress("".join(r["run"]).encode()))
            r["run"], r["sure"], r["held"] = [], [], 0

        def close(m):
            nonlocal made
            r, rows[m] = rows[m], None
            if r["run"]:
                end_run(r)
            grams = sorted(r["counts"])
            row = {"block": made, "m": m, "grams": grams, "counts": [r["counts"][g] for g in grams]} | {k: r[k] for k in ("ids", "langs", "sizes", "blobs")}
            made += 1
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            may = _among(first.value, b.column(4).to_numpy()) & ~_among(second.value, b.column(5).to_numpy())
            for m, i, lang, t, y in zip(*(c.to_pylist() for c in b.columns[:4]), may.tolist()):
                r = rows[m] = rows[m] or fresh()
                r["ids"].append(i)
                r["langs"].append(lang)
                r["sizes"].append(-1 if t is None else len(t))
                r["run"].append(t or "")
                r["sure"].append(y)
                r["held"] += len(t or "") + 16
                r["all"] += len(t or "") + 16
                if r["held"] >= RUN:
                    end_run(r)
                if r["all"] >= BLOCK:
                    yield close(m)
        for m in (0, 1):
            if rows[m]:
                yield close(m)

    schema = pa.schema([("block", pa.int64()), ("m", pa.int32()), ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("blobs", pa.list_(pa.binary())), ("grams", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
    return docs.select(half().alias("m"), F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text", _slot(0).alias("kd_a"), _slot(1).alias("kd_b")).mapInArrow(pack, "block long, m int, ids array<long>, langs array<string>, sizes array<long>, blobs array<binary>, grams array<string>, counts array<long>")


def perplexity(packed: DataFrame, counts: DataFrame) -> DataFrame:
    """``doc_id, lang, n_chars, bits`` per row of the blocks; bits is the mean per code point, in 1/UNIT."""
    asked = packed.select("block", "m", F.explode("grams").alias("g"))
    # n-grams move to their counts once, with the blocks of up to 1024 tasks that ask for each
    asked = settle(asked.groupBy("m", "g", F.shiftright("block", 42).alias("kd_tasks")).agg(F.collect_list("block").alias("by")))
    every = asked.select("m", "g").distinct()
    answers = asked.join(settle(bits_of(counts, settle(every))).hint("merge"), ["m", "g"]).select(F.explode("by").alias("kd_block"), "g", "bits")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        bits = dict(zip(right.column("g").to_pylist(), right.column("bits").to_pylist()))
        row = left.to_pylist()[0]
        mean, sizes = [], [max(n, 0) for n in row["sizes"]]
        for blob in row["blobs"]:
            run, at, texts = bz2.decompress(blob).decode(), 0, []
            while len(mean) + len(texts) < len(sizes) and at + sizes[len(mean) + len(texts)] <= len(run):
                texts.append(run[at : at + sizes[len(mean) + len(texts)]])
                at += len(texts[-1])
            total = np.zeros(len(texts), np.int64)
            for grams, number, owner, begins in pieces(texts):
                np.add.at(total, owner, np.add.reduceat(np.array([bits[g] for g in grams], np.int64)[number], begins))
            mean += [(int(s) * 2 + len(t)) // (2 * len(t)) if t else None for s, t in zip(total, texts)]
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "lang": pa.array(row["langs"], pa.string()), "n_chars": pa.array(sizes, pa.int64()), "bits": pa.array(mean, pa.int64())})

    texts = packed.select("block", "ids", "langs", "sizes", "blobs")
    return texts.groupBy("block").cogroup(answers.groupBy("kd_block")).applyInArrow(score, "doc_id long, lang string, n_chars long, bits long")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, threshold, kept`` for each row."""
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    scored = settle(perplexity(*gather(docs, trusted)).withColumn("kd_lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))))
    known = scored.where("bits is not null").join(trusted.hint("merge"), "doc_id", "left_semi")
    hist = known.groupBy("kd_lang", "bits").agg(F.count(F.lit(1)).alias("n"))  # few rows: bits are whole thousandths
    hist = hist.unionByName(hist.groupBy("bits").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("kd_lang"), "bits", "n"))
    up, all_ = W.partitionBy("kd_lang").orderBy("bits"), W.partitionBy("kd_lang")
    cut = hist.select("kd_lang", "bits", F.sum("n").over(up).alias("upto"), F.sum("n").over(all_).alias("total")).where(F.col("upto") >= F.col("total") * quantile).groupBy("kd_lang").agg(F.min("bits").alias("cut"))
    cut = settle(cut)  # a row a language
    every = cut.where("kd_lang is null").select(F.col("cut").alias("every"))
    limits = scored.select("kd_lang").distinct().join(cut, "kd_lang", "left").join(every, F.lit(True), "left").select("kd_lang", F.coalesce("cut", "every").alias("cut"))
    # a written table: its size is known, so that the few rows it mostly has are broadcast and a hot language stays where it is
    out = scored.join(settle(limits), "kd_lang", "left")
    two = lambda c: F.round(F.pow(F.lit(2.0), F.col(c) / UNIT), 4)
    return out.select("doc_id", "lang", "n_chars", two("bits").alias("perplexity"), two("cut").alias("threshold"), F.coalesce(F.col("bits").isNotNull() & (F.col("cut").isNull() | (F.col("bits") <= F.col("cut"))), F.lit(False)).alias("kept"))
