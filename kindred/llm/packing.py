"""Best-fit packing by a configuration linear program.

Documents become token ids, then an end id; only those over the capacity are cut. Packing depends
on lengths alone, so the plan is made on the histogram of piece lengths (at most ``capacity`` rows,
whatever the input): the configuration LP "cover every length as often as it occurs by the fewest
patterns" is solved by multiplicative weights, a knapsack dynamic program pricing all patterns in
each round; the solution is rounded to whole patterns, what rounding leaves is solved and rounded
again, and the last RESIDUE of all ids is filled largest first with the best-fitting lengths left.
Pieces then find their places by arithmetic on their rank among pieces of their length; ranks are
taken in salted buckets of about BUCKET_ROWS, so a length that a third of all pieces share is dealt
over many tasks. ``by_lp`` says of each piece whether the linear program placed it.

Defined results: a null or empty text has only its end id; repeated rows are packed as often as
they come; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import settle, small_batches, trim
from .encode import DEFAULT_TOKENIZER, encoder

CAPACITY = 2048
#: rounds of multiplicative weights in one solution
ROUNDS = 30
#: how fast the weight of a length falls as it is covered
RATE = 2.0
#: patterns priced within this share of the best one are taken too
SLACK = 0.05
#: random share of a price that breaks ties between patterns
JITTER = 0.02
#: powers of its length that a piece is priced by before any weight falls; the material bound prices by
#: the first power, long pieces that leave short ones no room by a higher one
PRIORS = (1.02, 1.1, 1.5)
#: share of all ids that may be left to the filler
RESIDUE = 0.015
#: pieces of one length that are ranked together, about
BUCKET_ROWS = 1 << 18

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, end: int = 0, payload: bool = False) -> DataFrame:
    """Each document's pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32``
    and, with ``payload``, the packed ``ids``."""
    small_batches(docs.sparkSession)
    tail = int(end).to_bytes(4, "little")

    def cut(batches):
        trim()
        enc = encoder(tokenizer)
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = enc.packed(t) + tail
                for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                    x = raw[at : at + 4 * capacity]
                    rows.append((d, p, at // 4, len(x) // 4, zlib.crc32(x), x))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if payload:
                arrays.append(pa.array(cols[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + (", ids binary" if payload else ""))


def _priced(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over ``lengths`` (ascending): the greatest value of each capacity up to
    ``capacity``, and the length index that its best multiset takes last (-1: none, a place stays free)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            v = best[c - lengths[: fits[c]]] + value[: fits[c]]
            i = int(v.argmax())
            if v[i] > best[c]:
                best[c], took[c] = v[i], i
    return best, took


def _traced(took: np.ndarray, lengths: np.ndarray, capacity: int) -> Counter:
    """The multiset of length indexes behind ``_priced`` at one capacity."""
    pattern = Counter()
    while capacity > 0:
        i = int(took[capacity])
        if i >= 0:
            pattern[i] += 1
        capacity -= int(lengths[i]) if i >= 0 else 1
    return pattern


def configuration_lp(demand: np.ndarray, lengths: np.ndarray, capacity: int, rounds: int = ROUNDS, prior: float = PRIORS[0]) -> dict[tuple, float]:
    """Fractional copies of patterns ``((length index, times), ...)`` that cover the demand.

    Multiplicative weights: a length's price is its weight over its demand, and its weight falls with
    the share of its demand that is covered, from a power ``prior`` of the length on.
    Each round prices all patterns by one knapsack table. Every length whose best pattern comes
    within SLACK of the best of all gives that pattern a step, as long as no length is covered more
    than once in the round.
    """
    draw = np.random.default_rng(1)
    covered, used = np.zeros(len(lengths)), Counter()
    for _ in range(rounds):
        price = (lengths / capacity) ** prior * np.exp(-RATE * covered) * (1 + JITTER * draw.random(len(lengths)))
        best, took = _priced(price, lengths, capacity)
        near = np.flatnonzero(price + best[capacity - lengths] >= (1 - SLACK) * best[capacity])
        fresh = np.zeros(len(lengths))
        for i in near[np.lexsort((-lengths[near], covered[near]))]:
            if fresh[i] >= 1:
                continue
            pattern = _traced(took, lengths, capacity - int(lengths[i]))
            pattern[int(i)] += 1
            step = min((1 - fresh[j]) * demand[j] / k for j, k in pattern.items())
            if step > 1e-9:
                used[tuple(sorted(pattern.items()))] += step
                for j, k in pattern.items():
                    fresh[j] += k * step / demand[j]
        covered += fresh
        if covered.min() >= 1:
            break
    return used


def _rounded(solution: dict[tuple, float], left: np.ndarray) -> Counter:
    """Whole copies: the floor, and one more wherever the sum of the fractions passes a half; never
    more than what is ``left``, which shrinks by what is taken."""
    out, carry = Counter(), 0.0
    for pattern, x in sorted(solution.items(), key=lambda kv: (-kv[1], kv[0])):
        copies = int(x)
        carry += x - copies
        if carry >= 0.5:
            copies, carry = copies + 1, carry - 1
        copies = min(copies, *(int(left[i]) // k for i, k in pattern))
        if copies > 0:
            out[pattern] += copies
            for i, k in pattern:
                left[i] -= k * copies
    return out


def _fill(left: np.ndarray, lengths: np.ndarray, capacity: int, first: int) -> Counter:
    """A pattern that holds length index ``first`` and, of what is left, the lengths that fill the
    rest best; longest first, by reachable sums as bits."""
    out = Counter({first: 1})
    room = capacity - int(lengths[first])
    while room > 0:
        n = int(np.searchsorted(lengths, room, "right"))
        have = np.flatnonzero(left[:n] - np.array([out[i] for i in range(n)]) > 0) if n else []
        if not len(have):
            break
        exact = {int(lengths[i]): int(i) for i in have}
        # one more that fits exactly, or two, else the longest that fits
        pick = [exact[room]] if room in exact else next(([int(i), exact[room - int(lengths[i])]] for i in have[::-1] if room - int(lengths[i]) in exact and (exact[room - int(lengths[i])] != i or left[i] - out[int(i)] > 1)), [int(have[-1])])
        for i in pick:
            out[i] += 1
            room -= int(lengths[i])
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int, bool]]:
    """Patterns as ``({length: times}, copies, by_lp)``; together they hold each length exactly as
    often as the histogram has it. ``by_lp`` is false for what the linear program left over. The
    priors are tried until a plan comes within a thousandth of the least that the total allows; the
    plan of the fewest sequences is taken."""
    whole = histogram.get(capacity, 0)
    out = [({capacity: 1}, whole, True)] if whole else []  # no other pattern holds it
    items = sorted((n, c) for n, c in histogram.items() if n < capacity and c > 0)
    if not items:
        return out
    lengths, demand = np.array([n for n, _ in items]), np.array([c for _, c in items], np.int64)
    least, best, size = -(-int((lengths * demand).sum()) // capacity), [], None
    for prior in PRIORS:
        parts = _planned(lengths, demand.copy(), capacity, rounds, prior)
        n = sum(copies for _, copies, _ in parts)
        if size is None or n < size:
            best, size = parts, n
        if size <= least + least // 1000:
            break
    return out + best


def _planned(lengths: np.ndarray, left: np.ndarray, capacity: int, rounds: int, prior: float) -> list[tuple[dict[int, int], int, bool]]:
    out, total = [], int((lengths * left).sum())
    rest = total
    # solve, round, and solve anew for what rounding left, until that is little or no longer shrinks
    while rest > RESIDUE * total:
        at = np.flatnonzero(left)
        some = left[at]
        taken = _rounded(configuration_lp(some.astype(float), lengths[at], capacity, rounds, prior), some)
        out += [({int(lengths[at[i]]): k for i, k in pattern}, copies, True) for pattern, copies in taken.items()]
        left[at] = some
        was, rest = rest, int((lengths * left).sum())
        if rest > 0.9 * was:
            break
    for first in range(len(lengths) - 1, -1, -1):
        while left[first] > 0:
            pattern = _fill(left, lengths, capacity, first)
            copies = min(int(left[i]) // k for i, k in pattern.items())
            out.append(({int(lengths[i]): k for i, k in pattern.items()}, copies, False))
            for i, k in pattern.items():
                left[i] -= k * copies
    return out


def _places(patterns: list[tuple[dict[int, int], int, bool]]) -> dict[int, list[tuple]]:
    """length -> ``(from rank, sequence of the first copy, offset, by_lp)`` of each of its places, by rank."""
    rank, sequence, places = Counter(), 0, {}
    for pattern, copies, by_lp in patterns:
        offset = 0
        for n in sorted(pattern, reverse=True):
            for _ in range(pattern[n]):
                places.setdefault(n, []).append((rank[n], sequence, offset, by_lp))
                rank[n] += copies
                offset += n
        sequence += copies
    return places


def _spans(counts: dict[tuple[int, int], int], places: dict[int, list[tuple]]) -> Iterator[tuple]:
    """``length, bucket, first rank in the bucket, sequence, offset, by_lp``: for each bucket of a
    length the places that its ranks fall into, the first rank of each."""
    before = Counter()
    for (n, bucket), c in sorted(counts.items()):
        lo, hi = before[n], before[n] + c
        before[n] = hi
        starts = [x[0] for x in places[n]]
        for x in places[n][bisect.bisect_right(starts, lo) - 1 : bisect.bisect_left(starts, hi)]:
            at = max(lo, x[0])
            yield n, bucket, at - lo, x[1] + at - x[0], x[2], x[3]


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (with ``doc_id, piece, length``) and ``sequence_id, offset, by_lp`` for each piece."""
    spark = cut.sparkSession
    cut = settle(cut)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    if not histogram:
        more = {"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "by_lp": F.lit(True)}
        return cut.withColumns(more)
    # a length is dealt over as many buckets as its pieces need
    deal = [(n, -(-c // BUCKET_ROWS)) for n, c in sorted(histogram.items())]
    dealt = spark.createDataFrame(pa.table({"length": [n for n, _ in deal], "kd_of": [b for _, b in deal]}))
    rows = cut.join(F.broadcast(dealt), "length")  # at most capacity rows
    rows = rows.withColumn("kd_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("kd_of")))
    counts = rows.groupBy("length", "kd_bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # capacity + pieces / BUCKET_ROWS
    spans = _spans({(r["length"], r["kd_bucket"]): r["n"] for r in counts}, _places(plan(histogram, capacity)))
    # their number is bounded by the plan (patterns times pieces of one) and the buckets, not by the documents
    kinds = [pa.int64()] * 5 + [pa.bool_()]
    names = ["length", "kd_bucket", "kd_lo", "kd_seq", "kd_offset", "kd_by_lp"]
    small = spark.createDataFrame(pa.table({c: pa.array(v, k) for c, v, k in zip(names, zip(*spans), kinds)}))
    steps = small.groupBy("length", "kd_bucket").agg(F.sort_array(F.collect_list(F.struct(*names[2:]))).alias("kd_steps"))
    order = W.partitionBy("length", "kd_bucket").orderBy("doc_id", "piece", *(c for c in ("ids_crc32",) if c in cut.columns))
    ranked = rows.withColumn("kd_rank", F.row_number().over(order).cast("long") - 1)
    # a piece takes the last step that begins at or before its rank
    step = F.element_at(F.filter("kd_steps", lambda s: s["kd_lo"] <= F.col("kd_rank")), -1)
    found = ranked.join(steps, ["length", "kd_bucket"]).withColumn("kd_step", step)
    sequence = F.col("kd_step.kd_seq") + F.col("kd_rank") - F.col("kd_step.kd_lo")
    return found.select(
        *cut.columns,
        sequence.alias("sequence_id"),
        F.col("kd_step.kd_offset").alias("offset"),
        F.col("kd_step.kd_by_lp").alias("by_lp"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, end: int = 0) -> DataFrame:
    return pack(pieces(docs, capacity, tokenizer, end), capacity)
