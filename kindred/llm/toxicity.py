"""Toxicity by noisy-channel deobfuscation.

1. A character language model: 4-gram counts over the letters of every document (Latin letters
   without their marks, any other letter as one), summed task by task into at most 32^4 cells.
2. Suspect spans (letters mixed with digits or signs in any place, single letters and signs set
   apart by up to three separators, doubled letters) become a lattice of the letters each sign may stand for; separators may be
   dropped and repeats collapsed. Viterbi picks the likeliest reading under the model, in time
   linear in the span.
3. The restored text is scored by words and word beginnings whose share of toxic documents was
   learnt from labels; all evidence of a text is combined by noisy-or.

Labels are used only where ``crc32(doc_id) mod 3 <> 1``, at most TRAIN_ROWS a class (those with the
smallest hash of doc_id); scores see nothing but the text. Defined results: null and empty texts
score as a text without evidence; rows are independent, so repeated rows repeat; a null doc_id has
a null held_out; without usable labels every text scores 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, share, small_batches

#: labelled rows of each class that the scorer is fitted on, at most
TRAIN_ROWS = 30_000
#: toxic documents of the fitted sample that a feature must occur in
LEAST_DOCS = 3
#: weight of the prior in a feature's toxic share
PRIOR_WEIGHT = 3.0
#: smallest toxic share that a feature is kept for
LEAST_SHARE = 0.6
PREFIXES = (5, 4)
#: weight of evidence after the first
LATER = 0.3

_SYMBOLS = 32
_OTHER = 27  # any letter beyond a-z
_CODE = np.zeros(256, np.int64)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CODE[0xC2:0xF5] = _OTHER
_INNER = np.zeros(256, bool)
_INNER[0x80:0xC0] = True  # bytes that continue a code point

#: what a sign may stand for (fixed values)
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t"}
_SIGNS = "0-9@$!|+"
#: letters mixed with signs in any place; single letters and signs set apart, a letter among them;
#: a letter doubled
_SUSPECT = re.compile(
    rf"(?<![a-z{_SIGNS}])(?=[{_SIGNS}]*[a-z])(?=[a-z]*[{_SIGNS}])[a-z{_SIGNS}]{{3,}}"
    rf"|(?<![^\W_])(?<![{_SIGNS}])(?=[{_SIGNS} ._*-]*[a-z])[a-z{_SIGNS}](?:[ ._*-]{{1,3}}[a-z{_SIGNS}]){{3,}}(?![^\W_]|[{_SIGNS}])"
    rf"|(?<![a-z{_SIGNS}])[a-z]*([a-z])\1[a-z]*"
)
_WORD = re.compile(r"[^\W\d_]+")
#: readings that a task keeps, at most; more are worked out again
_KEPT = 200_000


def _unmarked() -> dict[int, str]:
    """Latin letters beyond ASCII -> their base letters, by Unicode decomposition."""
    out = {}
    for i in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(i)).lower()
        if base[0].isascii() and base[0].isalpha():
            out[i] = "".join(c for c in base if c.isascii() and c.isalpha())
    return out


_BASE = _unmarked()


def plain(text: str | None) -> str:
    """Lower case, Latin letters without their marks."""
    low = (text or "").lower()
    return low if low.isascii() else low.translate(_BASE)


def suspects(low: str) -> set[str]:
    """Distinct suspect spans of a lower-cased text."""
    return {m[0] for m in _SUSPECT.finditer(low)}


def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter 4-grams over all documents; 0 is a boundary."""
    small_batches(docs.sparkSession)

    def count(batches):
        total = np.zeros(_SYMBOLS**4, np.int64)
        for b in batches:
            raw = np.frombuffer("\n".join(map(plain, b.column(0).to_pylist())).encode("utf-8", "replace"), np.uint8)
            c = _CODE[raw[~_INNER[raw]]]
            if len(c) > 3:
                total += np.bincount(((c[:-3] * 32 + c[1:-2]) * 32 + c[2:-1]) * 32 + c[3:], minlength=len(total))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(total[at[i : i + 50_000]])], names=["g", "n"])

    got = docs.select("text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_SYMBOLS**4)
    if got.num_rows:
        out[got.column("g").to_numpy()] = got.column("n").to_numpy()
    return out


class CharModel:
    """Log probability of a letter after the three before it, backing off by interpolation."""

    def __init__(self, counts: np.ndarray):
        c4 = counts.reshape((_SYMBOLS,) * 4)
        p = np.full(_SYMBOLS, 1.0 / _SYMBOLS)
        for c in (c4.sum((0, 1, 2)), c4.sum((0, 1)), c4.sum(0), c4):
            total = c.sum(-1, keepdims=True)
            p = (c + 4.0 * p) / (total + 4.0)
        self.log = np.log(p).astype(np.float32)
        self.read: dict[str, list[str]] = {}

    def decode(self, span: str) -> str:
        """The likeliest reading of a suspect span, by Viterbi over the last three letters."""
        # last three letters -> score, and the reading as a chain of (chain before, letter)
        states: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
        run = ""
        for ch in span:
            if ch in " ._*-":  # dropped, or the end of a word after all
                for (a, b, c), (s, out) in list(states.items()):
                    if c:
                        v = s + float(self.log[a, b, c, 0])
                        if v > states.get((b, c, 0), (-1e30,))[0]:
                            states[b, c, 0] = (v, (out, " "))
                run = ""
                continue
            options = LEET.get(ch, ch)
            repeated = ch == run
            run = ch
            new: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
            for (a, b, c), (s, out) in states.items():
                if repeated and s > new.get((a, b, c), (-1e30,))[0]:
                    new[a, b, c] = (s, out)  # a repeat that says nothing
                for letter in options:
                    k = ord(letter) - 96 if "a" <= letter <= "z" else _OTHER
                    v = s + float(self.log[a, b, c, k]) - (0.0 if letter == ch else 0.5)
                    if repeated:
                        v -= 1.0
                    if v > new.get((b, c, k), (-1e30,))[0]:
                        new[b, c, k] = (v, (out, letter))
            states = new
        chain = max(((s + float(self.log[a, b, c, 0]), out) for (a, b, c), (s, out) in states.items()), key=lambda x: x[0])[1]
        letters = []
        while chain is not None:
            chain, letter = chain
            letters.append(letter)
        return "".join(reversed(letters))

    def restored(self, low: str) -> list[str]:
        """Readings of the suspect spans of a lower-cased text."""
        out = []
        for x in suspects(low):
            words = self.read.get(x)
            if words is None:
                words = self.decode(x).split()
                if len(self.read) < _KEPT:
                    self.read[x] = words
            out += words
        return out


def _words(text: str | None, model: CharModel) -> set[str]:
    """Words of a text in lower case, and those that are restored in it."""
    return set(_WORD.findall((text or "").lower())).union(model.restored(plain(text)))


def features(text: str | None, model: CharModel) -> set[str]:
    """Words, and word beginnings marked by a dash, of a text and of what is restored in it."""
    words = _words(text, model)
    out = set(words)
    starts = words
    for k in PREFIXES:
        starts = {w[:k] for w in starts if len(w) >= k}
        out.update([w + "-" for w in starts])
    return out


class Known:
    """Shares by kind of feature, so that a text needs set intersections alone."""

    def __init__(self, shares: dict[str, float]):
        self.words = {f: v for f, v in shares.items() if not f.endswith("-")}
        self.starts = [{f[:-1]: v for f, v in shares.items() if len(f) == k + 1 and f.endswith("-")} for k in PREFIXES]

    def evidence(self, text: str | None, model: CharModel) -> list[float]:
        """Shares of the known features of a text, largest first."""
        words = _words(text, model)
        out = [self.words[f] for f in words & self.words.keys()]
        for k, known in zip(PREFIXES, self.starts):
            words = {w[:k] for w in words if len(w) >= k}
            out += [known[f] for f in words & known.keys()]
        return sorted(out, reverse=True)


def score_of(evidence: list[float]) -> float:
    """Noisy-or of all evidence, largest first: features of one text are not independent, so what
    comes after the first counts LATER of its share."""
    clean = 1.0
    for i, p in enumerate(evidence):
        clean *= 1 - (p if i == 0 else LATER * p)
    return round(1 - clean, 6)


def _in_training(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, model: CharModel) -> dict[str, float]:
    """feature -> smoothed share of toxic documents among those that have it, of at least LEAST_SHARE."""
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(_in_training())
    usable = settle(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    taken = {}
    for t in (0, 1):
        ids = usable.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).select("doc_id").toArrow()
        taken[t] = np.sort(ids.column(0).to_numpy())
    if not len(taken[1]) or not len(taken[0]):
        return {}
    held, lm = share(spark, taken), share(spark, model)

    def count(batches):
        ids, m = held.value, lm.value
        sums = (Counter(), Counter())
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            col = b.column(0).to_numpy()
            for t in (0, 1):
                for i in np.flatnonzero(np.isin(col, ids[t])):
                    sums[t].update(features(b.column(1)[int(i)].as_py(), m))
            if len(sums[0]) + len(sums[1]) > 1_000_000:
                yield from flush(sums)
        yield from flush(sums)

    def flush(sums):
        keys = list(sums[0].keys() | sums[1].keys())
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([sums[0][k] for k in part], pa.int64()), pa.array([sums[1][k] for k in part], pa.int64())], names=["f", "clean", "toxic"])
        for s in sums:
            s.clear()

    rate = len(taken[1]) / (len(taken[0]) + len(taken[1]))
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    toxic_share = (F.col("toxic") + PRIOR_WEIGHT * rate) / (F.col("clean") + F.col("toxic") + PRIOR_WEIGHT)
    best = counted.where(F.col("toxic") >= LEAST_DOCS).withColumn("share", toxic_share).where(F.col("share") >= LEAST_SHARE)
    # every feature that qualifies; the documents they come from are at most TRAIN_ROWS a class
    return {r["f"]: r["share"] for r in best.select("f", "share").toLocalIterator()}


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    model = CharModel(char_counts(docs))
    shares = fit(docs, labels, model)
    lm, held = share(spark, model), share(spark, Known(shares))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, known = lm.value, held.value
        for b in batches:
            yield pa.array([score_of(known.evidence(t, m)) for t in b.to_pylist()], pa.float64())

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score("text").alias("score"))
    return scored.select("doc_id", (~_in_training()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
