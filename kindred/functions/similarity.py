"""Pair similarity. Sets and lengths are native; Jaro-Winkler and sequence ratios, which Spark has
no function for, run as Arrow functions after every equi-join, and once for each distinct pair of
texts of a batch."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_c = lambda x: F.col(x) if isinstance(x, str) else x


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def token_jaccard(a, b) -> Column:
    return _share(F.size(F.array_intersect(_c(a), _c(b))), F.when((F.size(_c(a)) > 0) & (F.size(_c(b)) > 0), F.size(F.array_union(_c(a), _c(b)))).otherwise(0))


def token_overlap(a, b) -> Column:
    return _share(F.size(F.array_intersect(_c(a), _c(b))), F.least(F.size(F.array_distinct(_c(a))), F.size(F.array_distinct(_c(b)))))


def ngrams(text, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own only one, an empty one has none. The text
    is cut into characters once, so that a long one costs time in proportion to its length."""
    t = _c(text)
    # bound to a variable: cut once, not once a gram
    def grams(chars: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1)))
        return F.transform(at, lambda i: F.array_join(F.slice(chars, i, F.lit(n)), ""))

    made = F.transform(F.array(F.split(t, "")), grams)[0]
    return F.when(F.length(t) > 0, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def char_ngram_jaccard(a, b, n: int = 3) -> Column:
    return token_jaccard(ngrams(a, n), ngrams(b, n))


def byte_jaccard(a, b) -> Column:
    """Jaccard of the sets of UTF-8 bytes: each byte is two hexadecimal digits."""
    as_set = lambda x: F.array_distinct(F.regexp_extract_all(F.hex(F.encode(_c(x), "UTF-8")), F.lit(".."), F.lit(0)))
    return token_jaccard(as_set(a), as_set(b))


def _jaro(a, b) -> tuple[float, int]:
    """Jaro similarity and the common prefix of up to four items."""
    if not a or not b:
        return 0.0, 0
    if a == b:
        return 1.0, min(4, len(a))
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    # places of an item are taken in order, and one before the window is before all later ones
    used, left, right, at = [], [], [], dict.fromkeys(where, 0)
    for i, x in enumerate(a):
        places = where.get(x)
        if places is None:
            continue
        k = at[x]
        while k < len(places) and places[k] < i - reach:
            k += 1
        if k < len(places) and places[k] <= i + reach:
            used.append(places[k])
            left.append(x)
            k += 1
        at[x] = k
    m = len(left)
    if not m:
        return 0.0, 0
    right = [b[j] for j in sorted(used)]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3, same


def jaro_winkler_value(a: str | None, b: str | None) -> float:
    """On UTF-8 bytes; the prefix counts only above a Jaro similarity of 0.7."""
    return jaro_winkler_bytes((a or "").encode(), (b or "").encode())


def jaro_winkler_bytes(a: bytes, b: bytes) -> float:
    s, p = _jaro(a, b)
    return s + 0.1 * p * (1 - s) if s > 0.7 else s


def jaro_winkler_points(a: str | None, b: str | None) -> float:
    """On code points; equal texts are 1 and the prefix always counts."""
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    s, p = _jaro(a, b)
    return s + 0.1 * p * (1 - s)


def sequence_ratio_value(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _pairwise(fn):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a, b):
            if pair not in known:
                known[pair] = fn(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return run


jaro_winkler, jaro_winkler_py, sequence_ratio = _pairwise(jaro_winkler_value), _pairwise(jaro_winkler_points), _pairwise(sequence_ratio_value)


def numbers(text) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"\b\d+\b"), F.lit(0))


def number_match(a, b) -> Column:
    return F.arrays_overlap(numbers(a), numbers(b)).cast("double")


def f_beta(precision, recall, beta: float = 0.5) -> Column:
    p, r, b = _c(precision), _c(recall), beta * beta
    return F.when(b * p + r > 0, (1 + b) * p * r / (b * p + r)).otherwise(0.0)
