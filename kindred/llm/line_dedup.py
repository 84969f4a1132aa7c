"""Line dedup by overlapping three-line windows.

A document's lines that hold a word are numbered; each three in a row make a window, hashed over
the lines' words. Windows are compared over the whole corpus: the first occurrence, in (doc_id,
content, position) order, covers nothing, and every later one covers its lines. Covered positions of
a document are merged and its text is rebuilt without them. A line goes once any later occurrence
covers it, even one that overlaps a first occurrence: of nine equal lines in a row, whose windows all
repeat the first, only the first line stays. The first occurrence is a minimum, so a window that very
many documents share is summed before it is dealt out.

A word is ``[^\\x20\\x09-\\x0D]+``; other space characters belong to words.

Defined results: a document with fewer than three such lines, a null or an empty text is returned
as it came; lines without a word are kept where they stand; repeated rows of the same doc_id and
text are one document for the order, so all of them lose or keep the same lines; a null doc_id
comes last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, sift, small_batches

WINDOW = 3


def _lines(text: str | None) -> tuple[list[bytes], list[int]]:
    """Lines split at \\n, and the numbers of those that hold a word."""
    lines = (text or "").encode("utf-8", "replace").split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x and not x.isspace()]


def _windows(text: str | None, size: int) -> list[int]:
    """A signed 64-bit hash for each window of ``size`` lines that hold a word."""
    lines, at = _lines(text)
    if len(at) < size:
        return []
    words = [b" ".join(lines[i].split()) for i in at]
    return [xxhash.xxh3_64_intdigest(b"\n".join(words[i : i + size])) - (1 << 63) for i in range(len(words) - size + 1)]


def _tag(docs: DataFrame) -> DataFrame:
    """``__kindred_id, __kindred_hash`` of each row: its place in the order and a hash of its text."""
    return docs.withColumns({"__kindred_id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "__kindred_hash": F.xxhash64("text")})


def covered(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``__kindred_id, __kindred_hash, __kindred_drop``: the sorted numbers of the word lines that go, a row for each document
    that loses any."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<long>")
    def windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([_windows(t, size) for t in b.to_pylist()], pa.list_(pa.int64()))

    rows = settle(_tag(docs).select("__kindred_id", "__kindred_hash", windows("text").alias("w")).where(F.size("w") > 0))
    flat = rows.select("__kindred_id", "__kindred_hash", F.posexplode("w").alias("pos", "h")).distinct()
    first = flat.groupBy("h").agg(F.min(F.struct("__kindred_id", "__kindred_hash", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = flat.join(first.hint("merge"), "h").where(F.struct("__kindred_id", "__kindred_hash", "pos") > F.col("first"))
    steps = F.array(*(F.lit(i) for i in range(size)))
    out = settle(
        again.groupBy("__kindred_id", "__kindred_hash").agg(F.collect_set("pos").alias("p"))  # at most the lines of one document
        .select("__kindred_id", "__kindred_hash", F.sort_array(F.array_distinct(F.flatten(F.transform("p", lambda x: F.transform(steps, lambda s: x + s))))).alias("__kindred_drop"))
    )
    discard(rows)
    return out


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with later occurrences of repeated windows removed from ``text``; a column ``n_chars``
    follows the new text. Every row stays, even one whose text becomes empty."""

    @F.arrow_udf("string")
    def rebuild(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, drop in batches:
            out = []
            for t, d in zip(text.to_pylist(), drop.to_pylist()):
                if d:
                    lines, at = _lines(t)
                    gone = {at[i] for i in d}
                    t = b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode()
                out.append(t)
            yield pa.array(out, pa.string())

    drop = covered(docs, size)
    cols = docs.columns
    key = ["__kindred_id", "__kindred_hash"]
    few, rest = sift(_tag(docs), drop, *key)  # most texts lose nothing and stay where they are
    joined = few.join(drop.hint("merge"), key, "left")
    # only rows that lose lines go through Python
    text = F.when(F.col("__kindred_drop").isNotNull(), rebuild("text", "__kindred_drop")).otherwise(F.col("text"))
    out = joined.withColumn("__kindred_text", text)
    put = {"text": F.col("__kindred_text")}
    if "n_chars" in cols:
        put["n_chars"] = F.when(F.col("__kindred_drop").isNotNull(), F.length("__kindred_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(put).select(*cols).unionByName(rest.select(*cols))


def removed_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, n_removed``: how many lines each document loses, 0 included."""
    drop = covered(docs, size)
    return _tag(docs.select("doc_id", "text")).join(drop, ["__kindred_id", "__kindred_hash"], "left").select("doc_id", F.coalesce(F.size("__kindred_drop"), F.lit(0)).cast("long").alias("n_removed"))
