"""Shared pieces of the training-data operators: shared-folder tables, hashing of words and
shingles, and connected components. Every operator here selects the columns it needs first and
names its own with a ``kd_`` prefix (``__kindred`` where all columns are carried along), so extra columns never clash."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of an Arrow batch handed to Python; keeps a batch of very long texts small
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, for good: plans are lazy and read the
    setting when they run. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def trim() -> None:
    """Give back to the system what this process has freed: a worker that is reused otherwise keeps the
    memory of the largest stage it ran."""
    gc.collect()
    _POWERS[0] = _POWERS[0][:1].copy()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: what the innermost ``scope`` holds: tables of ``settle`` and broadcasts of ``share``
_SCOPES: list[list] = []


@contextlib.contextmanager
def scope():
    """Tables settled and values shared within go at its end; results must be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for x in _SCOPES.pop():
            if isinstance(x, DataFrame):
                discard(x)
            else:
                x.destroy()


def share(spark: SparkSession, value):
    """Broadcast a value of bounded size."""
    held = spark.sparkContext.broadcast(value)
    if _SCOPES:
        _SCOPES[-1].append(held)
    return held


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Unset, a local session,
    as in tests, takes a temporary folder of this machine; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage and survives the loss of
    executors, since nothing of it stays on their disks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kd-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kd_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete the tables of ``settle`` that no result reads any more."""
    for df in dfs:
        path = getattr(df, "kd_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: bits of the filter of ``sift``; false hits only cost volume
SIFT_BITS = 1 << 25


def bit_table(slots: DataFrame, bits: int) -> np.ndarray:
    """The values of ``slots(s)``, each below ``bits``, as a bit set of bits / 4 bytes."""
    got = slots.groupBy(F.floor(F.col("s") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("b")).toArrow()
    table = np.zeros(bits // 32, np.uint64)
    if got.num_rows:
        table[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint64)
    return table


def sift(docs: DataFrame, keys: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose whole-number columns ``by`` may be among those of ``keys``, and rows
    whose are surely not. What follows a join on few keys need not move the texts of the second."""
    slot = F.pmod(F.xxhash64(*(F.col(c).cast("long") for c in by)), F.lit(SIFT_BITS))
    held = share(docs.sparkSession, bit_table(keys.select(slot.alias("s")), SIFT_BITS))  # SIFT_BITS / 4 bytes

    @F.arrow_udf("boolean")
    def among(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            at = b.to_numpy()
            yield pa.array((held.value[at // 32] >> (at % 32).astype(np.uint64)) & np.uint64(1) == 1)

    marked = docs.withColumn("__kindred_among", among(slot))
    return marked.where("__kindred_among").select(*docs.columns), marked.where("not __kindred_among").select(*docs.columns)


_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser, vectorised."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


#: one 64-bit number for each byte, and whether the byte is white space
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        _POWERS[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _M1 | np.uint64(1), np.uint64))])
    return _POWERS[0]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text: byte numbers weighted by
    their place in the word, summed, then mixed with its length."""
    b = np.frombuffer(raw, np.uint8)
    space = np.ones(len(b) + 2, bool)
    np.take(_SPACE, b, out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    size = edge[1::2] - edge[::2]
    if not len(size):
        return np.empty(0, np.uint64)
    first = np.cumsum(size) - size
    kept = b[~space[1:-1]]
    place = np.arange(len(kept)) - np.repeat(first, size)
    return mix(np.add.reduceat(_BYTE[kept] * _powers(int(size.max()))[place], first) + size.astype(np.uint64) * _P)


def distinct(hashes: np.ndarray) -> np.ndarray:
    s = np.sort(hashes)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each window of k consecutive word hashes (order matters)."""
    n = len(hashes) - k + 1
    acc = hashes[:n] * _P
    for j in range(1, k):
        acc = (acc + hashes[j : j + n]) * _P
    return mix(acc)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles, A-Z lower-cased. Fewer than k words: the whole
    sequence is one shingle; no word: the empty set."""
    h = word_hashes((text or "").encode("utf-8", "replace").lower())
    if 0 < len(h) < k:
        return mix(windows(h, len(h)) + np.uint64(len(h)))
    return distinct(windows(h, k)) if len(h) else h


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, comp)``, comp the smallest node reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is a partial
    aggregate and an equi-join, so a node with very many links is never gathered in one task.
    Each round is settled in the shared folder. No edges give no rows.
    """
    e = settle(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    old = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low2, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pairs.select("u", F.col("m").alias("v")))
        nxt = settle(small.where("u <> v").distinct())
        seen = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = nxt
        if seen == old:
            break
        old = seen
    out = e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    done = settle(out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()).groupBy("node").agg(F.min("comp").alias("comp")))
    discard(e)
    return done
