"""Training-order materialisation: a keyed permutation gives every sequence a global slot.

The ids of the documents of a task, each with an end id, run on without a gap and are cut into
sequences of ``length`` ids; only the last sequence of a task can be short and is padded. Sequences
are numbered 0..n-1 by task and place, without a sort, and a keyed Feistel network over the smallest
even-bit domain that holds n, walked along its cycles until it falls below n, maps each number to
its slot: a bijection that any task computes for itself.

Shards are flat files of fixed-stride records: slot s is record ``s mod per_shard`` of shard
``s div per_shard`` and begins at byte ``(s mod per_shard) * stride``. A record is the number of its
ids (4 bytes, big-endian), the ids (little-endian, 2 bytes each where the tokenizer's ids fit, else
4), PAD up to ``length`` of them, and a line feed. Slots are dealt to tasks by whole shards and
sorted there; until then records travel compressed. Spark's own text writer puts the bytes down, so its commit makes the write safe to
repeat after a lost executor, on any file system that Spark can write to. ``records`` reads shards
back in the JVM from any slot on, ``stream`` seeks to a slot in files that this machine sees.

Defined results: a null or empty text is its end id alone; repeated rows are written as often as they
come; a null doc_id stays null; an empty table gives no shards.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import settle, shared_dir, small_batches
from .encode import DEFAULT_TOKENIZER, encoder

LENGTH = 2048
#: records of a shard: 17 MB at LENGTH ids of 2 bytes; a larger corpus takes more
PER_SHARD = 4096
#: tasks that write shards, at most; each writes whole shards one after the other
MOST_TASKS = 20_000
ROUNDS = 6
PAD = 0
#: bytes before and after the ids of a record
_HEAD, _TAIL = 4, 1


def feistel(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of ``index`` (each below n) under the permutation of 0..n-1 that ``key`` names."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = [np.uint64(xxhash.xxh3_64_intdigest(f"{key}/{r}".encode())) for r in range(rounds)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, tokenizer: str = DEFAULT_TOKENIZER, end: int = 0) -> DataFrame:
    """``part, seq, length, parts, packed``: the sequences of each task ``part``, numbered there.
    ``parts`` lists the pieces of documents in it: doc_id, start in the document, offset, length;
    ``packed`` is its record, compressed."""
    small_batches(docs.sparkSession)
    width = id_width(tokenizer)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("offset", pa.int32()), ("length", pa.int32())]))

    def cut(batches):
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        tail, z = int(end).to_bytes(4, "little"), zstandard.ZstdCompressor(level=6)
        ids, parts, ready = bytearray(), [], []

        def flush():
            cols = list(zip(*ready)) or [()] * 5
            ready.clear()
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), kind, pa.binary()))]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "seq", "length", "parts", "packed"])

        def close():
            nonlocal seq
            n = len(ids) // width
            ids.extend(int(PAD).to_bytes(width, "little") * (length - n))
            ready.append((part, seq, n, list(parts), z.compress(n.to_bytes(_HEAD, "big") + bytes(ids))))
            seq += 1
            ids.clear()
            parts.clear()

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = enc.packed(t) + tail
                if width == 2:
                    raw = np.frombuffer(raw, "<u4").astype("<u2").tobytes()
                at = 0
                while at < len(raw):
                    take = min(len(raw) - at, width * length - len(ids))
                    parts.append({"doc_id": d, "start": at // width, "offset": len(ids) // width, "length": take // width})
                    ids += raw[at : at + take]
                    at += take
                    if len(ids) == width * length:
                        close()
                if len(ready) >= 256:
                    yield flush()
        if ids:
            close()
        yield flush()

    kinds = "part int, seq long, length int, parts array<struct<doc_id: long, start: long, offset: int, length: int>>, packed binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, kinds)


def id_width(tokenizer: str = DEFAULT_TOKENIZER) -> int:
    return 2 if encoder(tokenizer).tok.get_vocab_size() <= 1 << 16 else 4


@dataclasses.dataclass(frozen=True)
class Shards:
    """Where shards lie and how; kept beside them as a line of JSON."""

    path: str
    total: int
    length: int = LENGTH
    width: int = 2
    per_shard: int = PER_SHARD

    @property
    def stride(self) -> int:
        return _HEAD + self.width * self.length + _TAIL

    def save(self, spark: SparkSession) -> None:
        spark.createDataFrame([(json.dumps(dataclasses.asdict(self)),)], "value string").coalesce(1).write.text(f"{self.path}/_layout")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Shards:
        return cls(**json.loads(spark.read.text(f"{path}/_layout").first()[0]) | {"path": path})


def _slot(index: Column, n: int, key: int) -> Column:
    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(feistel(b.to_numpy(zero_copy_only=False), n, key))

    return run(index)


def _unpacked(batches):
    z = zstandard.ZstdDecompressor()
    for b in batches:
        data = pa.array([z.decompress(x) for x in b.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:2], data], names=["slot", "shard", "record"])


def training_order(docs: DataFrame, key: int = 20240229, length: int = LENGTH, per_shard: int = PER_SHARD, tokenizer: str = DEFAULT_TOKENIZER, end: int = 0, path: str | None = None) -> tuple[Shards, DataFrame]:
    """Write the shards of ``docs`` under ``path`` (a new folder of the shared one if none is given).
    Returns where they lie, and ``slot, length, parts`` of every sequence."""
    spark = docs.sparkSession
    cut = settle(sequences(docs, length, tokenizer, end))
    counts = settle(cut.groupBy("part").agg(F.count(F.lit(1)).alias("n")))  # a row for each task that read documents
    n = counts.agg(F.sum("n")).first()[0] or 0
    shards = Shards(path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", n, length, id_width(tokenizer), per_shard)
    base = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = cut.join(F.broadcast(base), "part").withColumn("slot", _slot(F.col("base") + F.col("seq"), n, key))
    if n:
        of = -(-n // per_shard)
        tasks = min(of, MOST_TASKS)
        shard = F.floor(F.col("slot") / per_shard)
        rows = placed.select("slot", shard.alias("shard"), "packed").repartitionById(tasks, F.floor(F.col("shard") * tasks / of).cast("int"))
        flat = rows.mapInArrow(_unpacked, "slot long, shard long, record binary").sortWithinPartitions("shard", "slot")
        flat = flat.select(F.col("record").cast("string").alias("value"), "shard")
        flat.write.partitionBy("shard").option("lineSep", "\n").text(shards.path)
    shards.save(spark)
    return shards, placed.select("slot", "length", "parts")


def records(spark: SparkSession, shards: Shards, slot: int = 0) -> DataFrame:
    """``slot, shard, byte_offset, length, ids`` of the records from ``slot`` on, each read from its
    place in its shard; earlier shards are not opened. Ids are as they lie there."""
    if not shards.total:
        return spark.createDataFrame([], "slot long, shard long, byte_offset long, length long, ids binary")
    files = spark.read.format("binaryFile").load(shards.path).where(F.col("shard") >= slot // shards.per_shard)
    n = F.floor(F.col("length") / shards.stride)
    each = F.sequence(F.lit(0), (n - 1).cast("int"))
    # bound to a variable, so that the shard is not copied out of its row again for every record
    cut = F.transform(F.array("content"), lambda x: F.transform(each, lambda i: F.substring(x, i * shards.stride + 1, F.lit(shards.stride))))
    rows = files.select(F.col("shard").cast("long").alias("shard"), F.posexplode(cut[0]).alias("position", "record"))
    size = F.conv(F.hex(F.substring("record", 1, _HEAD)), 16, 10).cast("long")
    rows = rows.select(
        (F.col("shard") * shards.per_shard + F.col("position")).alias("slot"), "shard",
        (F.col("position").cast("long") * shards.stride).alias("byte_offset"), size.alias("length"),
        F.substring("record", F.lit(_HEAD + 1), (size * shards.width).cast("int")).alias("ids"),
    )
    return rows.where(F.col("slot") >= slot)


def stream(shards: Shards, slot: int = 0) -> Iterator[np.ndarray]:
    """The ids of each sequence from ``slot`` on, in slot order, by one seek and sequential reads."""
    for shard in range(slot // shards.per_shard, -(-shards.total // shards.per_shard)):
        (file,) = Path(shards.path.removeprefix("file:")).glob(f"shard={shard}/part-*")
        with open(file, "rb") as f:
            f.seek(max(0, slot - shard * shards.per_shard) * shards.stride)
            while record := f.read(shards.stride):
                n = int.from_bytes(record[:_HEAD], "big")
                yield np.frombuffer(record, f"<u{shards.width}", n, _HEAD)


def digest(spark: SparkSession, shards: Shards, index: DataFrame) -> DataFrame:
    """What the shards hold, read back from them: ``slot, shard, byte_offset, length, ids_crc32`` (of
    the ids as they lie there), and from the index ``doc_ids, starts, lengths`` of the documents' pieces."""
    found = records(spark, shards).select("slot", "shard", "byte_offset", "length", F.crc32("ids").alias("ids_crc32"))
    named = index.select("slot", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("starts"), F.col("parts.length").alias("lengths"))
    return found.join(named, "slot")
