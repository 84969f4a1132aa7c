"""N-gram Jaccard join: prefix-tree similarity self-join over word shingles.

1. Each text becomes a set of shingle hashes; equal sets are one class (exact copies never meet
   pairwise).
2. A global order puts shingles of many documents last. By the prefix principle two sets with
   Jaccard >= t share l of their first ``n - ceil(t n) + l`` shingles, so only those are dealt out.
   Shingles without another class of fitting size drop out, and so does a class that keeps fewer
   than l: what shares a line or a passage with others but is not near to any goes here.
3. Classes that share such a shingle form a block. Within it, sets are laid in a trie (shared
   runs of shingles are one path); a probe walks it once, keeps the overlap of a path for all that
   hang from it, and drops a subtree once the shingles that remain cannot reach the threshold. Paths
   of one trie begin with the shingles that most of its sets have, so that they share as much as can
   be; sketches tell before which classes of a block have any set near enough to be laid in it.
4. Links are closed into components. Blocks that are already one component need no more work, so
   a large group of near copies costs a star, not all its pairs; every other block is searched in
   full, in pieces of ``PIECE`` classes, whichever size it has.

Defined results: null, empty or wordless text has n_shingles 0 and its own doc_id as component; a
repeated row is returned as often as it came; a null doc_id stays null and is ignored as the name
of a component unless it is the only one; an empty table gives no rows. Set equality and overlap
are on 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_table, components, discard, settle, share, shingle_set, sift, small_batches

#: classes of a block in one task, and shingles of theirs, about; larger blocks are searched piece
#: against piece
PIECE = 256
PIECE_SHINGLES = 1 << 21
#: shingles kept in the table of common ones, which orders shingles and decides nothing else
COMMON_ROWS = 1 << 20
#: ranges of hashes that a sketch counts, a power of two
SKETCH = 512
#: blocks that a class names as its first; two classes are compared in the first that both name
FIRSTS = 16
#: share of its size that a class must have in shared shingles beyond the first, l = 1 + SPARE * n
SPARE = 0.03
#: bits of the filter for texts that need a second look: 16 a class, within these bounds; false hits
#: only cost volume
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def _common(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles of many documents, commonest last. Counts cover all documents: each task
    sums what it met at least twice, the sums are added, and the commonest COMMON_ROWS remain."""

    def count(batches):
        held, size = [], 0

        def flush():
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                keep = n > 1
                held.clear()
                for i in range(0, int(keep.sum()), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(h[keep][i : i + 100_000].view(np.int64)), pa.array(n[keep][i : i + 100_000].astype(np.int64))], names=["h", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                s = shingle_set(t, k)
                held.append(s)
                size += len(s)
                if size > 4_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    sums = settle(docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 4"))
    scale = {r[0]: r[1] for r in sums.groupBy(F.floor(F.log2("n") * 4).cast("int")).count().collect()}
    floor, total = max(scale, default=0) + 1, 0
    for level in sorted(scale, reverse=True):
        total += scale[level]
        if total > COMMON_ROWS:
            break
        floor = level
    got = sums.where(F.floor(F.log2("n") * 4) >= floor).orderBy("n", "h").select("h").toArrow()
    discard(sums)
    return got.column(0).to_numpy().view(np.uint64)


def _ordered(s: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in global order: by hash, common shingles last, commonest at the end."""
    if not len(common) or not len(s):
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    hot = common[at] == s
    if not hot.any():
        return s
    hs = s[hot]
    return np.concatenate([s[~hot], hs[np.argsort(rank[at[hot]], kind="stable")]])


def needed(a: int, b: int, num: int, den: int) -> int:
    """Least overlap o of sets of a and b with den * o >= num * (a + b - o)."""
    return -(-num * (a + b) // (num + den))


def trie_links(sets: list[np.ndarray], side: np.ndarray | None, comp: list, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the components ``comp`` of the sets: a spanning forest of all links.

    The trie is laid out as its sets in path order; ``lcp`` is the depth at which a set leaves the
    one before it. With ``side``, only sets of different sides are compared.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, inv, n = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
    paths = [np.sort(p) for p in np.split(rank[inv], np.cumsum(size)[:-1])]
    order = sorted(range(m), key=lambda i: paths[i].astype(">u4").tobytes())
    paths, size = [paths[i] for i in order], size[order]
    lcp = np.zeros(m, np.int64)
    for i in range(1, m):
        c = min(size[i], size[i - 1])
        d = np.flatnonzero(paths[i][:c] != paths[i - 1][:c])
        lcp[i] = d[0] if len(d) else c
    names = {}
    label = np.array([names.setdefault(comp[i], len(names)) for i in order])
    sides = None if side is None else np.asarray(side)[order]
    out = []
    mark = np.zeros(len(n), bool)
    for j in range(1, m):
        near = (den * np.minimum(size[:j], size[j]) >= num * np.maximum(size[:j], size[j])) & (label[:j] != label[j])
        if sides is not None:
            near &= sides[:j] != sides[j]
        if not near.any():
            continue
        mark[paths[j]] = True
        cum, depth, cut = np.zeros(1, np.int64), 0, -1
        last = -1
        for i in np.flatnonzero(near):
            if label[i] == label[j]:
                continue
            # what is still shared with the path walked last
            shared = int(lcp[last + 1 : i + 1].min()) if last >= 0 else 0
            if cut >= 0 and shared >= cut:
                continue  # hangs from a subtree already dropped
            depth = min(depth, shared)
            want = needed(int(size[i]), int(size[j]), num, den)
            have = int(cum[depth])
            last, cut = i, -1
            if have + min(int(size[i]) - depth, int(size[j]) - have) < want:
                # every set below this node with this little left fails too when none is longer
                cum = cum[: depth + 1]
                continue
            cum = np.concatenate([cum[: depth + 1], have + np.cumsum(mark[paths[i][depth:]])])
            depth = int(size[i])
            if int(cum[depth]) >= want:
                out.append((order[i], order[j]))
                label[label == label[j]] = label[i]
            else:
                # overlap lost so far, against the most that any set near in size could allow
                lost = np.arange(depth + 1) - cum
                most = int(size[j]) * den // num - needed(int(size[j]) * den // num, int(size[j]), num, den)
                dead = np.flatnonzero(lost > most)
                cut = int(dead[0]) if len(dead) else -1
        mark[paths[j]] = False
    return out


def _search(members: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """What links within each group of ``members(keys..., node, comp, side, shingles)`` make of its
    components: ``comp, into`` for each that joins a smaller one."""

    def join(table):
        comp = table.column("comp").to_pylist()
        into = {}
        if len(comp) > 1:
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            side = table.column("side").to_numpy()

            def root(c):
                while c in into:
                    c = into[c]
                return c

            for i, j in trie_links(sets, side if len(set(side.tolist())) > 1 else None, comp, num, den):
                x, y = root(comp[i]), root(comp[j])
                if x != y:
                    into[max(x, y)] = min(x, y)
            into = {c: root(c) for c in into}
        return pa.table({"comp": pa.array(list(into), pa.int64()), "into": pa.array(list(into.values()), pa.int64())})

    return members.groupBy(*keys).applyInArrow(join, "comp long, into long")


def _promising(members: DataFrame, num: int, den: int) -> DataFrame:
    """Of ``members(tok, x, y, node, comp, side, sketch, firsts)`` those that have a partner of another
    component which they may link with. A sketch counts the shingles of each of SKETCH ranges of hashes:
    the sum of the smaller counts of two sketches is at least the overlap, so nothing that links is lost.
    Classes that both name an earlier block than this one among their first are compared there."""

    def sift(table):
        m = table.num_rows
        comp, side = table.column("comp").to_numpy(), table.column("side").to_numpy()
        keep = np.zeros(m, bool)
        if m > 1:
            tok, across = table.column("tok")[0].as_py(), table.column("x")[0].as_py() != table.column("y")[0].as_py()
            h = np.stack([np.frombuffer(x, np.uint16 if len(x) == 2 * SKETCH else np.uint32).astype(np.int32) for x in table.column("sketch").to_pylist()])
            n = h.sum(1)
            firsts = np.full((m, FIRSTS), tok)
            for i, x in enumerate(table.column("firsts").to_pylist()):
                firsts[i, : len(x)] = x
            for i in range(m - 1):
                j = np.flatnonzero((comp[i + 1 :] != comp[i]) & (den * np.minimum(n[i + 1 :], n[i]) >= num * np.maximum(n[i + 1 :], n[i]))) + i + 1
                if across:
                    j = j[side[j] != side[i]]
                if len(j):
                    most = np.minimum(h[j], h[i]).sum(1)
                    good = j[(num + den) * most >= num * (n[j] + n[i])]
                    good = good[~np.isin(firsts[good], firsts[i][firsts[i] < tok]).any(1)]
                    if len(good):
                        keep[i] = True
                        keep[good] = True
        return table.select(["tok", "x", "y", "node", "comp", "side"]).filter(pa.array(keep))

    return members.groupBy("tok", "x", "y").applyInArrow(sift, "tok long, x int, y int, node long, comp long, side int")


def _relabel(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """``rows`` with ``comp`` replaced where ``moved`` says so."""
    return rows.join(moved, "comp", "left").withColumn("comp", F.coalesce("into", "comp")).drop("into")


def _pieces(classes: Column, shingles: Column) -> Column:
    """Over how many pieces a block of so many classes and shingles is dealt."""
    return F.ceil(F.greatest(classes / PIECE, shingles / PIECE_SHINGLES)).cast("int")


def ngram_jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: documents whose sets of k-word shingles
    have den * |intersection| >= num * |union| are linked; component_id is the smallest doc_id
    reachable by links."""
    return _labelled(docs, k, num, den).drop("text_hash", "comp")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: the smallest ``(doc_id, hash of the text)``, a null
    doc_id last; of rows equal in both any one. Rows without words are linked with nothing and stay,
    repeated ones too. Other texts than those that may go move nowhere."""
    cols, last = docs.columns, F.lit((1 << 63) - 1)
    key = ["__kindred_id", "__kindred_hash"]
    rows = _labelled(docs, k, num, den).where("n_shingles > 0")
    groups = settle(rows.select("comp", F.coalesce("doc_id", last).alias(key[0]), F.col("text_hash").alias(key[1])))
    first = groups.groupBy("comp").agg(F.min(F.struct(*key)).alias("x")).select("x.*")
    several = groups.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    gone = settle(several.join(first.withColumn("stays", F.lit(True)), key, "left").where("stays is null or n > 1").select(*key, F.coalesce("stays", F.lit(False)).alias("stays")))
    tagged = docs.withColumns({key[0]: F.coalesce(F.col("doc_id").cast("long"), last), key[1]: F.xxhash64("text")})
    some, rest = sift(tagged, gone, *key)
    out = some.join(gone.hint("merge"), key, "left_anti").select(*cols).unionByName(rest.select(*cols))
    repeated = gone.where("stays").select(*key)
    if repeated.isEmpty():
        return out
    return out.unionByName(some.join(repeated.hint("merge"), key, "left_semi").dropDuplicates(key).select(*cols))


def _labelled(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id`` for each row, and ``comp``, which tells components
    apart even where a repeated doc_id gives two of them one name."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    by_count = _common(docs, k)
    by_hash = np.argsort(by_count)
    common = share(spark, (by_count[by_hash], by_hash))  # at most 16 MB

    def sign(batches):
        hashes, rank = common.value
        for b in batches:
            n, key, pre = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, k)
                n.append(len(s))
                key.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                pre.append(_ordered(s, hashes, rank)[: len(s) - -(-num * len(s) // den) + 1 + int(SPARE * len(s))].view(np.int64) if len(s) else [])
            made = [pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(pre, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *made], names=["doc_id", "text_hash", "n", "node", "pre"])

    read = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    signed = settle(read.mapInArrow(sign, "doc_id long, text_hash long, n long, node long, pre array<long>"))
    classes = signed.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("pre").alias("pre"))
    # core: within the prefix for one shared shingle; l more follow
    core = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * num / den)
    band = F.floor(F.log("n") / float(np.log(den / num) * (1 + 1e-9) or 1)).cast("int")
    dealt = classes.select("node", "n", F.posexplode("pre").alias("pos", "tok")).select("tok", "node", F.col("n").cast("int").alias("n"), core.alias("core"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)))
    shared = dealt.groupBy("tok").agg(F.count(F.lit(1)).alias("m"), F.bit_or(bit(band)).alias("bands")).where("m > 1")
    # another class in a band next to its own, or some band with two
    fits = (F.col("bands").bitwiseAND(bit(band - 1).bitwiseOR(bit(band + 1))) != 0) | (F.col("m") > F.bit_count("bands"))
    near = dealt.join(shared, "tok").where(fits).select("tok", "node", "n", "core", "m")
    near = settle(near)
    enough = near.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).where(F.col("c") >= 1 + F.floor(F.floor(F.col("n") * num / den) * SPARE)).select("node")
    rows = settle(near.where("core").join(enough, "node", "left_semi").select("tok", "node", "m", "n"))
    discard(near)

    # First the largest block of each class: joins most of what belongs together. A class is in one
    # piece of one block, so what a piece finds needs no closing over pieces.
    home = rows.groupBy("node").agg(F.max(F.struct("m", "tok", "n")).alias("x")).select("node", "x.tok", "x.n")
    size = home.groupBy("tok").agg(F.count(F.lit(1)).alias("c"), _pieces(F.count(F.lit(1)), F.sum("n")).alias("p")).where("c > 1").select("tok", "p")
    home = home.drop("n")
    placed = settle(home.join(size, "tok").withColumn("comp", F.col("node")))
    # sets bring their block along, so that they need not move once more to meet it
    sets = settle(_sets(docs, rows.select("node").distinct().join(placed, "node", "left"), k))
    moved = []

    def meet(part: DataFrame) -> None:
        piece = F.pmod(F.xxhash64("node", F.lit(len(moved))), F.col("p")).alias("piece")
        moved.append(settle(_search(part.select("tok", piece, "node", "comp", F.lit(0).alias("side"), "shingles"), ["tok", "piece"], num, den)))

    meet(sets.where("tok is not null"))
    # Then one class of each component of a block of several pieces, so that its pieces meet.
    wide = placed.where("p > 1")
    if not wide.isEmpty():
        tops = _relabel(wide, moved[0]).groupBy("tok", "comp").agg(F.min("node").alias("node"))
        tops = tops.join(rows.select("tok", "node", "n"), ["tok", "node"])
        several = tops.groupBy("tok").agg(F.count(F.lit(1)).alias("c"), _pieces(F.count(F.lit(1)), F.sum("n")).alias("p")).where("c > 1")
        tops = settle(tops.drop("n").join(several.drop("c"), "tok"))
        meet(tops.join(sift(sets, tops, "node")[0].select("node", "shingles"), "node"))
        discard(tops)

    # Last, in full, each block that still holds several components; equal blocks once. Piece goes
    # against piece, so a block of any size is searched whole by tasks of bounded size. Pieces of the
    # main component of a block meet the others only: within it there is nothing to find.
    left = rows.withColumn("comp", F.col("node"))
    for m in moved:
        left = _relabel(left, m)
    left = settle(left)
    open_ = (
        left.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
        .groupBy("tok").agg(F.max(F.struct("c", "comp", "w")).alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.sum("s").alias("s"))
        .where("lo <> hi").groupBy("c", "w", "s", "lo", "hi", "top").agg(F.min("tok").alias("tok"))
        .select("tok", F.col("top.comp").alias("main"), _pieces(F.col("top.c"), F.col("top.w")).alias("p"), _pieces(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("q"))
    )
    in_main = F.col("comp") == F.col("main")
    mine = settle(left.join(open_, "tok").withColumn("mine", F.when(in_main, F.pmod(F.xxhash64("node"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), F.col("q"))).cast("int")))
    # a class is in no more blocks than its own prefix has shingles
    firsts = mine.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("tok")), 1, FIRSTS).alias("firsts"))
    spread = mine.withColumn("other", F.explode(F.sequence(F.when(in_main, F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)))
    spread = spread.select("tok", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "node", "comp", F.col("mine").alias("side"))
    hopeful = settle(_promising(spread.join(sets.select("node", "sketch").join(firsts, "node"), "node"), num, den))
    links = settle(_search(hopeful.join(sift(sets, hopeful, "node")[0].select("node", "shingles"), "node"), ["tok", "x", "y"], num, den))
    closed = components(links.select(F.col("comp").alias("a"), F.col("into").alias("b")))

    labelled = signed.select("doc_id", "text_hash", "n", "node", F.col("node").alias("comp"))
    for m in [*moved, closed.select(F.col("node").alias("comp"), F.col("comp").alias("into"))]:
        labelled = _relabel(labelled, m)
    discard(rows, sets, placed, left, mine, hopeful, links)
    least = labelled.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "comp", "left").select("doc_id", "text_hash", "comp", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _sets(docs: DataFrame, homes: DataFrame, k: int) -> DataFrame:
    """``node, shingles, sketch`` of the classes in ``homes(node, tok, p, comp)``, and what it says of
    them. Texts are read again; a bit filter keeps those of no such class out of the shuffle."""
    homes = settle(homes)
    bits = min(max(LEAST_BITS, 1 << (16 * homes.count()).bit_length()), MOST_BITS)
    slot = F.pmod(F.xxhash64("node"), F.lit(bits))
    wanted = share(docs.sparkSession, bit_table(homes.select(slot.alias("s")), bits))  # bits / 4 bytes

    def gather(batches):
        table, seen = wanted.value, set()
        for b in batches:
            key, data, sketch = [], [], []
            if len(seen) > 200_000:
                seen.clear()
            for t in b.column(0).to_pylist():
                s = shingle_set(t, k)
                if not len(s):
                    continue
                raw = s.tobytes()
                node = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                at = _spark_slot(node, bits)
                if int(table[at // 32]) >> (at % 32) & 1 and node not in seen:
                    seen.add(node)  # exact copies in this task need not be sent again
                    key.append(node)
                    data.append(raw)
                    h = np.bincount((s >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH)
                    sketch.append(h.astype(np.uint16 if h.max() < 65536 else np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(data, pa.binary()), pa.array(sketch, pa.binary())], names=["node", "shingles", "sketch"])

    found = docs.select("text").mapInArrow(gather, "node long, shingles binary, sketch binary")
    return found.join(homes, "node").groupBy("node").agg(*(F.first(c).alias(c) for c in ("shingles", "sketch", "tok", "p", "comp")))


def _spark_slot(node: int, bits: int) -> int:
    """pmod(xxhash64(long), bits) as Spark's function computes it (seed 42)."""
    h = xxhash.xxh64_intdigest(node.to_bytes(8, "little", signed=True), seed=42)
    return h % bits  # a power of two: the same for either sign
