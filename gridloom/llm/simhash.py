"""SimHash near-duplicate groups with a Gray-order hierarchical index.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles.
Two texts are linked if their fingerprints differ in at most ``max_bits`` bits;
the result is the connected component of each document.

Finding the links:

1. Equal fingerprints become one node (an aggregate with map-side combine), so
   a group of exact copies, however large, is one row from here on.
2. *Upper nodes* are shared masked patterns.  The root fixes no bit.  A node
   with more than ``NODE`` members is replaced by finer ones: the bits it does
   not fix are cut into ``max_bits + 1`` blocks, and each child also fixes one
   of these, because two fingerprints within ``max_bits`` bits agree on one
   block at least.  So hot patterns are split by more bits, only as many copies
   are made as a node has children, and no link is missed.  (Nodes that are
   still larger after ``DEPTH`` levels are dealt in chunks, a task for each pair
   of chunks.)
3. Under an upper node the fingerprints are sorted by Gray rank, in which
   neighbours share many bits.  Runs of 2, 8, 32 ... of them are the inner
   nodes, each with the mask and pattern of the bits that all its members
   share.  A search goes down with the differences added up so far (each level
   counts only bits that no level above has counted) and prunes a whole group
   as soon as they exceed ``max_bits``, or when it is known to be of the
   searcher's component already.
4. Each task emits a spanning star of the links it has found rather than all
   pairs; the stars meet in :func:`gridloom.llm.components.connected_components`.

Defined cases: null, empty and word-free texts have fingerprint zero and are
linked like any other; a null id takes part and never becomes a component id
unless all ids of its component are null; repeated rows stay; only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import drop_written, shuffle_partitions, written
from gridloom.llm.components import connected_components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Members of an upper node from which it is split, how often, and how many a task takes of one that cannot be split.
NODE, DEPTH, CHUNK = 4096, 5, 65_536
#: Pairs of a searcher and an inner node that a task looks at together.
_FRONTIER = 400_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The text's SimHash as an unsigned 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    line = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(line, seed)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a : b - 1], seed) for a, b in zip(starts, starts[shingle:])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        part = hashes[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``id, fp`` (the fingerprint as a signed long) of each row."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("fp"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, fp long"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return base.mapInArrow(hashed, schema)


def _blocks(free: int, n: int) -> list[int]:
    """Masks of ``n`` blocks of about equally many of the bits of ``free``, from high to low."""
    bits = [1 << i for i in range(63, -1, -1) if free >> i & 1]
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence."""
    x = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class _Forest:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[x]
        while True:
            up = p[r]
            if (up == r).all():
                p[x] = r
                return r
            r = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the trees of each pair; a root is always the smallest of its tree."""
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])


class GrayIndex:
    """Inner nodes over the members of some upper nodes.

    ``codes`` are uint64, distinct within an upper node, and ordered by upper
    node and Gray rank; ``starts`` has where each upper node begins, and the end.
    ``pruned`` counts the pairs of a searcher and a group below which nothing
    was looked at because the differences were too many.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        self.codes, self.pruned = codes, 0
        n = len(codes)
        place = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
        largest = int(np.diff(starts).max(initial=0))
        #: From the members up: (first member, one past the last, mask, pattern, first node below).
        self.levels = [(np.arange(n), np.arange(1, n + 1), np.full(n, np.uint64(2**64 - 1)), codes, None)]
        width = 2
        while True:
            at = np.flatnonzero(place % width == 0)
            every, some = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
            mask = ~(every ^ some)
            below = np.searchsorted(self.levels[-1][0], at)
            self.levels.append((at, np.r_[at[1:], n], mask, every & mask, np.r_[below, len(self.levels[-1][0])]))
            if width >= largest:
                return
            width *= 4

    def components(self, max_bits: int) -> np.ndarray:
        """For each member the first member of its linked group."""
        n = len(self.codes)
        forest = _Forest(n)
        top = np.searchsorted(self.levels[-1][0], np.arange(n), side="right") - 1
        step = max(16, min(n, _FRONTIER // max(1, int((self.levels[-1][1] - self.levels[-1][0]).max(initial=1)))))
        own, same, changed = np.arange(n), None, True
        for a in range(0, n, step):
            if changed:  # the component of each node's members, or -1 where they have several
                own = forest.find(np.arange(n))
                same = []
                for first, *_ in self.levels:
                    low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
                    same.append(np.where(low == high, low, -1))
            q = np.arange(a, min(n, a + step))
            i, j = self._search(q, top[q], max_bits, own, same)
            changed = len(i) > 0
            forest.unite(i, j)
        return forest.find(np.arange(n))

    def _search(self, q: np.ndarray, node: np.ndarray, max_bits: int, own: np.ndarray, same: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Links of the searchers ``q`` to later members, from the nodes of the top level down."""
        mask, pattern = self.levels[-1][2], self.levels[-1][3]
        total = np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node])
        for depth in range(len(self.levels) - 1, 0, -1):
            above, below = self.levels[depth], self.levels[depth - 1]
            first = above[4][node]
            width = above[4][node + 1] - first
            up = np.repeat(np.arange(len(q)), width)
            child = np.arange(len(up)) - np.repeat(np.cumsum(width) - width, width) + first[up]
            ahead = (below[1][child] > q[up] + 1) & (same[depth - 1][child] != own[q[up]])
            up, child = up[ahead], child[ahead]
            added = (self.codes[q[up]] ^ below[3][child]) & below[2][child] & ~above[2][node[up]]
            sums = total[up] + np.bitwise_count(added)
            near = sums <= max_bits
            self.pruned += int(len(near) - near.sum()) if depth > 1 else 0
            q, node, total = q[up[near]], child[near], sums[near]
        return q, node


def _upper_nodes(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``t, p, s, fp``: each fingerprint under its upper nodes (mask ``t``, pattern ``p``); ``s`` chunks where a node is too large."""
    spark = nodes.sparkSession
    masks = {1: 0}
    level = nodes.select(F.lit(1).alias("t"), F.lit(0).cast("long").alias("p"), "fp")
    done = None
    for depth in range(DEPTH + 1):
        large = written(level.groupBy("t", "p").count().where(F.col("count") > (NODE if depth < DEPTH else CHUNK)), "roots")
        some = large.groupBy("t").count().select("t").collect()  # a row for each mask
        whole = (level.join(large, ["t", "p"], "left_anti") if some else level).select("t", "p", F.lit(1).alias("s"), "fp")
        done = whole if done is None else done.unionByName(whole)
        if not some:
            break
        rest = level.join(large, ["t", "p"])
        if depth == DEPTH:
            done = done.unionByName(rest.select("t", "p", F.ceil(F.col("count") / CHUNK).cast("int").alias("s"), "fp"))
            break
        finer = [(r.t, r.t * 8 + c, _signed(masks[r.t] | b)) for r in some for c, b in enumerate(_blocks(~masks[r.t] & (2**64 - 1), max_bits + 1))]
        masks = {t: m & (2**64 - 1) for _, t, m in finer}
        to = spark.createDataFrame(finer, "t int, child int, mask long")
        level = rest.join(F.broadcast(to), "t").select(F.col("child").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("p"), "fp")
    return done


def links(nodes: DataFrame, max_bits: int = MAX_BITS, pruned: Accumulator | None = None) -> DataFrame:
    """``u, v``: links that connect every two of the distinct longs ``fp`` within ``max_bits`` bits.

    ``pruned``, if given, is increased by the number of groups that searches have pruned.
    """
    parts = shuffle_partitions(nodes.sparkSession)
    placed = _upper_nodes(nodes, max_bits).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    others = F.when(F.col("s") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("s") - 1), lambda o: o != F.col("c")))
    dealt = placed.withColumn("o", F.explode(others)).select("t", "p", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    dealt = dealt.repartition(parts, "t", "p", "i", "j").sortWithinPartitions("t", "p", "i", "j")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            a = np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(5)])
            if held is not None:
                a = np.concatenate([held, a], axis=1)
            new = np.flatnonzero((np.diff(a[:4], axis=1) != 0).any(axis=0)) + 1
            if not len(new):
                held = a
                continue
            held = a[:, new[-1] :]
            yield from emit(a[4, : new[-1]], new)
        if held is not None and held.shape[1]:
            yield from emit(held[4], np.array([held.shape[1]]))

    def emit(fp: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.r_[0, ends]
        codes = fp.view(np.uint64)
        codes = codes[np.lexsort((gray_rank(codes), np.repeat(np.arange(len(ends)), np.diff(starts))))]
        index = GrayIndex(codes, starts)
        root = index.components(max_bits)
        if pruned is not None:
            pruned.add(index.pruned)
        apart = np.flatnonzero(root != np.arange(len(codes)))
        if len(apart):
            yield pa.RecordBatch.from_arrays([pa.array(codes[apart].view(np.int64)), pa.array(codes[root[apart]].view(np.int64))], names=["u", "v"])

    return dealt.mapInArrow(stars, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED, pruned: Accumulator | None = None) -> DataFrame:
    """``id_col, fingerprint, component_id`` for each row of ``docs``; ``pruned`` as for :func:`links`."""
    own = written(fingerprints(docs, id_col, text_col, shingle, seed), "fp")
    nodes = written(own.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    linked = written(links(nodes.select("fp"), max_bits, pruned), "links")
    comp = written(connected_components(linked), "comp")
    drop_written(linked)
    tagged = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = written(tagged.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = written(tagged.join(least, "root").select("fp", "component_id"), "named")
    for gone in (nodes, comp, least):
        drop_written(gone)
    out = own.join(named, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: near-duplicate groups of the whole documents table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple], shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> dict:
    """id -> (fingerprint, component id) by comparing all pairs; for tests, with distinct ids."""
    fps = [(i, fingerprint(t, shingle)) for i, t in rows]
    group = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for a, x in fps:
            for b, y in fps:
                if (x ^ y).bit_count() <= max_bits and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {i: (f"{x:016x}", group[i]) for i, x in fps}
