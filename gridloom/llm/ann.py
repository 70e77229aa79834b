"""Nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on a sample of at most about ``fit_rows`` vectors (a
documented bound; rows are chosen by a hash of the id) and goes to every task;
every vector of the table is then assigned to a leaf.  A query walks the tree
best-bin-first: a priority queue holds the nodes seen so far by the inner
product of the query with their centroids, the best is opened, and leaves are
visited in the order in which they come out.

How many leaves a query visits is calibrated: for some of the queries the true
neighbours among *all* vectors are found by brute force, and the number of
visits widens until their mean recall reaches ``recall`` (up to all leaves,
where the search is exact).  A query whose leaves hold too few vectors goes on
until they hold ``k`` besides its own, or no leaf is left.

Vectors are stored by ranges of (leaf, hash), so a leaf that holds a third of
all vectors is many tasks.  Each query walks the tree once, on the executors.
Queries then go to the tasks in blocks of about ``query_block``, one block after
the other, so that the driver and a task hold one block; a task keeps the best
``k`` of each query among its rows in the leaves that the query visits, and a
query's lists are merged by a sort, of which each task first keeps ``k`` rows.

The tree does not grow with the table beyond its sample, so a leaf does: the
work of a query is in proportion to the rows of the leaves it visits.

Scores are double-precision sums of products, summed in one fixed order, so
equal vectors have equal scores wherever they are stored.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and those with a null id or of another length than most, take no
part; other columns may have any names; ties go to the smaller id; a row is no
candidate of a query with its own id; an id repeated among the queries is searched once, with the least of its
vectors, and repeated candidates all count; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._common import drop_written, fresh_path, shuffle_partitions, written


class KMeansTree:
    """Nodes by number; ``children[i]`` is empty for a leaf, whose number among leaves is ``leaf[i]``."""

    def __init__(self, x: np.ndarray, branching: int = 12, leaf_size: int = 60, seed: int = 3):
        self.centroids: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.n_leaves = 0
        rng = np.random.default_rng(seed)
        self._build(x, branching, leaf_size, rng, 0)
        self.matrix = [np.stack([self.centroids[c] for c in ch]) if ch else None for ch in self.children]

    def _build(self, x: np.ndarray, branching: int, leaf_size: int, rng: np.random.Generator, depth: int) -> int:
        me = len(self.centroids)
        self.centroids.append(x.mean(axis=0))
        self.children.append([])
        self.leaf.append(-1)
        parts = []
        if len(x) > leaf_size and depth < 12:
            c = x[rng.choice(len(x), min(branching, len(x)), replace=False)]
            for _ in range(8):
                near = self._nearest(x, c)
                c = np.stack([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            near = self._nearest(x, c)
            parts = [x[near == k] for k in range(len(c)) if (near == k).any()]
        if len(parts) > 1:
            for p in parts:
                self.children[me].append(self._build(p, branching, leaf_size, rng, depth + 1))
        else:
            self.leaf[me] = self.n_leaves
            self.n_leaves += 1
        return me

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by descent to the nearest child."""
        out = np.empty(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = self._nearest(x[rows], self.matrix[node])
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def visits(self, q: np.ndarray, limit: int | None = None, sizes: np.ndarray | None = None, need: int = 0) -> list[int]:
        """Leaves, best bin first: ``limit`` of them, and more until they hold ``need`` vectors by the ``sizes`` of leaves."""
        heap, found, held = [(0.0, 0)], [], 0
        while heap and (limit is None or len(found) < limit or held < need):
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for s, child in zip((self.matrix[node] @ q).tolist(), self.children[node]):
                    heapq.heappush(heap, (-s, child))
            else:
                found.append(self.leaf[node])
                held += 0 if sizes is None else int(sizes[self.leaf[node]])
        return found


def _best(ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    s = (x * q).sum(axis=1)
    keep = np.flatnonzero(ids != query_id)
    if len(keep) > 4 * k:
        own = s[keep]
        keep = keep[own >= np.partition(own, len(own) - k)[len(own) - k]]
    top = keep[np.lexsort((ids[keep], -s[keep]))[:k]]
    return ids[top], s[top]


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, e``: the rows that take part, components as doubles."""
    e = F.col(vector_col).cast("array<double>")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), e.alias("e")).where(F.col("id").isNotNull() & F.col("e").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("e", lambda x: x != 0))
    size = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("e") == (size["n"] if size else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.96, fit_rows: int = 20_000, calibration: int = 120, query_block: int = 16_384) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row for which ``is_query`` (over ``id``) holds."""
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = clean(vectors, id_col, vector_col)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    million = 1_000_000
    at = F.pmod(F.xxhash64("id", F.lit("ann")), F.lit(million))
    sample = rows.where(at < int(min(1.0, fit_rows / n) * million) + 1).toPandas().sort_values("id")
    if not len(sample):
        sample = rows.limit(1).toPandas()
    tree = KMeansTree(np.stack(sample.e.to_numpy()).astype(np.float64))
    held = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held.value.assign(x))], names=["id", "e", "leaf"])

    assigned = rows.mapInArrow(assign, "id long, e array<double>, leaf int")
    # ranges of (leaf, id): a task has whole leaves or, of a leaf that is large, an even part
    placed = written(assigned.repartitionByRange(parts, "leaf", F.xxhash64("id")), "ann")
    queries = placed.where(is_query).groupBy("id").agg(F.min("e").alias("e"), F.count("*").alias("own"))
    queries = written(queries.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(max(1, math.ceil(queries.count() / query_block)))).cast("int")), "queries")
    counts = {r.part: r["count"] for r in queries.groupBy("part").count().collect()}  # a row for each block of queries
    if not counts:
        return spark.createDataFrame([], schema)
    limit = _calibrated(placed, queries.select("id", "e"), sum(counts.values()), held, k, recall, calibration)
    sizes = np.zeros(tree.n_leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a row for each leaf
        sizes[r.leaf] = r["count"]

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                leaves = [held.value.visits(q, limit, sizes, k + n) for q, n in zip(x, b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(leaves, pa.list_(pa.int32()))], names=["id", "e", "part", "leaves"])

    # each query walks the tree once
    planned = written(queries.mapInArrow(traverse, "id long, e array<double>, part int, leaves array<int>"), "visits")
    drop_written(queries)
    # the blocks go one after the other: the driver holds the queries of one
    lists = fresh_path(spark, "lists")
    for part in sorted(counts):
        own = planned.where(F.col("part") == part).select("id", "e", "leaves").toPandas()  # about ``query_block`` rows
        leaves = np.concatenate(own.leaves.to_numpy()), np.repeat(np.arange(len(own)), [len(x) for x in own.leaves])
        asked = spark.sparkContext.broadcast((own.id.to_numpy(), np.stack(own.e.to_numpy()).astype(np.float64), *leaves))
        placed.mapInArrow(_searcher(asked, k), "query_id long, ids array<long>, scores array<double>").write.parquet(f"{lists}/part={part}")
        asked.destroy()
    drop_written(planned)
    drop_written(placed)
    hits = spark.read.schema("query_id long, ids array<long>, scores array<double>").parquet(lists).select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("h")).select("query_id", F.col("h.ids").alias("vec_id"), F.col("h.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searcher(asked, k: int):
    """A task's part of the search: the best ``k`` of each query among its rows in leaves that the query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, qx, leaves, of = asked.value
        by = np.argsort(leaves, kind="stable")
        leaves, of = leaves[by], of[by]
        best_s = np.full((len(ids), k), -np.inf)
        best_i = np.full((len(ids), k), np.iinfo(np.int64).max)
        for b in batches:
            if not b.num_rows:
                continue
            vec, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            for number in np.unique(leaf):
                who = of[np.searchsorted(leaves, number) : np.searchsorted(leaves, number, side="right")]
                rows = np.flatnonzero(leaf == number)
                for r in range(0, len(rows), 256) if len(who) else ():
                    part = rows[r : r + 256]
                    for q in range(0, len(who), 256):
                        _merge(best_s, best_i, who[q : q + 256], ids, qx, vec[part], x[part], k)
        some = np.flatnonzero(best_s[:, 0] > -np.inf)
        for start in range(0, len(some), 4096):
            at = some[start : start + 4096]
            n = (best_s[at] > -np.inf).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([best_i[i, :m] for i, m in zip(at, n)], pa.list_(pa.int64())), pa.array([best_s[i, :m] for i, m in zip(at, n)], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    return run


def _merge(best_s: np.ndarray, best_i: np.ndarray, who: np.ndarray, ids: np.ndarray, qx: np.ndarray, vec: np.ndarray, x: np.ndarray, k: int) -> None:
    """Take some vectors into the sorted best lists of the queries ``who``."""
    rough = qx[who] @ x.T
    slack = 1e-9 * (1 + np.abs(rough).max())
    rough[vec[None, :] == ids[who][:, None]] = -np.inf  # a query's own rows
    floor = best_s[who, -1]
    if x.shape[0] > k:
        floor = np.maximum(floor, np.partition(rough, x.shape[0] - k, axis=1)[:, x.shape[0] - k])
    a, b = np.nonzero((rough >= floor[:, None] - slack) & (rough > -np.inf))
    if not len(a):
        return
    exact = np.concatenate([(x[b[i : i + 4096]] * qx[who[a[i : i + 4096]]]).sum(axis=1) for i in range(0, len(a), 4096)])
    touched = np.unique(a)
    old = who[touched]
    q = np.concatenate([np.repeat(old, k), who[a]])
    s = np.concatenate([best_s[old].ravel(), exact])
    i = np.concatenate([best_i[old].ravel(), vec[b]])
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    first = np.searchsorted(q, old)
    take = first[:, None] + np.arange(k)
    best_s[old], best_i[old] = s[take], i[take]


def _calibrated(placed: DataFrame, queries: DataFrame, n_queries: int, held, k: int, recall: float, calibration: int) -> int:
    """The fewest leaves whose visit reaches the mean recall over some queries, against brute force over all vectors."""
    spark = placed.sparkSession
    million = 1_000_000
    share = int(min(1.0, calibration / n_queries) * million) + 1
    some = queries.where(F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(million)) < share).toPandas()
    if not len(some):
        some = queries.limit(1).toPandas()
    asked = spark.sparkContext.broadcast((some.id.to_numpy(), np.stack(some.e.to_numpy()).astype(np.float64)))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, qx = asked.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            place = {int(i): int(v) for i, v in zip(ids, leaf)}
            q, i, s = [], [], []
            for query_id, vector in zip(qs, qx):
                top, score = _best(ids, x, int(query_id), vector, k)
                q += [int(query_id)] * len(top)
                i += top.tolist()
                s += score.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64()), pa.array([place[v] for v in i], pa.int32())], names=["q", "id", "s", "leaf"])

    order = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    truth = placed.mapInArrow(exact, "q long, id long, s double, leaf int").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "leaf").collect()  # k rows of each of the calibration queries
    if not truth:
        return held.value.n_leaves
    rank = {int(i): {leaf: r for r, leaf in enumerate(held.value.visits(v), 1)} for i, v in zip(*asked.value)}
    needed = np.sort([rank[t.q][t.leaf] for t in truth])
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the 20 nearest of every twentieth vector, among all vectors."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


def brute_force(rows: list[tuple], k: int = 20, every: int = 20) -> dict:
    """query id -> [(id, score)] by comparing with all rows; for tests."""
    good = [(i, np.asarray(e, np.float64)) for i, e in rows if i is not None and e is not None and all(c is not None for c in e)]
    good = [(i, e) for i, e in good if np.isfinite(e).all() and e.any()]
    ids, x = np.array([i for i, _ in good]), np.stack([e for _, e in good])
    return {int(i): [(int(a), float(s)) for a, s in zip(*_best(ids, x, int(i), q, k))] for i, q in zip(ids, x) if i % every == 0}
