"""Best-fit packing of tokenised documents by linear grouping.

Only the number of pieces of each length matters to a packing, and there are at
most ``capacity`` lengths, so the plan is made from a histogram whose size does
not depend on the corpus:

1. pieces longer than ``small`` are large; those of them that can share a
   sequence with another large one are cut into groups of about equal
   cardinality by descending length, and each is rounded up to its group's
   longest (large ones that cannot share need no rounding: each opens a
   sequence),
2. the few sizes give a configuration linear program (fewest sequences), solved
   to the optimum by column generation with a knapsack; whole numbers of its
   sequences are kept,
3. actual lengths take the places of the rounded ones, in the last place of a
   sequence the longest that fits what the others really leave; what is still
   free counts as free,
4. what is left of the large ones, then the small ones, go best-fit in
   descending order into the sequences with the least room that suffices.

The plan is a run-length list: (lengths, number of sequences with
exactly those lengths).  A piece finds its place from its length and its rank
among the pieces of that length, which come from per-task counts, so no task
ever holds all pieces of a length.

Defined cases: a null text is empty (the end id alone); repeated rows and null
ids are packed like any other; an empty table gives no rows; only id and text
columns are read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._common import written
from gridloom.llm.tokens import CachedEncoder

CAPACITY, END_ID = 1024, 2

Run = tuple[tuple[int, ...], int]  # (lengths, sequences)


class _Open:
    """Sequences that still have room, as runs by free room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[Run]] = defaultdict(list)

    def add(self, lengths: tuple[int, ...], count: int) -> None:
        if count:
            self.by_room[self.capacity - sum(lengths)].append((lengths, count))

    def best_fit(self, length: int, n: int) -> None:
        """Place ``n`` pieces of one length, each where the least room that suffices is left."""
        rooms = sorted(r for r, runs in self.by_room.items() if runs and r >= length)
        heapq.heapify(rooms)
        while n:
            if not rooms:
                each = self.capacity // length
                if n >= each:
                    self.add((length,) * each, n // each)
                self.add((length,) * (n % each), 1 if n % each else 0)
                return
            room = heapq.heappop(rooms)
            each = room // length
            for lengths, count in self.by_room.pop(room):
                whole = min(count, n // each)
                self.add(lengths + (length,) * each, whole)
                n -= whole * each
                rest = count - whole
                if rest and n:
                    self.add(lengths + (length,) * n, 1)
                    n, rest = 0, rest - 1
                self.add(lengths, rest)

    def runs(self) -> list[Run]:
        return [run for runs in self.by_room.values() for run in runs]


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Plain best-fit decreasing: a yardstick for tests."""
    room = _Open(capacity)
    for length in sorted(counts, reverse=True):
        room.best_fit(length, counts[length])
    return room.runs()


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """A basic optimum of: fewest sequences of at most ``capacity`` that hold ``demand`` pieces of each size (descending)."""
    g = len(sizes)
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag([float(capacity // x) for x in sizes])
    inverse = np.linalg.inv(basis)
    steps = 0
    while True:
        price = inverse.sum(axis=0)
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for w in range(int(s[-1]), capacity + 1):
            k = int(np.searchsorted(-s, -w))  # the sizes from here on fit
            value = best[w - s[k:]] + price[k:]
            j = int(value.argmax())
            if value[j] > best[w - 1] + 1e-12:
                best[w], last[w] = value[j], k + j
            else:
                best[w] = best[w - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, w = np.zeros(g), capacity
        while w > 0:
            if last[w] < 0:
                w -= 1
                continue
            column[last[w]] += 1
            w -= s[last[w]]
        x, step = inverse @ d, inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        steps += 1
        if steps % 100:  # exchange one column
            inverse[out] /= step[out]
            rest = np.arange(g) != out
            inverse[rest] -= np.outer(step[rest], inverse[out])
        else:
            inverse = np.linalg.inv(basis)
    x = np.linalg.solve(basis, d)
    return [(basis[:, j].astype(int), float(x[j])) for j in range(g) if x[j] >= 1]


def linear_grouping(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 160, small: int | None = None) -> list[Run]:
    """The plan: runs of (lengths, sequences with these lengths)."""
    small = capacity * 43 // 100 if small is None else small
    left = Counter({k: v for k, v in counts.items() if v})
    room = _Open(capacity)
    large = sorted(k for k in left if k > small)
    for length in [k for k in large if k > capacity - large[0]]:
        room.add((length,), left.pop(length))
        large.remove(length)
    if large:
        per, seen = math.ceil(sum(left[k] for k in large) / groups), 0
        sizes: list[int] = []
        demand: list[int] = []
        for length in reversed(large):
            if not sizes or seen >= per * len(sizes):
                sizes.append(length)
                demand.append(0)
            demand[-1] += left[length]
            seen += left[length]
        for config, x in _configurations(sizes, demand, capacity):
            slots = [sizes[j] for j, k in enumerate(config) for _ in range(k)]
            wanted = math.floor(x + 1e-9)
            while wanted:
                used: Counter = Counter()
                free = capacity
                for i, size in enumerate(slots):
                    at = bisect_right(large, free if i == len(slots) - 1 else size)
                    while at and left[large[at - 1]] <= used[large[at - 1]]:
                        at -= 1
                    if not at:
                        break
                    used[large[at - 1]] += 1
                    free -= large[at - 1]
                else:
                    times = min([wanted, *(left[k] // n for k, n in used.items())])
                    room.add(tuple(sorted(used.elements(), reverse=True)), times)
                    for k, n in used.items():
                        left[k] -= n * times
                    large = [k for k in large if left[k]]
                    wanted -= times
                    continue
                break
    for length in sorted((k for k, v in left.items() if v), reverse=True):
        room.best_fit(length, left[length])
    return room.runs()


def places(runs: list[Run]) -> dict[int, np.ndarray]:
    """Length -> rows (first rank, first sequence, offset), by rank: where the pieces of that length go."""
    used: Counter = Counter()
    out: dict[int, list] = defaultdict(list)
    sequence = 0
    for lengths, n in runs:
        at = 0
        for length in lengths:
            out[length].append((used[length], sequence, at))
            used[length] += n
            at += length
        sequence += n
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32, task, rank[, ids]``: each document's pieces.

    ``rank`` counts a task's pieces of one length.  ``ids`` are little-endian unsigned 32-bit.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder = CachedEncoder(tokenizer_path)
        rank = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            source = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.ids(text).astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                n = len(ids) // 4
                at, number = 0, 0
                while at < n:
                    length = (n % capacity or capacity) if at == 0 else capacity
                    own = ids[4 * at : 4 * (at + length)]
                    rows.append((number, at, length, zlib.crc32(own), task, rank[length], *([own] if with_ids else [])))
                    source.append(k)
                    rank[length] += 1
                    at += length
                    number += 1
            if not rows:
                continue
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if with_ids else [])]
            names = ["id", "piece", "start", "length", "ids_crc32", "task", "rank", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source)), *(pa.array(c, kind) for c, kind in zip(zip(*rows), kinds))], names=names)

    return base.mapInArrow(cut, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]`` of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, tokenizer_path, capacity, end_id, with_ids), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {int(r.length): int(r.n) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    held = spark.sparkContext.broadcast(places(linear_grouping(counts, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).select("task", "length", "first")
    ranked = cut.join(first, ["task", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"), *(["ids"] if with_ids else []))
    names = [f.name for f in ranked.schema if f.name != "rank"]
    schema = ", ".join(f"{n} {ranked.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.names.index("length")).to_numpy()
            rank = batch.column(batch.schema.names.index("rank")).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                rows = held.value[int(n)]
                at = np.searchsorted(rows[:, 0], rank[own], side="right") - 1
                sequence[own] = rows[at, 1] + rank[own] - rows[at, 0]
                offset[own] = rows[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from :func:`pack` with ``with_ids``: the token ids of each full sequence.

    A group has at most ``capacity`` rows.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the whole documents table in sequences of at most 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
