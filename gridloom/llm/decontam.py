"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

A benchmark item is cut into windows of 13 consecutive words (an item of fewer
words is one shorter window).  Windows of one length form one Wu-Manber
searcher whose symbols are words:

* the *shift table* maps each block of two adjacent words (by the low bits of
  its XXH3 hash, so it is an array of fixed size) to the least distance from
  such a block's place in any pattern to the pattern's end; a block that is in
  no pattern lets the search skip ``length - 1`` words,
* a block with shift zero selects a *bucket* of patterns by the hash of that
  suffix and of the whole window, by binary search in a sorted array,
* a *direct comparison* with the pattern's text confirms the occurrence.

The benchmark never meets the driver as a whole.  Executors build searchers of
``block_bytes`` of benchmark text each into a table in the shared folder; the
driver reads that table block by block and broadcasts each block, so what it
holds is one block.  Documents are read in one pass: a task gathers a chunk of
texts and takes the blocks to it one after the other, holding one at a time (a
benchmark of one block, which is the common case, stays in memory).

:func:`remove` cuts the words inside occurrences out of documents that are not
contaminated, again and again until no window of the benchmark is left, and
drops those that are.

Defined cases: null text or text without words gives ``n_words = 0``, no hits
and ``contaminated = False``; null or word-free items never occur, nor do items
with a null id; a null document id is kept as it is; repeated rows are judged
one by one; an empty benchmark hits nothing, an empty table gives no rows; only
the id and text columns are read, and columns to keep travel in one struct, so
other columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import drop_written, written

WINDOW = 13
#: Entries of a shift table.
_SHIFTS = 1 << 21
#: Bytes of text that a task takes through all blocks together.
_CHUNK = 32 << 20
#: Upper-case ASCII becomes lower-case; every other ASCII byte but letters and digits parts words.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")
_hash = xxhash.xxh3_64_intdigest


def _spaced(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return _spaced(text).split()


class WuManber:
    """All patterns of one length, in words.

    ``items`` are (item number, words) pairs; every run of ``length`` words is a
    pattern.  Texts are kept once, joined by spaces; a pattern is a range of them.
    """

    def __init__(self, length: int, items: list[tuple[int, list[bytes]]]):
        m = self.length = length
        self.default = max(1, length - 1)
        words = [w for _, own in items for w in own]
        self.text = b" ".join(words)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        ends = np.cumsum([0, *(len(own) for _, own in items)])
        first = np.concatenate([np.arange(a, b - m + 1) for a, b in zip(ends, ends[1:])])
        who = np.repeat([n for n, _ in items], [len(own) - m + 1 for _, own in items])
        self.shift = np.full(_SHIFTS if m > 2 else 1, self.default, np.uint8 if m < 256 else np.int32)
        if m > 2:
            block = np.array([_hash(a + b" " + b) & (_SHIFTS - 1) for a, b in zip(words, words[1:])], np.int64)
            for (a, b) in zip(ends, ends[1:]):  # the first pattern that holds a block has it nearest to the end
                place = np.arange(b - a - 1)
                np.minimum.at(self.shift, block[a : b - 1], np.maximum(m - 2 - place, 0).astype(self.shift.dtype))
        hashes = np.array([self._key(words[s + m - 2 : s + m], words[s : s + m]) for s in first.tolist()], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = array("Q", hashes[order].tobytes())
        self.begin = starts[first[order]].astype(np.int64)
        self.end = (starts[first[order] + m] - 1).astype(np.int64)
        self.item = who[order].astype(np.int64)

    @staticmethod
    def _key(suffix: list[bytes], window: list[bytes]) -> int:
        """The bucket (hash of the suffix) in the upper half, the hash of the window in the lower."""
        return (_hash(b" ".join(suffix)) & 0xFFFFFFFF) << 32 | _hash(b" ".join(window)) & 0xFFFFFFFF

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(start, items) of every occurrence."""
        m, shift, hashes, mask = self.length, memoryview(self.shift), self.hashes, _SHIFTS - 1
        end, n, size = m, len(words), len(self.hashes)
        while end <= n:
            if m > 2:
                s = shift[_hash(words[end - 2] + b" " + words[end - 1]) & mask]
                if s:
                    end += s
                    continue
            own = words[end - m : end]
            key = self._key(own[-2:], own)
            at = bisect_left(hashes, key)
            if at < size and hashes[at] == key:
                line, found = b" ".join(own), set()
                while at < size and hashes[at] == key:
                    if self.text[self.begin[at] : self.end[at]] == line:
                        found.add(int(self.item[at]))
                    at += 1
                if found:
                    yield end - m, found
            end += 1


@dataclass
class Block:
    """Searchers over some items: one for each pattern length."""

    names: list[str] = field(default_factory=list)
    searchers: list[WuManber] = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Block:
        by_length: dict[int, list] = {}
        for number, (_, words) in enumerate(items):
            by_length.setdefault(min(window, len(words)), []).append((number, words))
        return cls([name for name, _ in items], [WuManber(m, own) for m, own in by_length.items() if m])

    def find(self, words: list[bytes], hits: list[tuple[int, int]], which: set[str]) -> None:
        for s in self.searchers:
            for start, who in s.search(words):
                hits.append((start, start + s.length))
                which.update(self.names[i] for i in who)


def _built(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> DataFrame:
    """One row for each block of about ``block_bytes`` of benchmark text: its searchers, pickled; written."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        held, n = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block.of(held, window), 5)], pa.binary())], names=["block"])

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                step = max(window, block_bytes // 8)  # a very long item goes in parts that overlap by a window less a word
                for a in range(0, max(1, len(words) - window + 1), step):
                    part = words[a : a + step + window - 1]
                    held.append((item, part))
                    n += sum(map(len, part)) + 64
                    if n >= block_bytes:
                        yield out()
                        held, n = [], 0
        if held:
            yield out()

    return written(rows.repartition(max(1, math.ceil(size / block_bytes))).mapInArrow(build, "block binary"), "benchmark")


class _Blocks:
    """The broadcast blocks on an executor; holds one at a time, or the only one for good."""

    def __init__(self, held: list):
        self.held, self.only = held, None

    def __iter__(self) -> Iterator[Block]:
        import pickle

        if len(self.held) == 1:
            self.only = self.only or pickle.loads(self.held[0].value)
            yield self.only
            return
        for h in self.held:
            # not ``value``, which would keep every block that was ever read
            data = h.value if getattr(h, "_path", None) is None else h.load_from_path(h._path)
            yield pickle.loads(data)


def _merged(hits: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(hits):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def _found(texts: list[str | None], blocks: _Blocks) -> list[tuple[int, list[int], set[str]]]:
    """(words, spans as flat starts and ends, items) of each text."""
    words = [words_of(t) for t in texts]
    hits: list[list] = [[] for _ in texts]
    which: list[set] = [set() for _ in texts]
    for block in blocks:
        for k, own in enumerate(words):
            block.find(own, hits[k], which[k])
    return [(len(w), _merged(h), i) for w, h, i in zip(words, hits, which)]


def without(text: str, spans: list[int]) -> str:
    """The text without the words of some spans and what stands between these words."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(_spaced(text))]
    parts, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        parts.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass")


def _search(docs: DataFrame, benchmark: DataFrame, id_col: str | None, text_col: str, item_col: str, item_text_col: str, window: int, block_bytes: int, keep: list[str], cut: bool) -> DataFrame:
    """``id, row (the keep columns as a struct), n, at, items[, left]``, where left is the text without what occurs."""
    spark = docs.sparkSession
    built = _built(benchmark, item_col, item_text_col, window, block_bytes)
    held = [spark.sparkContext.broadcast(bytes(r.block)) for r in built.toLocalIterator()]  # one block at a time
    drop_written(built)
    base = docs.select((F.col(id_col) if id_col else F.lit(0)).alias("id"), F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("_")]).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = base.select("id", "row", F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("items"), F.col("text").alias("left")).schema

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(held)

        def of(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [t for b in group for t in b.column(2).to_pylist()]
            found = _found(texts, blocks)
            left: list[str | None] = [None] * len(texts)
            if cut:
                todo = {k: f[1] for k, f in enumerate(found) if f[1]}
                now = {k: texts[k] for k in todo}
                while todo:
                    now.update({k: without(now[k], spans) for k, spans in todo.items()})
                    order = list(todo)
                    again = _found([now[k] for k in order], blocks)
                    todo = {k: f[1] for k, f in zip(order, again) if f[1]}
                left = [now.get(k, t) for k, t in enumerate(texts)]
            at = 0
            for b in group:
                own = slice(at, at + b.num_rows)
                at += b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([f[0] for f in found[own]], pa.int64()), pa.array([f[1] for f in found[own]], pa.list_(pa.int32())), pa.array([sorted(f[2]) for f in found[own]], pa.list_(pa.string())), pa.array(left[own], pa.string())],
                    names=["id", "row", "n", "at", "items", "left"],
                )

        group, size = [], 0
        for batch in batches:
            group.append(batch)
            size += batch.column(2).nbytes
            if len(held) <= 1 or size >= _CHUNK:
                yield from of(group)
                group, size = [], 0
        if group:
            yield from of(group)

    return base.mapInArrow(search, schema)


_SPANS = "transform(filter(at, (x, i) -> i % 2 = 0), (x, i) -> struct(x as start, element_at(at, 2 * i + 2) as end))"


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 16 << 20, keep: list[str] | None = None) -> DataFrame:
    """Occurrences of benchmark windows in each document.

    Returns ``id, n_words, spans (array of start, end in words, merged), items
    (array of item ids, sorted as strings)`` and, if any are given, the columns
    in ``keep`` as one struct ``row``.
    """
    found = _search(docs, benchmark, id_col, text_col, item_col, item_text_col, window, block_bytes, list(keep or []), False)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.expr(_SPANS).alias("spans"), "items", *(["row"] if keep else []))


def judge(scanned: DataFrame) -> DataFrame:
    """Adds ``n_hit`` (words inside an occurrence) and ``contaminated`` to :func:`scan`'s rows."""
    hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return scanned.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 16 << 20, size_col: str | None = None) -> DataFrame:
    """``docs`` without contaminated documents and, in the others, without any window of the benchmark.

    Columns are those of ``docs``; ``size_col`` is set to the characters of a text that was cut.
    """
    found = _search(docs, benchmark, None, text_col, item_col, item_text_col, window, block_bytes, docs.columns, True)
    hit = F.expr("aggregate(transform(at, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    clean = found.where(~((hit > 0) & (20 * hit >= F.col("n"))))

    def value(c: str):
        own = F.col("row").getField(c)
        if c == text_col:
            return F.when(F.size("at") > 0, F.col("left")).otherwise(own)
        if c == size_col:
            return F.when(F.size("at") > 0, F.length("left")).otherwise(own).cast(docs.schema[c].dataType)
        return own

    return clean.select(*[value(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document of the table against every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return judge(scan(docs, benchmark)).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def oracle_sql() -> str:
    """DuckDB SQL for :func:`query`."""
    words = lambda x: f"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with items as (select cast(item_id as varchar) as item, {words("text")} as w from benchmark where item_id is not null and text is not null),
cut as (select item, w, least(len(w), {WINDOW}) as m from items where len(w) > 0),
patterns as (select distinct item, m, array_to_string(w[i + 1 : i + m], ' ') as k from (select *, unnest(range(len(w) - m + 1)) as i from cut)),
docs as (select row_number() over () as rid, doc_id, coalesce({words("text")}, []) as w from documents),
windows as (select rid, i, m, array_to_string(w[i + 1 : i + m], ' ') as k from (select rid, w, m, unnest(range(len(w) - m + 1)) as i from docs, (select distinct m from patterns) where len(w) >= m)),
hits as (select distinct rid, i, m, item from windows join patterns using (m, k)),
covered as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + m)) as p from (select distinct rid, i, m from hits)) group by rid),
found as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct rid, item from hits) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from docs left join covered using (rid) left join found using (rid)"""


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Rows of the contract by looking every run of words up among all windows; for tests."""
    windows: dict[tuple, set] = {}
    for item, item_text in items:
        iw = words_of(item_text)
        m = min(window, len(iw))
        for i in range(len(iw) - m + 1) if m else ():
            windows.setdefault(tuple(iw[i : i + m]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = words_of(text)
        hit, which = set(), set()
        for m in lengths:
            for j in range(len(words) - m + 1):
                found = windows.get(tuple(words[j : j + m]))
                if found:
                    hit.update(range(j, j + m))
                    which |= found
        out.append((doc, len(words), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return out
