"""Substring deduplication with a log-structured index of window hashes.

A window is 13 consecutive words of one document.  A window is a repeat if the
same words also start in a document with a smaller id; every word that a
repeated window covers is removed.

The index (:class:`WindowIndex`) is a folder of *runs*.  A run is an immutable
table with one row for each bucket (a range of the hash): the bucket's window
hashes, sorted, delta-coded and compressed, and for each the first document
that has it.  Hashes have 20 bits more than it takes to number the windows, so
an entry needs some five bytes at any size, and about one window in a million
meets a false candidate.  A table is taken in ``batches`` of ascending ids:

1. each task hashes its windows and keeps, for each hash, the smallest id; the
   windows of larger ids are candidates already and are set apart in the task,
   so a passage that a third of all documents share leaves a task as one entry,
2. the entries go, sorted and packed, to the task of their bucket, where they
   are merge-joined with the bucket's historical runs and with each other: that
   gives candidates (document, hash) and, for each hash of them, its holder,
3. what is new is written as the batch's run,
4. when ``fanout`` runs of one level have gathered, they are *compacted*: merged
   into one run of the next level.

After all batches the candidates are *verified* by their words.  Candidates
return to their documents; neighbouring ones leave together as a stretch of
text, to the task of the least four-word hash inside the window (so equal words
always meet, whatever their hash), where windows are compared word by word.  A
candidate whose words stand in no earlier document is a false one and stays.

An index may be kept and serve later tables (``index_path``): their ids must be
larger than all ids before, and the earlier documents are passed as ``history``,
because their texts, which the index does not hold, are compared.

Defined cases: null text has no words; a null id neither removes nor loses
anything; ids are whole numbers (others fail when they are cast); rows with the
same id count as one document for what is earlier; an empty table gives no
rows; only id, text and ``keep`` columns are read, and ``keep`` columns travel in
one struct, so they may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import delete_path, drop_written, fresh_path, release, shuffle_partitions, written

WINDOW = 13
#: Parts of the verification; how many there are does not hang on the number of tasks.
_STRETCH_PARTS = 4096
#: Bits of a hash beyond those that number all windows.
SPARE_BITS = 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _slices(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes that end at white space."""
    at = 0
    while len(data) - at > size:
        m = _SPACE.search(data, at + size)
        if m is None:
            break
        yield data[at : m.start()]
        at = m.end()
    yield data[at:]


def word_hashes(text: str | None) -> np.ndarray:
    """XXH3 of each word ``[^\\x20\\x09-\\x0D]+``."""
    h = xxhash.xxh3_64_intdigest
    parts = []
    for part in _slices((text or "").encode("utf-8", "surrogatepass")):
        words = part.split()
        parts.append(np.fromiter(map(h, words), np.uint64, len(words)))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, window: int = WINDOW, bits: int = 64) -> np.ndarray:
    """Hash of each window by the word it starts at; for ``len - window + 1`` starts."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    a = np.zeros(n, np.uint64)
    for j in range(window):
        a = a * _K1 + words[j : j + n]
    return _mixed(a) >> np.uint64(64 - bits)


def _least_grams(words: np.ndarray, window: int) -> np.ndarray:
    """For each window the least hash of four neighbouring words in it."""
    gram = min(4, window)
    n = len(words) - gram + 1
    g = np.zeros(n, np.uint64)
    for j in range(gram):
        g = (g ^ words[j : j + n]) * _K2
        g ^= g >> np.uint64(29)
    out = g[: n - (window - gram)].copy()
    for j in range(1, window - gram + 1):
        np.minimum(out, g[j : j + len(out)], out=out)
    return out


def _pack(hashes: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as zstandard-compressed byte planes of their differences."""
    deltas = np.diff(hashes, prepend=np.uint64(0))
    planes = np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T)
    used = 8 - next((i for i in range(8) if planes[7 - i].any()), 8)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    if data[0]:
        planes[: data[0]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed byte planes."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    used = 4 - next((i for i in range(4) if planes[3 - i].any()), 4)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def _unpack_numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((4, n), np.uint8)
    if data[0]:
        planes[: data[0]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


_SIGN = np.uint64(1 << 63)
_ROW = "kind tinyint, key int, n int, hashes binary, n_ids int, ids binary, docs binary"
_NAMES = ["kind", "key", "n", "hashes", "n_ids", "ids", "docs"]
_KINDS = [pa.int8(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
#: What a row holds (hashes, ascending, each with a document): entries of a batch, a run's bucket, history, candidates, their holders.
_NEW, _RUN, _OLD, _REPEAT, _HOLD = range(5)


def _row(kind: int, key: int, h: np.ndarray, d: np.ndarray) -> tuple:
    """A row of hashes in ascending order and their documents."""
    ids, place = np.unique(d, return_inverse=True)
    return (kind, key, len(h), _pack(h), len(ids), _pack(ids.view(np.uint64) ^ _SIGN), _pack_numbers(place))


def _read(row: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents) of a row."""
    ids = (_unpack(row[5], row[4]) ^ _SIGN).view(np.int64)
    return _unpack(row[3], row[2]), ids[_unpack_numbers(row[6], row[2])]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


def _part_of(docs: np.ndarray, parts: int) -> np.ndarray:
    """The part in which all that concerns a document meets."""
    return (_mixed(docs.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _by_document(kind: int, first_key: int, parts: int, h: np.ndarray, d: np.ndarray) -> Iterator[tuple]:
    """Rows of (hash, document) pairs, dealt into parts by document."""
    part = _part_of(d, parts)
    order = np.lexsort((h, part))
    h, d, part = h[order], d[order], part[order]
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut], [*cut, len(h)]):
        if b > a:
            yield _row(kind, first_key + int(part[a]), h[a:b], d[a:b])


class WindowIndex:
    """A log-structured set of window hashes in a shared folder.

    ``bits`` of a hash and ``buckets`` (a power of two) are fixed when the index
    is made; a bucket of a run should stay below a few million hashes.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int, buckets: int, fanout: int = 4):
        if buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.spark, self.path, self.fanout = spark, path, fanout
        # an index keeps the layout it was made with
        made = next((re.fullmatch(r"layout-(\d+)-(\d+)", n) for n in self._names() if n.startswith("layout-")), None)
        self.bits, self.buckets = (int(made[1]), int(made[2])) if made else (bits, buckets)

    def _at(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self) -> list[str]:
        fs, top = self._at()
        return [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []

    def _mark(self, name: str) -> None:
        fs, p = self._at(name)
        fs.mkdirs(p)

    def largest_id(self) -> int | None:
        """The largest id of the tables that the index has seen."""
        return max((int(n[4:]) for n in self._names() if n.startswith("top-")), default=None)

    def seen(self, largest: int) -> None:
        self._mark(f"top-{largest}")

    def runs(self) -> list[tuple[int, int, str]]:
        """(level, number, path) of each complete run."""
        found = []
        for name in self._names():
            m = re.fullmatch(r"run-(\d+)-(\d+)", name)
            if m and (lambda at: at[0].exists(at[1]))(self._at(f"{name}/_SUCCESS")):
                found.append((int(m[1]), int(m[2]), f"{self.path}/{name}"))
        return sorted(found)

    def _of_runs(self, paths: list[str]) -> DataFrame:
        # a run without any new window has no such folder
        paths = [p for p in (f"{p}/kind={_RUN}" for p in paths) if (lambda at: at[0].exists(at[1]))(self._at(p[len(self.path) + 1 :]))]
        schema = _ROW.split(", ", 1)[1]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.select(F.lit(_OLD).cast("tinyint").alias("kind"), *_NAMES[1:])

    def history(self) -> DataFrame | None:
        paths = [p for _, _, p in self.runs()]
        return self._of_runs(paths) if paths else None

    def append(self, rows: DataFrame, level: int = 0) -> str:
        """Write a run (and what else ``rows`` holds beside it, by kind); its path."""
        self._mark(f"layout-{self.bits}-{self.buckets}")
        number = 1 + max((n for _, n, _ in self.runs()), default=-1)
        path = f"{self.path}/run-{level}-{number}"
        rows.select(*_NAMES).write.partitionBy("kind").parquet(path)
        return path

    def compact(self) -> int:
        """Merge the runs of each level that has ``fanout`` of them into one of the next level; how often."""
        done = 0
        while True:
            runs = self.runs()
            full = next((level for level, _, _ in runs if sum(x == level for x, _, _ in runs) >= self.fanout), None)
            if full is None:
                return done
            paths = [p for level, _, p in runs if level == full]
            self.append(_by_key(self._of_runs(paths), _merged, shuffle_partitions(self.spark)), full + 1)
            for p in paths:
                delete_path(self.spark, p)
            done += 1


def _by_key(rows: DataFrame, work, parts: int, schema: str = _ROW, batch=_batch) -> DataFrame:
    """``work(groups)`` over a task's (key, list of rows) yields rows."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
        held, now = [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[1] != now and held:
                    yield now, held
                    held = []
                now = row[1]
                held.append(row)
        if held:
            yield now, held

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in work(groups(batches)):
            out.append(row)
            size += sum(len(x) for x in row if isinstance(x, bytes))
            if size > 4 << 20 or len(out) >= 1000:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    return rows.select(*_NAMES).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(each, schema)


def _merged(groups: Iterator[tuple[int, list[tuple]]]) -> Iterator[tuple]:
    """One row for each bucket with all hashes of some runs, which have none in common."""
    for bucket, rows in groups:
        h, d = map(np.concatenate, zip(*map(_read, rows)))
        order = np.argsort(h, kind="stable")
        yield _row(_RUN, bucket, h[order], d[order])


def _settle(rows: list[tuple]) -> tuple:
    """The merge join of a bucket: candidates (h, d), holders (h, d), what is new (h, d)."""
    h, d = map(np.concatenate, zip(*(_read(r) for r in rows if r[0] == _NEW)))
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    first = np.r_[True, h[1:] != h[:-1]]
    group = np.cumsum(first) - 1
    unique, holder, known = h[first], d[first].copy(), np.zeros(int(first.sum()), bool)
    for r in rows:
        if r[0] == _OLD:
            oh, od = _read(r)
            at = np.minimum(np.searchsorted(oh, unique), len(oh) - 1)
            same = oh[at] == unique
            holder[same] = np.where(known[same], np.minimum(holder[same], od[at[same]]), od[at[same]])
            known |= same
    repeat = d > holder[group]
    asked = np.zeros(len(unique), bool)
    asked[group[repeat]] = True
    return (h[repeat], d[repeat]), (unique[asked], holder[asked]), (unique[~known], holder[~known])


def _entries(docs: DataFrame, id_col: str, text_col: str, index: WindowIndex, window: int, chunk_windows: int, parts: int) -> DataFrame:
    """Packed entries of each chunk of documents by bucket, and the candidates that a chunk finds in itself."""
    bits, buckets = index.bits, index.buckets
    shift = np.uint64(bits - (buckets.bit_length() - 1))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        held: list[np.ndarray] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n
            if not n:
                return
            h, d = np.concatenate(held), np.repeat(np.array(ids, np.int64), [len(x) for x in held])
            ids.clear()
            held.clear()
            n = 0
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = np.r_[True, h[1:] != h[:-1]]
            group = np.cumsum(first) - 1
            uh, ud = h[first], d[first]
            later = d > ud[group]
            asked = np.zeros(len(uh), bool)
            asked[group[later]] = True
            # a document that repeats a window has it once
            once = later & np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
            rows = [*_by_document(_REPEAT, buckets, parts, h[once], d[once]), *_by_document(_HOLD, buckets, parts, uh[asked], ud[asked])]
            del h, d, group, later, once
            starts = np.searchsorted((uh >> shift).astype(np.int64), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(starts)):
                own = slice(starts[b], starts[b + 1])
                rows.append(_row(_NEW, int(b), uh[own], ud[own]))
                if len(rows) >= 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = window_hashes(word_hashes(text.as_py()), window, bits)
                if len(h):
                    ids.append(key)
                    held.append(h)
                    n += len(h)
                    if n >= chunk_windows:
                        yield from flush()
        yield from flush()

    base = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).where("k is not null and t is not null")
    return base.mapInArrow(hashed, _ROW)


_ASKED = "doc long, n int, repeats binary, n_held int, held binary"


def _of_documents(rows: DataFrame, parts: int) -> DataFrame:
    """``doc, n, repeats, n_held, held``: hashes of a document's candidates, and those that it holds for others."""

    def work(groups: Iterator[tuple[int, list[tuple]]]) -> Iterator[tuple]:
        for _, own in groups:
            read = [(*_read(r), r[0] == _REPEAT) for r in own]
            h, d = np.concatenate([x[0] for x in read]), np.concatenate([x[1] for x in read])
            repeat = np.repeat([x[2] for x in read], [len(x[0]) for x in read])
            order = np.lexsort((h, d))
            h, d, repeat = h[order], d[order], repeat[order]
            cut = np.flatnonzero(np.diff(d)) + 1
            for a, b in zip([0, *cut], [*cut, len(d)]):
                mine, held = np.unique(h[a:b][repeat[a:b]]), np.unique(h[a:b][~repeat[a:b]])
                yield (int(d[a]), len(mine), _pack(mine), len(held), _pack(held))

    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc", "n", "repeats", "n_held", "held"])
    return _by_key(rows, work, parts, _ASKED, batch)


def candidates(docs: DataFrame, index: WindowIndex, parts: int, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_windows: int = 1_000_000, most: int = 500_000) -> DataFrame:
    """Candidates of one batch of documents and their holders (by document, in ``parts`` parts, written); adds the batch's run to the index.

    The batch's ids must be larger than those the index has seen.
    """
    spark = docs.sparkSession
    tasks = shuffle_partitions(spark)
    entries = _entries(docs, id_col, text_col, index, window, chunk_windows, parts)
    history = index.history()
    buckets = index.buckets

    def work(groups: Iterator[tuple[int, list[tuple]]]) -> Iterator[tuple]:
        asked: dict[int, list] = {_REPEAT: [], _HOLD: []}
        n = 0
        for key, rows in groups:
            if key >= buckets:  # what a chunk has found in itself passes by the merge
                yield from rows
                continue
            if not any(r[0] == _NEW for r in rows):
                continue
            repeat, held, new = _settle(rows)
            asked[_REPEAT].append(repeat)
            asked[_HOLD].append(held)
            n += len(repeat[0]) + len(held[0])
            if len(new[0]):
                yield _row(_RUN, key, *new)
            if n >= most:
                yield from dealt(asked)
                n = 0
        yield from dealt(asked)

    def dealt(asked: dict[int, list]) -> Iterator[tuple]:
        for kind, pairs in asked.items():
            if pairs:
                yield from _by_document(kind, buckets, parts, *map(np.concatenate, zip(*pairs)))
                pairs.clear()

    path = index.append(_by_key(entries if history is None else entries.unionByName(history), work, tasks))
    beside = [f"{path}/kind={k}" for k in (_REPEAT, _HOLD)]
    rows = spark.read.schema(_ROW).parquet(path).where(F.col("kind").isin(_REPEAT, _HOLD))
    out = written(_of_documents(rows, tasks), "candidates")
    for p in beside:
        delete_path(spark, p)
    index.compact()
    return out


def _sets(asked: list[DataFrame]) -> DataFrame:
    """``doc, _sets``: a row for each document; a set for each batch at most."""
    every = asked[0]
    for a in asked[1:]:
        every = every.unionByName(a)
    return every.groupBy("doc").agg(F.collect_list(F.struct("n", "repeats", "n_held", "held")).alias("_sets"))


def _united(sets: list[dict], n: str, hashes: str) -> np.ndarray:
    own = [_unpack(s[hashes], s[n]) for s in sets if s[n]]
    return np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _compared(texts: list[bytes], docs: np.ndarray, repeat: np.ndarray, window: int) -> list[tuple[int, bytes]]:
    """(document, words) of windows whose first document has them as candidates: words that no document before has."""
    split = [t.split() for t in texts]
    words = [w for own in split for w in own]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size = np.array([len(own) for own in split])
    per = size - window + 1
    begin = np.cumsum(size) - size
    at = np.repeat(begin, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    of = np.repeat(np.arange(len(texts)), per)
    f = np.zeros(len(ids), np.uint64)
    hashes = window_hashes(_mixed(ids.astype(np.uint64) + np.uint64(1)), window)
    f[: len(hashes)] = hashes
    f = f[at]
    order = np.lexsort((~repeat[of], docs[of], f))
    at, of, f = at[order], of[order], f[order]
    same = f[1:] == f[:-1]
    equal = same.copy()
    for j in range(window):  # word by word
        equal &= ids[at[1:] + j] == ids[at[:-1] + j]
    if (same & ~equal).any():  # different words with one hash: sort by the words themselves
        order = np.lexsort((~repeat[of], docs[of], *(ids[at + j] for j in range(window))))
        at, of = at[order], of[order]
        equal = np.ones(len(at) - 1, bool)
        for j in range(window):
            equal &= ids[at[1:] + j] == ids[at[:-1] + j]
    first = np.flatnonzero(np.r_[True, ~equal])
    false = first[repeat[of[first]]]
    return [(int(docs[of[k]]), b" ".join(words[at[k] : at[k] + window])) for k in false]


def _runs(flags: np.ndarray) -> list[int]:
    """Where true stretches start and end, flat."""
    edge = np.r_[False, flags, False]
    return np.flatnonzero(edge[1:] != edge[:-1]).tolist()


def _marked(joined: DataFrame, window: int, bits: int) -> DataFrame:
    """``_hits`` and ``_held``: runs of windows of each text that are candidates, or held for others, in place of ``_sets``."""
    names = [c for c in joined.columns if c != "_sets"]
    rows = joined.select(*names, "_sets")
    schema = rows.select(*names, F.lit(None).cast("array<int>").alias("_hits"), F.lit(None).cast("array<int>").alias("_held")).schema
    text_at = names.index("_text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = pa.list_(pa.int32())
        for batch in batches:
            hits, held = [], []
            for text, sets in zip(batch.column(text_at), batch.column(len(names))):
                sets = sets.as_py()
                h = window_hashes(word_hashes(text.as_py()), window, bits) if sets else ()
                if not len(h):
                    hits.append(None)
                    held.append(None)
                    continue
                hits.append(_runs(_among(h, _united(sets, "n", "repeats"))))
                held.append(_runs(_among(h, _united(sets, "n_held", "held"))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(hits, runs), pa.array(held, runs)], names=[*names, "_hits", "_held"])

    return rows.mapInArrow(mark, schema)


def _flags(n: int, runs: list[int] | None) -> np.ndarray:
    out = np.zeros(n, bool)
    for a, b in zip((runs or ())[::2], (runs or ())[1::2]):
        out[a:b] = True
    return out


def false_candidates(marked: DataFrame, window: int, flush_bytes: int = 24 << 20) -> DataFrame:
    """``doc, words`` of candidates that no earlier document confirms, from rows ``doc, _text, _hits, _held``."""
    tasks = shuffle_partitions(marked.sparkSession)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[int, bool, bytes], int] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            by: dict[int, list] = {}
            for (part, repeat, text), doc in least.items():
                by.setdefault(part, []).append((text, doc, repeat))
            least.clear()
            size = 0
            pack = zstandard.ZstdCompressor(level=1).compress
            keys = sorted(by)
            for a in range(0, len(keys), 500):
                own = [by[k] for k in keys[a : a + 500]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 500], pa.int32()), pa.array([pack(b"\n".join(t for t, _, _ in x)) for x in own], pa.binary()), pa.array([[d for _, d, _ in x] for x in own], pa.list_(pa.int64())), pa.array([[r for _, _, r in x] for x in own], pa.list_(pa.bool_()))], names=["part", "texts", "docs", "repeat"])

        for batch in batches:
            for doc, text, hits, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n = len(words) - window + 1
                repeat = _flags(n, hits)
                asked = _runs(repeat | _flags(n, held))
                for a, b in zip(asked[::2], asked[1::2]):
                    own = words[a : b + window - 1]
                    gram = _least_grams(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)), window)
                    kind = repeat[a:b]
                    cut = (np.flatnonzero((gram[1:] != gram[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist()
                    part = (gram % np.uint64(_STRETCH_PARTS)).tolist()
                    for x, y in zip([0, *cut], [*cut, b - a]):
                        key = (part[x], bool(kind[x]), b" ".join(own[x : y - 1 + window]))
                        before = least.get(key)
                        if before is None:
                            least[key] = doc
                            size += len(key[2]) + 200
                        elif doc < before:
                            least[key] = doc
                if size >= flush_bytes:
                    yield from flush()
        yield from flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        docs: list[int] = []
        repeat: list[bool] = []
        now = None

        def out() -> pa.RecordBatch:
            found = _compared(texts, np.array(docs, np.int64), np.array(repeat, bool), window)
            texts.clear()
            docs.clear()
            repeat.clear()
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([w for _, w in found], pa.binary())], names=["doc", "words"])

        for batch in batches:
            for part, blob, d, r in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                if part != now and texts:
                    yield out()
                now = part
                texts += zstandard.ZstdDecompressor().decompress(blob.as_py()).split(b"\n")
                docs += d.as_py()
                repeat += r.as_py()
        if texts:
            yield out()

    base = marked.where("size(_hits) > 0 or size(_held) > 0").select("doc", "_text", "_hits", "_held")
    dealt = base.mapInArrow(stretches, "part int, texts binary, docs array<long>, repeat array<boolean>")
    return dealt.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(compare, "doc long, words binary")


def _tagged(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, keep: list[str], how: str = "left") -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("_")]).alias("_row")
    base = docs.select(F.col(id_col).alias("_id"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("_text"), row)
    return base.join(sets, "doc", how)


def _cut(marked: DataFrame, false: DataFrame | None, window: int) -> DataFrame:
    """``_id, _row, _text, _n, _removed, _spans, _kept`` of each row of ``marked``."""
    if false is None:
        rows = marked.withColumn("_false", F.lit(None).cast("array<binary>"))
    else:
        rows = marked.join(false.groupBy("doc").agg(F.collect_set("words").alias("_false")), "doc", "left")
    rows = rows.select("_id", "_row", "_text", "_hits", "_false")
    out_schema = rows.select("_id", "_row", "_text", F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_removed"), F.array().cast("array<int>").alias("_spans"), F.col("_text").alias("_kept")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, spans, texts = [], [], [], []
            for text, hits, false in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4)):
                text, false = text.as_py(), false.as_py()
                words = (text or "").encode("utf-8", "surrogatepass").split()
                counts.append(len(words))
                own: list[int] = []
                if hits:
                    hit = _flags(len(words) - window + 1, hits)
                    for k in np.flatnonzero(hit).tolist() if false else ():
                        if b" ".join(words[k : k + window]) in false:
                            hit[k] = False
                    edge = np.zeros(len(words) + 1, np.int32)
                    edge[: len(hit)] += hit
                    edge[window : window + len(hit)] -= hit
                    own = _runs(np.cumsum(edge[:-1]) > 0)
                    left, at = [], 0
                    for a, b in zip(own[::2], own[1::2]):
                        left += words[at:a]
                        at = b
                    words = left + words[at:]
                removed.append(counts[-1] - len(words))
                spans.append(own)
                texts.append(None if text is None else b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["_id", "_row", "_text", "_n", "_removed", "_spans", "_kept"])

    return rows.mapInArrow(cut, out_schema)


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, window: int, batches: int, index_path: str | None, history: DataFrame | None, bucket_windows: int, fanout: int, keep: list[str]) -> DataFrame:
    spark = docs.sparkSession
    key = F.col(id_col).cast("long")
    quantiles = [i / batches for i in range(1, batches)]
    r = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("bytes"), F.min(key).alias("least"), F.max(key).alias("most"), F.percentile_approx(key, F.array(*map(F.lit, quantiles)), 10_000).alias("cuts") if quantiles else F.lit(None).alias("cuts")).first()
    windows = (r["bytes"] or 0) // 6 + 1
    # by the size of the data alone: a chunk makes a row for each, however many tasks there are
    buckets = min(1 << max(15, windows // bucket_windows).bit_length(), 1 << 20)
    parts = min(1 << max(15, windows // bucket_windows // 2).bit_length(), 1 << 16)
    bits = max(40, min(63, windows.bit_length() + SPARE_BITS))
    index = WindowIndex(spark, index_path or fresh_path(spark, "windows"), bits, buckets, fanout)
    before = index.largest_id()
    if before is not None and r["least"] is not None:
        if history is None:
            raise ValueError("an index that has seen documents needs them as history, to compare words")
        if r["least"] <= before:
            raise ValueError(f"ids must be larger than those of earlier tables: {r['least']} after {before}")
    cuts = sorted(set(r["cuts"] or []))
    asked = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = docs
        if low is not None:
            part = part.where(key > low)
        if high is not None:
            part = part.where(key <= high)
        asked.append(candidates(part, index, parts, id_col, text_col, window))
        release(spark)  # the batch's shuffle files; its plans are out of reach by now
    bits = index.bits
    if index_path:
        if r["most"] is not None:
            index.seen(r["most"])
    else:
        delete_path(spark, index.path)
    sets = _sets(asked)
    marked = written(_marked(_tagged(docs, sets, id_col, text_col, keep), window, bits), "marked")
    names = ["doc", "_text", "_hits", "_held"]
    rows = marked.select(names)
    if history is not None:
        rows = rows.unionByName(_marked(_tagged(history, sets, id_col, text_col, [], "inner"), window, bits).select(names))
    release(spark)
    false = written(false_candidates(rows, window), "false")
    for a in asked:
        drop_written(a)
    return _cut(marked, false if false.head(1) else None, window)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = 4, index_path: str | None = None, history: DataFrame | None = None, bucket_windows: int = 400_000, fanout: int = 3, keep: list[str] | None = None) -> DataFrame:
    """A whole table, as ``batches`` ranges of ascending ids over one index.

    Returns ``id, n_words, n_removed, spans, kept_text`` and, if any are given,
    the ``keep`` columns as one struct ``row``.  ``spans`` are the removed ranges
    of words (start, end); ``kept_text`` is the rest, joined by single spaces, or
    null for a null text.  With ``index_path`` the index stays there for later
    tables; else it is deleted when the last batch is through.
    """
    found = _deduplicated(docs, id_col, text_col, window, batches, index_path, history, bucket_windows, fanout, list(keep or []))
    spans = F.expr("transform(filter(_spans, (x, i) -> i % 2 = 0), (x, i) -> struct(x as start, element_at(_spans, 2 * i + 2) as end))")
    return found.select(F.col("_id").alias(id_col), F.col("_n").alias("n_words"), F.col("_removed").alias("n_removed"), spans.alias("spans"), F.col("_kept").alias("kept_text"), *([F.col("_row").alias("row")] if keep else []))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, window: int = WINDOW, batches: int = 4) -> DataFrame:
    """``docs`` without the words of repeated windows, and without documents of which nothing is left.

    Columns are those of ``docs``; texts that lose nothing stay as they are;
    ``size_col`` is set to the characters of a text that was cut.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    found = _deduplicated(docs, id_col, text_col, window, batches, None, None, 400_000, 3, others).where("not (_removed > 0 and _removed = _n)")

    def value(c: str):
        if c == id_col:
            return F.col("_id")
        own = F.col("_text") if c == text_col else F.col("_row").getField(c)
        if c == text_col:
            return F.when(F.col("_removed") > 0, F.col("_kept")).otherwise(own)
        if c == size_col:
            return F.when(F.col("_removed") > 0, F.length("_kept")).otherwise(own).cast(docs.schema[c].dataType)
        return own

    return found.select(*[value(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the whole documents table."""
    found = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL for :func:`query`."""
    return f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
windows as (select rid, doc_id, i, array_to_string(w[i + 1 : i + {WINDOW}], ' ') as k from (select *, unnest(range(len(w) - {WINDOW - 1})) as i from docs where len(w) >= {WINDOW} and doc_id is not null)),
firsts as (select k, min(doc_id) as least from windows group by k),
gone as (select distinct rid, i + o as p from windows join firsts using (k), (select unnest(range({WINDOW})) as o) where least < doc_id),
kept as (select rid, count(*) as n, string_agg(x, ' ' order by p) as words from (select rid, unnest(w) as x, unnest(range(len(w))) as p from docs) anti join gone using (rid, p) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(words, '')) as kept_sha256
from docs left join kept using (rid)"""


def brute_force(rows: list[tuple], window: int = WINDOW) -> dict:
    """id -> (words, removed, kept text) by comparing whole windows; for tests, with distinct ids."""
    words = {i: (t or "").encode("utf-8", "surrogatepass").split() for i, t in rows}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode("utf-8", "surrogatepass"))
    return out
