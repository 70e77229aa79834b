"""Token ids in sorted-string-table shards.

A shard is one immutable file of documents in ascending key order:

* *blocks*: runs of entries, compressed with zstandard.  An entry is
  ``shared (varint) | unshared (varint) | n_ids (varint) | key suffix | ids``;
  keys share a prefix with the one before, the first of a block shares none,
* *block index*: the first key, place and size of each block,
* *Bloom filter* over the keys: ten bits a key, seven probes,
* *footer* of fixed size: places of both, entry and id counts, magic.

A lookup reads the footer, probes the Bloom filter, bisects the sparse index
and unpacks one block.  Keys are the order-preserving eight bytes of a long.

Writing: documents are range-partitioned by key (Spark samples the keys), each
task sorts its range and writes shards of about ``shard_ids`` ids.  A file is
written under an attempt's own name and then renamed, so a task that is lost
and runs again leaves no half-written shard; the names that count are the ones
in the rows the tasks return (the manifest), which Spark takes from one
successful attempt only.

Defined cases: a null text is empty (one end id); a null key is written
too, before all others; repeated keys stay, in any order
among themselves; an empty table makes no shards; only key and text columns
are read.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._common import fresh_path, shuffle_partitions
from gridloom.llm.tokens import kept_encoder

END_ID = 2
_MAGIC = b"GLSST1\0\0"
_FOOTER = struct.Struct("<QQQQQQ8s")
#: (index place, index size, Bloom place, Bloom size, entries, ids, magic)


def key_bytes(key: int | None) -> bytes:
    """Eight bytes in the numbers' order; none for a null key, which sorts first."""
    return b"" if key is None else struct.pack(">Q", key + (1 << 63))


def key_of(raw: bytes) -> int | None:
    return struct.unpack(">Q", raw)[0] - (1 << 63) if raw else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(7)]


class ShardWriter:
    """Builds one shard in memory; ``finish()`` returns its bytes."""

    def __init__(self, id_bytes: int = 2, block_bytes: int = 1 << 16):
        self.id_bytes, self.block_bytes = id_bytes, block_bytes
        self.out, self.index, self.keys = bytearray(), [], []
        self.block, self.first, self.last, self.ids = bytearray(), b"", b"", 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids``: little-endian unsigned numbers of ``id_bytes`` bytes."""
        shared = 0
        if not self.block:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids) // self.id_bytes) + key[shared:] + ids
        self.last = key
        self.keys.append(key)
        self.ids += len(ids) // self.id_bytes
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            packed = self.packer.compress(bytes(self.block))
            self.index.append((self.first, len(self.out), len(packed)))
            self.out += packed
            self.block = bytearray()

    def finish(self) -> bytes:
        self._flush()
        index_at = len(self.out)
        self.out += bytes([self.id_bytes])
        for key, place, size in self.index:
            self.out += bytes([len(key)]) + key + _varint(place) + _varint(size)
        bloom_at = len(self.out)
        bits = max(64, 10 * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, dtype=np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out += struct.pack("<Q", bits) + bloom.tobytes()
        self.out += _FOOTER.pack(index_at, bloom_at - index_at, bloom_at, len(self.out) - bloom_at, len(self.keys), self.ids, _MAGIC)
        return bytes(self.out)


class ShardReader:
    """A shard's documents, in order or by key."""

    def __init__(self, data: bytes):
        self.data = data
        index_at, index_size, bloom_at, bloom_size, self.entries, self.n_ids, magic = _FOOTER.unpack(data[-_FOOTER.size :])
        if magic != _MAGIC:
            raise ValueError("not a shard, or cut short")
        self.id_bytes = data[index_at]
        self.dtype = np.dtype(f"<u{self.id_bytes}")
        self.index, at = [], index_at + 1
        while at < index_at + index_size:
            n = data[at]
            key = data[at + 1 : at + 1 + n]
            place, at = _read_varint(data, at + 1 + n)
            size, at = _read_varint(data, at)
            self.index.append((key, place, size))
        self.bits = struct.unpack_from("<Q", data, bloom_at)[0]
        self.bloom = data[bloom_at + 8 : bloom_at + bloom_size]

    def _block(self, place: int, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
        raw = zstandard.ZstdDecompressor().decompress(self.data[place : place + size])
        at, key = 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, np.frombuffer(raw, self.dtype, n, at)
            at += n * self.id_bytes

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, place, size in self.index:
            for key, ids in self._block(place, size):
                yield key_of(key), ids

    def may_have(self, key: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_bytes(key), self.bits))

    def get(self, key: int | None) -> list[np.ndarray]:
        """Ids of each document with this key."""
        raw = key_bytes(key)
        if not self.index or not self.may_have(key):
            return []
        found = []
        at = max(0, bisect.bisect_left([k for k, _, _ in self.index], raw) - 1)
        for first, place, size in self.index[at:]:
            if first > raw:
                break
            found += [ids for k, ids in self._block(place, size) if k == raw]
        return found


def _put(folder: str, name: str, data: bytes) -> None:
    fs, path = pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
    fs.create_dir(path, recursive=True)
    attempt = f"{path}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt) as f:
        f.write(data)
    fs.move(attempt, f"{path}/{name}")


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID, shard_ids: int = 8 << 20) -> DataFrame:
    """Tokenise and write; returns the manifest ``shard, name, entries, ids``, one row for each file.

    ``shard`` is the files' order.  The manifest is lazy: reading it does the
    writing, so write it to a table once.
    """
    parts = shuffle_partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    base = base.repartitionByRange(parts, F.col("k").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("k").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder = kept_encoder(tokenizer_path)
        id_bytes = 2 if encoder.typecode == "H" else 4
        end = end_id.to_bytes(id_bytes, "little")
        run = uuid.uuid4().hex[:8]
        rows: list[tuple] = []
        shard = ShardWriter(id_bytes)

        def close() -> None:
            nonlocal shard
            if shard.keys:
                name = f"part-{task:06d}-{len(rows):05d}-{run}.sst"
                _put(folder, name, shard.finish())
                rows.append(((task << 32) + len(rows), name, len(shard.keys), shard.ids))
            shard = ShardWriter(id_bytes)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard.add(key_bytes(key), encoder.raw(text) + end)
                if shard.ids >= shard_ids:
                    close()
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["shard", "name", "entries", "ids"])

    return base.mapInArrow(write, "shard long, name string, entries long, ids long")


def _starts(manifest: DataFrame) -> DataFrame:
    """``name, first``: how many ids stand in the files before each; sums by task first, so that only tasks' totals meet."""
    rows = manifest.select("shard", "name", "ids", F.shiftright("shard", 32).alias("task"))
    totals = rows.groupBy("task").agg(F.sum("ids").alias("all"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("task", F.coalesce(F.sum("all").over(before(Window.orderBy("task"))), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("ids").over(before(Window.partitionBy("task").orderBy("shard"))), F.lit(0))
    return rows.withColumn("own", own).join(offsets, "task").select("name", (F.col("base") + F.col("own")).alias("first"))


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document, read back from the files.

    Files that the manifest does not name, left by attempts that did not count,
    are passed over.  What a file says of its documents, not the file, is joined
    to the manifest's running sums.
    """
    if not manifest.head(1):
        return spark.createDataFrame([], "id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name, at, rows = path.as_py().rsplit("/", 1)[-1], 0, []
                for key, ids in ShardReader(content.as_py()):
                    rows.append((key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["name", "id", "at", "n_tokens", "ids_crc32"])

    found = files.mapInArrow(read, "name string, id long, at long, n_tokens long, ids_crc32 long")
    return found.join(_starts(manifest), "name").select("id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the whole documents table to shards and back."""
    from gridloom.llm._common import written

    folder = fresh_path(spark, "sst")
    manifest = written(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), "manifest")
    return read_shards(spark, folder, manifest).withColumnRenamed("id", "doc_id")
