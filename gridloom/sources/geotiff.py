"""GeoTIFF files to cells and back.

Reading decodes one strip or tile at a time and yields Arrow batches, so a task
holds a file's bytes and one block's cells.  Writing compresses strips of rows
on all executors; only the compressed strips of an image meet in a task.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def parse_tiff(data: bytes) -> dict:
    """Tags of the first image of a classic TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict = {"order": order}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        place = at + 2 + 12 * i + 8
        if _SIZES.get(kind, 1) * count > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        if kind == 2:
            tags[tag] = data[place : place + count].rstrip(b"\0").decode("latin-1")
        elif kind in _CODES:
            tags[tag] = list(struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, place))
    return tags


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widened one code early."""
    out = bytearray()
    table: list[bytes] = []
    bits, n_bits, width, before = 0, 0, 9, b""
    for byte in data:
        bits = bits << 8 | byte
        n_bits += 8
        while n_bits >= width:
            n_bits -= width
            code = bits >> n_bits
            bits &= (1 << n_bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table = [bytes([i]) for i in range(256)] + [b"", b""]
                width, before = 9, b""
                continue
            if not before:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else before + before[:1]
                table.append(before + entry[:1])
            out += entry
            before = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _decoded(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 5:
        return lzw_decode(data)
    if compression == 32773:
        return packbits_decode(data)
    if compression == 50000:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"TIFF compression {compression} cannot be read")


class Tiff:
    """The first image of a file: its metadata, and its blocks one after the other."""

    def __init__(self, data: bytes):
        self.data = data
        t = self.tags = parse_tiff(data)
        one = lambda tag, d: t[tag][0] if tag in t else d
        self.ncols, self.nrows, self.bands = one(256, 0), one(257, 0), one(277, 1)
        self.compression, self.predictor, self.planar = one(259, 1), one(317, 1), one(284, 1)
        kind = {1: "u", 2: "i", 3: "f"}.get(one(339, 1))
        if kind is None:
            raise ValueError("complex pixels cannot be read")
        self.dtype = np.dtype(f"{t['order']}{kind}{one(258, 8) // 8}")
        scale, tie, matrix = t.get(33550), t.get(33922), t.get(34264)
        self.gt = [0.0, 1.0, 0.0, 0.0, 0.0, -1.0]
        if scale and tie:
            self.gt = [tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1]]
        elif matrix:
            self.gt = [matrix[3], matrix[0], matrix[1], matrix[7], matrix[4], matrix[5]]
        keys = t.get(34735, [])
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        code = found.get(3072) or found.get(2048)
        self.srs = f"EPSG:{code}" if code and code != 32767 else ""
        text = t.get(42113, "").strip()
        self.ndv = float(text) if text else None

    def blocks(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(band from 1, first row, first column, values) of each strip or tile."""
        t = self.tags
        if 322 in t:
            w, h, places, sizes = t[322][0], t[323][0], t[324], t[325]
        else:
            w, h, places = self.ncols, min(t[278][0] if 278 in t else self.nrows, self.nrows), t[273]
            sizes = t.get(279) or [len(self.data)] * len(places)
        across = -(-self.ncols // w)
        each = across * -(-self.nrows // h)
        samples = self.bands if self.planar == 1 else 1
        for k, (place, size) in enumerate(zip(places, sizes)):
            at = k % each
            r, c = at // across * h, at % across * w
            rows = h if 322 in t else min(h, self.nrows - r)
            need = rows * w * samples
            if place == 0 and size == 0:  # a block that was never written
                block = np.full((rows, w, samples), self.ndv or 0, self.dtype)
            else:
                raw = _decoded(self.data[place : place + size], self.compression)[: need * self.dtype.itemsize]
                block = self._undone(raw, rows, w, samples)
            block = block[: self.nrows - r, : self.ncols - c]
            for s in range(samples):
                yield (s + 1 if self.planar == 1 else k // each + 1), r, c, block[:, :, s]

    def _undone(self, raw: bytes, rows: int, w: int, samples: int) -> np.ndarray:
        """The predictor taken back."""
        size = self.dtype.itemsize
        if self.predictor == 3:
            planes = np.frombuffer(raw, np.uint8).reshape(rows, w * samples * size).copy()
            for s in range(samples):
                planes[:, s::samples] = np.cumsum(planes[:, s::samples], axis=1, dtype=np.uint8)
            whole = planes.reshape(rows, size, w * samples).transpose(0, 2, 1)
            return np.ascontiguousarray(whole).view(self.dtype.newbyteorder(">")).reshape(rows, w, samples)
        block = np.frombuffer(raw, self.dtype).reshape(rows, w, samples)
        if self.predictor == 2:
            plain = block.astype(self.dtype.newbyteorder("="))
            return np.cumsum(plain.view(f"u{size}"), axis=1, dtype=f"u{size}").view(plain.dtype)
        return block

    def meta(self) -> dict:
        return {"nrows": self.nrows, "ncols": self.ncols, "bands": self.bands, "gt": self.gt, "srs": self.srs, "ndv": self.ndv, "dtype": self.dtype.name}


def _values(block: np.ndarray, ndv: float | None) -> pa.Array:
    v = block.astype(np.float64).ravel()
    bad = ~np.isfinite(v)
    if ndv is not None:
        bad |= np.abs(v - ndv) <= 1e-8 + 1e-5 * abs(ndv)
    return pa.array(v, mask=bad)


def read_geotiff(spark: SparkSession, path: str, dense: bool = True) -> DataFrame:
    """``path, band, r, c, v`` of GeoTIFF files on any file system Spark reads; nodata, NaN and infinities are NULL.

    Strips, tiles, bands in either arrangement; no compression, DEFLATE, LZW,
    PackBits or Zstandard; all three predictors.  A file (up to 2 GB) is read by
    one task.  Without ``dense`` missing cells have no row.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                tiff = Tiff(content.as_py())
                for band, r, c, block in tiff.blocks():
                    step = max(1, 500_000 // max(1, block.shape[1]))
                    for a in range(0, block.shape[0], step):
                        part = block[a : a + step]
                        h, w = part.shape
                        out = pa.RecordBatch.from_arrays([pa.array([name.as_py()] * (h * w)), pa.array(np.full(h * w, band, np.int32)), pa.array(np.repeat(np.arange(r + a, r + a + h, dtype=np.int32), w)), pa.array(np.tile(np.arange(c, c + w, dtype=np.int32), h)), _values(part, tiff.ndv)], names=["path", "band", "r", "c", "v"])
                        yield out if dense else out.filter(out.column(4).is_valid())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, band int, r int, c int, v double")


def geotiff_info(spark: SparkSession, path: str) -> DataFrame:
    """``path, nrows, ncols, bands, gt, srs, ndv, dtype`` of GeoTIFF files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            metas = [Tiff(content.as_py()).meta() for content in batch.column(1)]
            kinds = {"nrows": pa.int32(), "ncols": pa.int32(), "bands": pa.int32(), "gt": pa.list_(pa.float64()), "srs": pa.string(), "ndv": pa.float64(), "dtype": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in metas], t) for k, t in kinds.items())], names=["path", *kinds])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, nrows int, ncols int, bands int, gt array<double>, srs string, ndv double, dtype string")


# --- writing -------------------------------------------------------------------


def _geo_keys(srs: str) -> list[int]:
    code = int(srs.upper().removeprefix("EPSG:")) if srs else 0
    if not code:
        return []
    geographic = 4000 <= code < 5000
    return [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, code]


def assemble(strips: Sequence[bytes], nrows: int, ncols: int, rows_per_strip: int, dtype: np.dtype, gt: Sequence[float], srs: str, ndv: float, bands: int = 1) -> bytes:
    """A little-endian classic TIFF from DEFLATE-compressed strips, band after band."""
    dtype = np.dtype(dtype)
    if gt[2] or gt[4]:
        place = [(34264, 12, [gt[1], gt[2], 0.0, gt[0], gt[4], gt[5], 0.0, gt[3], *[0.0] * 7, 1.0])]
    else:
        place = [(33550, 12, [gt[1], -gt[5], 0.0]), (33922, 12, [0.0, 0.0, 0.0, gt[0], gt[3], 0.0])]
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    keys = _geo_keys(srs)
    entries: list[tuple[int, int, list | bytes]] = [(256, 4, [ncols]), (257, 4, [nrows]), (258, 3, [dtype.itemsize * 8] * bands), (259, 3, [8]), (262, 3, [1]), (273, 4, [0] * len(strips)), (277, 3, [bands]), (278, 4, [rows_per_strip]), (279, 4, [len(s) for s in strips]), (284, 3, [2 if bands > 1 else 1]), (339, 3, [kind] * bands), *place, *([(34735, 3, keys)] if keys else []), (42113, 2, f"{ndv:.17g}".encode() + b"\0")]
    entries.sort(key=lambda e: e[0])
    raw_of = lambda k, v: v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{_CODES[k]}", *v)
    head = 8 + 2 + 12 * len(entries) + 4
    long = sum(len(raw) + len(raw) % 2 for raw in (raw_of(k, v) for _, k, v in entries) if len(raw) > 4)
    at, places = head + long, []
    for s in strips:
        places.append(at)
        at += len(s)
    if at >= 1 << 32:
        raise ValueError("a classic TIFF holds less than 4 GB")
    fields, extra = b"", b""
    for tag, k, v in entries:
        raw = raw_of(k, places if tag == 273 else v)
        if len(raw) > 4:
            field = struct.pack("<I", head + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            field = raw.ljust(4, b"\0")
        fields += struct.pack("<HHI", tag, k, len(v)) + field
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + fields + b"\0\0\0\0" + extra + b"".join(strips)


def write_geotiff(cells: DataFrame, folder: str, nrows: int, ncols: int, gt: Sequence[float], srs: str = "", ndv: float = -9999.0, dtype: str = "float32", name: str | None = None, band: str | None = None, bands: int = 1, strip_rows: int = 256) -> DataFrame:
    """``path, bytes`` of the GeoTIFF files written, one for each value of the column ``name`` (or one, ``raster.tif``).

    Cells of a column ``band`` (from 1 to ``bands``) become bands.  A file is
    written beside its place and then moved there, so a task that is run again
    leaves no half file.
    """
    kind = np.dtype(dtype).newbyteorder("<")
    rows = cells.where((F.col("r") >= 0) & (F.col("r") < nrows) & (F.col("c") >= 0) & (F.col("c") < ncols))
    rows = rows.select((F.col(name).cast("string") if name else F.lit("raster")).alias("name"), (F.col(band).cast("int") if band else F.lit(1)).alias("band"), F.floor(F.col("r") / strip_rows).cast("int").alias("strip"), "r", "c", F.col("v").cast("double").alias("v"))

    def strip_of(key: tuple, table: pa.Table) -> pa.Table:
        at = key[2].as_py()
        a = np.full((min(strip_rows, nrows - at * strip_rows), ncols), ndv)
        v = table.column("v").to_numpy()
        a[table.column("r").to_numpy() - at * strip_rows, table.column("c").to_numpy()] = np.where(np.isnan(v), ndv, v)
        return pa.table({"name": [key[0].as_py()], "band": pa.array([key[1].as_py()], pa.int32()), "strip": pa.array([at], pa.int32()), "data": pa.array([zlib.compress(a.astype(kind).tobytes(), 6)], pa.binary())})

    def file_of(key: tuple, table: pa.Table) -> pa.Table:
        from pyarrow import fs as pafs

        own = {(b, s): d for b, s, d in zip(table.column("band").to_pylist(), table.column("strip").to_pylist(), table.column("data").to_pylist())}
        strips = []
        for b in range(1, bands + 1):
            for s in range(-(-nrows // strip_rows)):
                empty = lambda s=s: zlib.compress(np.full((min(strip_rows, nrows - s * strip_rows), ncols), ndv).astype(kind).tobytes(), 6)
                strips.append(own.get((b, s)) or empty())
        data = assemble(strips, nrows, ncols, strip_rows, kind, list(gt), srs, ndv, bands)
        files, base = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        files.create_dir(base, recursive=True)
        path = f"{base}/{key[0].as_py()}.tif"
        with files.open_output_stream(part := f"{base}/.{uuid.uuid4().hex}.part") as out:
            out.write(data)
        files.move(part, path)
        return pa.table({"path": [path], "bytes": pa.array([len(data)], pa.int64())})

    strips = rows.groupBy("name", "band", "strip").applyInArrow(strip_of, "name string, band int, strip int, data binary")
    written = strips.groupBy("name").applyInArrow(file_of, "path string, bytes long")
    return cells.sparkSession.createDataFrame(written.collect(), "path string, bytes long")  # a row for each file
