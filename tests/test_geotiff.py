"""GeoTIFF: round trips through the writer, and files made by hand for what it does not write."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import geotiff

GT = [10.0, 2.0, 0.0, 20.0, 0.0, -2.0]


def lzw_encode(data):
    """A plain encoder that clears its table before codes get long."""
    codes, table, now = [256], {bytes([i]): i for i in range(256)}, b""
    for byte in data:
        more = now + bytes([byte])
        if more in table:
            now = more
            continue
        codes.append(table[now])
        table[more] = len(table) + 2
        if len(table) + 2 >= 4094:
            codes.append(256)
            table = {bytes([i]): i for i in range(256)}
        now = bytes([byte])
    codes += [table[now], 257] if now else [257]
    bits, n, width, size = 0, 0, 9, 258
    out = bytearray()
    for k, c in enumerate(codes):
        bits, n = bits << width | c, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
        if c == 256:
            width, size = 9, 258
        else:
            size += codes[k - 1] != 256
            width = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def tiff(blocks, entries, order="<"):
    """A file of some blocks; entries are (tag, kind, values)."""
    entries = sorted([*entries, (324 if any(t == 322 for t, _, _ in entries) else 273, 4, None), (325 if any(t == 322 for t, _, _ in entries) else 279, 4, [len(b) for b in blocks])])
    head = 8 + 2 + 12 * len(entries) + 4
    code = {2: "s", 3: "H", 4: "I", 12: "d"}
    raw = [b"" if v is None else struct.pack(f"{order}{len(v)}{code[k]}", *v) if k != 2 else v for _, k, v in entries]
    raw = [struct.pack(f"{order}{len(blocks)}I", *[0] * len(blocks)) if v is None else r for r, (_, _, v) in zip(raw, entries)]
    long = sum(len(r) + len(r) % 2 for r in raw if len(r) > 4)
    at = head + long + np.cumsum([0, *map(len, blocks)])[:-1]
    extra, fields = b"", b""
    for r, (tag, k, v) in zip(raw, entries):
        if v is None:
            r = struct.pack(f"{order}{len(blocks)}I", *at.tolist())
        n = len(blocks) if v is None else len(v)
        if len(r) > 4:
            fields += struct.pack(order + "HHII", tag, k, n, head + len(extra))
            extra += r + b"\0" * (len(r) % 2)
        else:
            fields += struct.pack(order + "HHI", tag, k, n) + r.ljust(4, b"\0")
    magic = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 42)
    return magic + struct.pack(order + "IH", 8, len(entries)) + fields + b"\0\0\0\0" + extra + b"".join(blocks)


def image(data):
    t = geotiff.Tiff(data)
    out = np.full((t.bands, t.nrows, t.ncols), np.nan)
    for band, r, c, block in t.blocks():
        out[band - 1, r : r + block.shape[0], c : c + block.shape[1]] = block
    return out


BASE = [(256, 4, [7]), (257, 4, [5]), (262, 3, [1])]
A = (np.arange(35).reshape(5, 7) * 37 % 251).astype(np.uint8)


@pytest.mark.parametrize("compression", [1, 5, 8, 32773, 50000])
def test_compressions(compression):
    import zstandard

    pack = {1: lambda x: x, 5: lzw_encode, 8: zlib.compress, 32773: lambda x: b"".join(bytes([0, b]) for b in x) + b"\x80", 50000: zstandard.compress}[compression]
    data = tiff([pack(A[:3].tobytes()), pack(A[3:].tobytes())], [*BASE, (258, 3, [8]), (259, 3, [compression]), (277, 3, [1]), (278, 4, [3]), (339, 3, [1])])
    assert (image(data)[0] == A).all()


def test_lzw_of_long_runs():
    rng = np.random.default_rng(0)
    for data in (b"", b"a", bytes(5000), rng.integers(0, 256, 9000, dtype=np.uint8).tobytes(), b"abcabcabd" * 700):
        assert geotiff.lzw_decode(lzw_encode(data)) == data


def test_predictors_tiles_bands_and_byte_orders():
    two = (np.stack([A, A[::-1]]).astype(np.int16) * 3).astype(">i2")
    diff = np.diff(A.astype(np.int16), axis=1, prepend=0).astype(np.uint8)
    assert (image(tiff([zlib.compress(diff.tobytes())], [*BASE, (258, 3, [8]), (259, 3, [8]), (277, 3, [1]), (278, 4, [5]), (317, 3, [2]), (339, 3, [1])]))[0] == A).all()
    chunky = np.ascontiguousarray(two.transpose(1, 2, 0))
    common = [*BASE, (258, 3, [16, 16]), (259, 3, [1]), (277, 3, [2]), (278, 4, [5]), (339, 3, [2, 2])]
    assert (image(tiff([chunky.tobytes()], [*common, (284, 3, [1])], ">")) == two).all()
    assert (image(tiff([two[0].tobytes(), two[1].tobytes()], [*common, (284, 3, [2])], ">")) == two).all()
    f = (A * 1.5).astype("<f4")
    planes = np.frombuffer(f.astype(">f4").tobytes(), np.uint8).reshape(5, 7, 4).transpose(0, 2, 1).reshape(5, 28)
    fp = np.diff(planes.astype(np.int16), axis=1, prepend=0).astype(np.uint8)
    assert (image(tiff([zlib.compress(fp.tobytes())], [*BASE, (258, 3, [32]), (259, 3, [8]), (277, 3, [1]), (278, 4, [5]), (317, 3, [3]), (339, 3, [3])]))[0] == f).all()
    tiles = []
    for r in (0, 4):
        for c in (0, 4):
            t = np.zeros((4, 4), np.uint8)
            part = A[r : r + 4, c : c + 4]
            t[: part.shape[0], : part.shape[1]] = part
            tiles.append(zlib.compress(t.tobytes()))
    assert (image(tiff(tiles, [*BASE, (258, 3, [8]), (259, 3, [8]), (277, 3, [1]), (322, 4, [4]), (323, 4, [4]), (339, 3, [1])]))[0] == A).all()


@pytest.mark.parametrize("dtype", ["float32", "float64", "int16", "uint8"])
def test_round_trip(spark, tmp_path, dtype):
    rows = [(n, b, r, c, None if (r + c) % 5 == 0 else float(r + 2 * c + 3 * b)) for n in ("x", "y") for b in (1, 2) for r in range(23) for c in range(11)]
    cells = spark.createDataFrame(rows, "n string, b int, r int, c int, v double")
    ndv = 255.0 if dtype == "uint8" else -9999.0
    files = geotiff.write_geotiff(cells, f"file://{tmp_path}/out", 23, 11, GT, "EPSG:32610", ndv, dtype, "n", "b", 2, strip_rows=8)
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["x.tif", "y.tif"]
    info = {r.path.rsplit("/", 1)[1]: r for r in geotiff.geotiff_info(spark, str(tmp_path / "out/*.tif")).collect()}["x.tif"]
    assert (info.nrows, info.ncols, info.bands, info.gt, info.srs, info.ndv, info.dtype) == (23, 11, 2, GT, "EPSG:32610", ndv, dtype)
    got = geotiff.read_geotiff(spark, str(tmp_path / "out/*.tif")).select(F.regexp_extract("path", r"(\w)\.tif$", 1).alias("n"), "band", "r", "c", "v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert geotiff.read_geotiff(spark, str(tmp_path / "out/x.tif"), dense=False).count() == sum(n == "x" and v is not None for n, _, _, _, v in rows)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        geotiff.Tiff(b"GIF89a" + bytes(50))
