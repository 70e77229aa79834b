"""Neighbourhoods by tiles: cells are shuffled once, to square tiles with a border of their neighbours' cells.

A tile is a dense NumPy array of bounded size, whatever the raster; only cells
within ``halo`` of a tile's edge are sent twice (four times at corners).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 256
#: Numbers that a window statistic holds at once.
_AT_ONCE = 4_000_000

Work = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _tiles(r: Column, c: Column, halo: int, size: int) -> Column:
    """Array of (tr, tc): the tile of a cell, and those whose border it is in."""

    def along(x: Column) -> Column:
        t, at = F.floor(x / size).cast("int"), F.pmod(x, F.lit(size))
        return F.filter(F.array(F.when(at < halo, t - 1), t, F.when(at >= size - halo, t + 1)), lambda y: y.isNotNull())

    return F.flatten(F.transform(along(r), lambda i: F.transform(along(c), lambda j: F.struct(i.alias("tr"), j.alias("tc")))))


def spread(cells: DataFrame, halo: int, keys: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """``keys, tr, tc, r, c, v``: each cell in every tile that needs it."""
    if halo >= size:
        raise ValueError(f"a tile of {size} cells is too small for a reach of {halo}")
    t = F.explode(_tiles(F.col("r"), F.col("c"), halo, size)).alias("_t")
    return cells.select(*keys, t, "r", "c", F.col("v").cast("double").alias("v")).select(*keys, "_t.tr", "_t.tc", "r", "c", "v")


def dense(table: pa.Table, tr: int, tc: int, halo: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, NaN where missing; whether there is a row) of a tile and its border."""
    n = size + 2 * halo
    v, row = np.full((n, n), np.nan), np.zeros((n, n), bool)
    r = table.column("r").to_numpy() - (tr * size - halo)
    c = table.column("c").to_numpy() - (tc * size - halo)
    v[r, c] = table.column("v").to_numpy()
    row[r, c] = True
    return v, row


def by_tile(cells: DataFrame, halo: int, work: Work, keep_mask: bool = True, shape: tuple[int, int] | None = None, keys: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """``keys, r, c, v`` where ``work`` (values, rows; both with the border) gives a number for a tile's own cells.

    ``keep_mask`` has valid cells only, ``shape`` cells inside of it only.
    """
    schema = ", ".join([*(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys), "r int, c int, v double"])
    n_keys = len(keys)

    def one(key: tuple, table: pa.Table) -> pa.Table:
        tr, tc = key[n_keys].as_py(), key[n_keys + 1].as_py()
        v, row = dense(table, tr, tc, halo, size)
        out = work(v, row)
        wanted = ~np.isnan(out)
        if keep_mask:
            wanted &= ~np.isnan(v[halo : halo + size, halo : halo + size])
        i, j = np.nonzero(wanted)
        r, c = i + tr * size, j + tc * size
        if shape:
            inside = (r >= 0) & (r < shape[0]) & (c >= 0) & (c < shape[1])
            i, j, r, c = i[inside], j[inside], r[inside], c[inside]
        same = [pa.array([k.as_py()] * len(r), table.schema.field(name).type) for k, name in zip(key, keys)]
        return pa.Table.from_arrays([*same, pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(out[i, j])], names=[*keys, "r", "c", "v"])

    return spread(cells, halo, keys, size).groupBy(*keys, "tr", "tc").applyInArrow(one, schema)


# --- what is done in a tile -------------------------------------------------


def _median(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = np.sort(w, axis=-1)  # NaN goes last
    at = lambda k: np.take_along_axis(w, np.maximum(k, 0)[..., None], axis=-1)[..., 0]
    return (at((n - 1) // 2) + at(n // 2)) / 2


#: Statistics of windows (NaN for missing) by the aggregate they stand for.
WINDOW_STATS: dict[Callable, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    F.median: _median,
    F.avg: lambda w, n: np.nansum(w, axis=-1) / n,
    F.mean: lambda w, n: np.nansum(w, axis=-1) / n,
    F.sum: lambda w, n: np.nansum(w, axis=-1),
    F.max: lambda w, n: np.where(np.isnan(w), -np.inf, w).max(axis=-1),
    F.min: lambda w, n: np.where(np.isnan(w), np.inf, w).min(axis=-1),
    F.count: lambda w, n: n.astype(float),
    F.stddev_pop: lambda w, n: np.sqrt(np.nansum((w - (np.nansum(w, axis=-1) / n)[..., None]) ** 2, axis=-1) / n),
}


def windows_of(stat: Callable, offsets: list[tuple[int, int]], halo: int, whole: bool = False, size: int = SIZE) -> Work:
    """Work that takes ``stat`` over the cells at some offsets; ``whole`` wants a row at each of them."""
    f = WINDOW_STATS[stat]
    di, dj = np.array([i for i, _ in offsets]), np.array([j for _, j in offsets])

    def work(v: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.full((size, size), np.nan)
        step = max(1, _AT_ONCE // (size * len(offsets)))
        j = np.arange(size)[None, :, None] + halo + dj[None, None, :]
        for a in range(0, size, step):
            i = np.arange(a, min(size, a + step))[:, None, None] + halo + di[None, None, :]
            w = v[i, j]
            n = (~np.isnan(w)).sum(axis=-1)
            with np.errstate(invalid="ignore", divide="ignore"):
                part = np.where(n > 0, f(w, n), np.nan)
            if whole:
                part = np.where(row[i, j].all(axis=-1), part, np.nan)
            out[a : a + step] = part
        return out

    return work


def gaussian_of(kernel: Sequence[float], size: int = SIZE) -> Work:
    """Work that shares the weights of missing cells among valid ones, along one axis after the other."""
    half = len(kernel) // 2

    def work(v: np.ndarray, row: np.ndarray) -> np.ndarray:
        valid = ~np.isnan(v)
        s, w = np.where(valid, v, 0.0), valid.astype(float)
        line = lambda x: sum(k * x[:, o : o + size] for o, k in enumerate(kernel))
        s, w = line(s), line(w)
        down = lambda x: sum(k * x[o : o + size] for o, k in enumerate(kernel))
        s, w = down(s), down(w)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(w > 0, s / w, np.nan)

    assert half < size
    return work
