"""Rasters on another grid: the destination's cells are mapped back to the source and weighted there."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geo import apply_gt, map_to_pixel
from gridloom.functions.geo import transform as move
from gridloom.model import lattice, shuffled
from gridloom.operators import tiles

ALGORITHMS = {"near": 1, "nearest": 1, "bilinear": 2, "cubic": 4, "cubicspline": 4, "lanczos": 6, "average": 0, "mode": 0}


@dataclass(frozen=True)
class Grid:
    nrows: int
    ncols: int
    gt: tuple[float, ...]
    srs: str = ""

    @property
    def extent(self) -> tuple[float, float, float, float]:
        x0, dx, _, y0, _, dy = self.gt
        return x0, y0 + dy * self.nrows, x0 + dx * self.ncols, y0

    @property
    def res(self) -> float:
        return (abs(self.gt[1]) + abs(self.gt[5])) / 2


def grid_for(extent: tuple[float, float, float, float], res: float, srs: str = "") -> Grid:
    return Grid(round((extent[3] - extent[1]) / res), round((extent[2] - extent[0]) / res), (extent[0], res, 0.0, extent[3], 0.0, -res), srs)


def parse_res(res: str | float | Grid, grids: list[Grid]) -> float:
    """Metadata only: a keyword, a number or another grid."""
    if isinstance(res, Grid):
        return res.res
    all_ = [g.res for g in grids]
    named: dict[str, Callable[[], float]] = {"first": lambda: all_[0], "last": lambda: all_[-1], "min": lambda: min(all_), "max": lambda: max(all_), "mean": lambda: sum(all_) / len(all_), "med": lambda: (sorted(all_)[(len(all_) - 1) // 2] + sorted(all_)[len(all_) // 2]) / 2, "common_scale_factor": lambda: (max(all_) / min(all_)) ** 0.5 * min(all_), "source": lambda: all_[0]}
    return named[res]() if isinstance(res, str) and res in named else float(res)  # type: ignore[arg-type]


def parse_extent(extent: str | tuple | Grid, grids: list[Grid]) -> tuple[float, float, float, float]:
    """Metadata only: first, last, union, intersection, four numbers or another grid."""
    if isinstance(extent, Grid):
        return extent.extent
    if not isinstance(extent, str):
        return tuple(map(float, extent))  # type: ignore[return-value]
    e = [g.extent for g in grids]
    if extent in ("first", "source"):
        return e[0]
    if extent == "last":
        return e[-1]
    if extent == "union":
        return min(x[0] for x in e), min(x[1] for x in e), max(x[2] for x in e), max(x[3] for x in e)
    if extent == "intersection":
        out = max(x[0] for x in e), max(x[1] for x in e), min(x[2] for x in e), min(x[3] for x in e)
        if out[0] >= out[2] or out[1] >= out[3]:
            raise ValueError("the extents have nothing in common")
        return out
    return tuple(float(x) for x in extent.split())  # type: ignore[return-value]


def parse_srs(srs: str | Grid, grids: list[Grid]) -> str:
    if isinstance(srs, Grid):
        return srs.srs
    return grids[0].srs if srs in ("first", "source") else grids[-1].srs if srs == "last" else srs


def same_grid(a: Grid, b: Grid, step: float = 1e-3) -> bool:
    near = lambda p, q: round(p / step) == round(q / step)
    return a.srs == b.srs and near(a.res, b.res) and all(map(near, a.extent, b.extent))


def _weights(d: np.ndarray, algorithm: str) -> np.ndarray:
    a = np.abs(d)
    if algorithm == "bilinear":
        return np.maximum(1 - a, 0.0)
    if algorithm == "lanczos":
        return np.where(a < 3, np.sinc(a) * np.sinc(a / 3), 0.0)
    if algorithm == "cubicspline":
        return np.where(a < 1, 2 / 3 - a * a + a**3 / 2, np.where(a < 2, (2 - a) ** 3 / 6, 0.0))
    return np.where(a < 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0.0))


def warp(cells: DataFrame, src: Grid, dst: Grid, algorithm: str = "cubic", transform: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """``r, c, v`` on ``dst``; cells without a valid source are left out.

    ``transform`` maps destination x, y to source x, y; without one it follows
    from the two reference systems, and unknown ones are an error (systems that
    are not named count as the same).  Weights are renormalised over valid source
    cells.  The same grid is passed through, so its cells are not shuffled.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm}")
    forward = None
    if transform is None and src.srs and dst.srs and src.srs != dst.srs:
        transform, forward = move(dst.srs, src.srs), move(src.srs, dst.srs)
    if transform is None and same_grid(src, dst) and (src.nrows, src.ncols) == (dst.nrows, dst.ncols):
        return cells.where("v is not null").select("r", "c", "v")
    if algorithm in ("average", "mode"):
        if transform is not None and forward is None:
            raise ValueError("average and mode need to know the reference systems")
        x, y = apply_gt(list(src.gt), F.col("c") + 0.5, F.col("r") + 0.5)
        if forward is not None:
            x, y = forward(x, y)
        px, py = map_to_pixel(list(dst.gt), x, y)
        at = cells.where("v is not null").select(F.rint(py).cast("int").alias("r"), F.rint(px).cast("int").alias("c"), "v")
        at = at.where(F.col("r").between(0, dst.nrows - 1) & F.col("c").between(0, dst.ncols - 1))
        return at.groupBy("r", "c").agg((F.avg("v") if algorithm == "average" else F.mode("v", True)).alias("v"))
    x, y = apply_gt(list(dst.gt), F.col("c") + 0.5, F.col("r") + 0.5)
    if transform is not None:
        x, y = transform(x, y)
    px, py = map_to_pixel(list(src.gt), x, y)
    at = lattice(cells.sparkSession, dst.nrows, dst.ncols).select("r", "c", px.alias("_x"), py.alias("_y"))
    s = cells.where("v is not null").select(F.col("r").alias("_r"), F.col("c").alias("_c"), "v")
    taps = ALGORITHMS[algorithm]
    if taps == 1:
        near = at.select("r", "c", F.rint("_y").cast("int").alias("_r"), F.rint("_x").cast("int").alias("_c"))
        return shuffled(near).join(shuffled(s), ["_r", "_c"]).select("r", "c", "v")
    # a destination cell goes to the tile of the source cell before it, a source cell to its tile and those it borders
    half, size = taps // 2, tiles.SIZE
    ty, tx = F.floor("_y").cast("int"), F.floor("_x").cast("int")
    reach = at.where((ty >= -half) & (ty < src.nrows + half) & (tx >= -half) & (tx < src.ncols + half))
    asked = reach.select(F.floor(ty / size).cast("int").alias("tr"), F.floor(tx / size).cast("int").alias("tc"), "r", "c", "_y", "_x")
    held = tiles.spread(cells.where("v is not null"), half, (), size)

    def gather(wanted: pa.Table, given: pa.Table) -> pa.Table:
        r, c = wanted.column("r").to_numpy(), wanted.column("c").to_numpy()
        out = np.full(len(r), np.nan)
        if given.num_rows and len(r):
            tr, tc = given.column("tr")[0].as_py(), given.column("tc")[0].as_py()
            v, _ = tiles.dense(given, tr, tc, half, size)
            y, x = wanted.column("_y").to_numpy() - (tr * size - half), wanted.column("_x").to_numpy() - (tc * size - half)
            i, j = np.floor(y).astype(int), np.floor(x).astype(int)
            s, w = np.zeros(len(r)), np.zeros(len(r))
            for di in range(1 - half, half + 1):
                wi = _weights(y - (i + di), algorithm)
                for dj in range(1 - half, half + 1):
                    own = v[i + di, j + dj]
                    k = np.where(np.isnan(own), 0.0, wi * _weights(x - (j + dj), algorithm))
                    s += k * np.where(np.isnan(own), 0.0, own)
                    w += k
                    some = k != 0
                    out[some] = 0.0  # a weight that counts
            with np.errstate(invalid="ignore", divide="ignore"):
                out = np.where(np.isnan(out) | (w == 0), np.nan, s / w)
        keep = ~np.isnan(out)
        return pa.table({"r": pa.array(r[keep]), "c": pa.array(c[keep]), "v": pa.array(out[keep])})

    return asked.groupBy("tr", "tc").cogroup(held.groupBy("tr", "tc")).applyInArrow(gather, "r int, c int, v double")


def reprojected(spark: SparkSession, grid: Grid, srs: str, along: int = 20) -> Grid:
    """The extent of a grid, by points along its edges, and its resolution, by its diagonal, in another system.  Metadata only."""
    if not grid.srs or not srs or grid.srs == srs:
        return grid
    x0, y0, x1, y1 = grid.extent
    edge = [(x0 + (x1 - x0) * i / along, y0 + (y1 - y0) * j / along) for i in range(along + 1) for j in range(along + 1) if {i, j} & {0, along}]
    x, y = move(grid.srs, srs)(F.col("x"), F.col("y"))
    got = [(r.x, r.y) for r in spark.createDataFrame([*edge, (x0, y1), (x1, y0)], "x double, y double").coalesce(1).select(x.alias("x"), y.alias("y")).collect()]
    xs, ys = [p[0] for p in got], [p[1] for p in got]
    (ax, ay), (bx, by) = got[-2:]
    res = math.hypot(bx - ax, by - ay) / math.hypot(grid.ncols, grid.nrows)
    out = min(xs), min(ys), max(xs), max(ys)
    return Grid(max(1, round((out[3] - out[1]) / res)), max(1, round((out[2] - out[0]) / res)), (out[0], res, 0.0, out[3], 0.0, -res), srs)


def warp_multi(rasters: list[tuple[DataFrame, Grid]], res: str | float = "first", extent: str | tuple = "intersection", srs: str = "first", algorithm: str = "cubic") -> tuple[list[DataFrame], Grid]:
    """All rasters on one grid that keywords over their metadata decide; extents and resolutions are compared in its system."""
    srs = parse_srs(srs, [g for _, g in rasters])
    grids = [reprojected(c.sparkSession, g, srs) for c, g in rasters]
    dst = grid_for(parse_extent(extent, grids), parse_res(res, grids), srs)
    return [warp(c, g, dst, algorithm) for c, g in rasters], dst
