"""Neighbourhood filters.  Sparse tables of cells in, holes inside reach filled unless told otherwise.

Windows and kernels work on tiles with a border (:mod:`gridloom.operators.tiles`),
so cells are shuffled about once however large the window is; a box mean is two
range windows.  Only a statistic that is not known there, an aggregate of the
caller's own, scatters each cell to the cells it serves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import shuffled
from gridloom.operators import tiles


def _offsets(radius: int, circular: bool) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if not circular or i * i + j * j <= radius * radius]


def circular_offsets(size: int, legacy: bool = False) -> list[tuple[int, int]]:
    """Offsets of a disc; ``legacy`` is centred half a cell up and left, as odd sizes once were."""
    centre = size / 2 if legacy else (size - 1) / 2
    return [(i - size // 2, j - size // 2) for i in range(size) for j in range(size) if (i - centre) ** 2 + (j - centre) ** 2 <= (size / 2) ** 2]


def _pairs(offsets: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])


def scatter(cells: DataFrame, offsets: list[tuple[int, int]], keys: Sequence[str] = ()) -> DataFrame:
    """Each valid cell at every place that has it in its window."""
    return cells.where("v is not null").select(*keys, "r", "c", "v", F.explode(_pairs(offsets)).alias("o")).select(*keys, (F.col("r") - F.col("o.i")).alias("r"), (F.col("c") - F.col("o.j")).alias("c"), "v")


def rolling(cells: DataFrame, stat=F.median, size: int = 3, circular: bool = False, keep_mask: bool = True, shape: tuple[int, int] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``stat`` (a function of a column name) of the valid cells around each cell.

    ``keep_mask`` leaves missing cells missing, else holes in reach are filled
    within ``shape`` (rows, columns).
    """
    rad = size // 2
    offsets = _offsets(rad, circular and size > 3)
    if stat in tiles.WINDOW_STATS and rad < tiles.SIZE:
        return tiles.by_tile(cells, rad, tiles.windows_of(stat, offsets, rad), keep_mask, shape, keys)
    served = scatter(cells, offsets, keys)
    if shape:
        served = served.where(F.col("r").between(0, shape[0] - 1) & F.col("c").between(0, shape[1] - 1))
    out = served.groupBy(*keys, "r", "c").agg(stat("v").alias("v"))
    if not keep_mask:
        return out
    return out.join(shuffled(cells.where("v is not null").select(*keys, "r", "c")), [*keys, "r", "c"], "left_semi")


def _line_window(keys: Sequence[str], fixed: str, along: str, radius: int) -> Window:
    return Window.partitionBy(*keys, fixed).orderBy(along).rangeBetween(-radius, radius)


def box_mean(cells: DataFrame, size: int = 7, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the valid cells in a box, at valid cells; two range windows, no copies."""
    rad = size // 2
    w1, w2 = _line_window(keys, "r", "c", rad), _line_window(keys, "c", "r", rad)
    rows = cells.withColumns({"_s": F.sum("v").over(w1), "_n": F.count("v").over(w1)})
    both = rows.withColumns({"_s2": F.sum("_s").over(w2), "_n2": F.sum("_n").over(w2)})
    return both.select(*keys, "r", "c", F.when(F.col("v").isNotNull(), F.col("_s2") / F.col("_n2")).alias("v"))


def gauss_kernel(sigma: float, size: int | None = None, oversample: int = 10) -> list[float]:
    """One-dimensional kernel, each weight the mean over sub-samples of its cell."""
    if size is None:
        size = math.ceil((6 * sigma + 1) / 2) * 2 - 1
    half = size // 2
    subs = [(k + 0.5) / oversample - 0.5 for k in range(oversample)]
    k = [sum(math.exp(-((x + s) ** 2) / (2 * sigma * sigma)) for s in subs) / oversample for x in range(-half, half + 1)]
    total = sum(k)
    return [x / total for x in k]


def sigma_of(size: int) -> float:
    return (max(3, size | 1) - 1) / 6


def gaussian(cells: DataFrame, sigma: float | None = None, size: int | None = None, keep_mask: bool = True, shape: tuple[int, int] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Nodata-aware Gaussian: weights of missing cells are shared among valid ones; separable, 3 sigma each side."""
    if sigma is None:
        sigma = sigma_of(size) if size else 1.0
    kernel = gauss_kernel(sigma, (size | 1) if size else None)
    return tiles.by_tile(cells, len(kernel) // 2, tiles.gaussian_of(kernel), keep_mask, shape, keys)


def gaussian_fill(cells: DataFrame, sigma: float = 1.0, shape: tuple[int, int] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Smoothed values in holes only."""
    smooth = gaussian(cells, sigma, keep_mask=False, shape=shape, keys=keys).withColumnRenamed("v", "_g")
    return cells.join(shuffled(smooth), [*keys, "r", "c"], "full").select(*keys, "r", "c", F.coalesce("v", "_g").alias("v"))


def gaussian_pyramid(cells: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """About log2(size) rounds of a five-cell Gaussian and halving."""
    for _ in range(max(1, round(math.log2(size)))):
        cells = gaussian(cells, size=5, keys=keys).where("r % 2 = 0 and c % 2 = 0").select(*keys, F.expr("cast(r div 2 as int)").alias("r"), F.expr("cast(c div 2 as int)").alias("c"), "v")
    return cells


def lowpass(cells: DataFrame, sigma: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    return gaussian(cells, sigma, keys=keys)


def highpass(cells: DataFrame, sigma: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Value minus its Gaussian, lifted so that nothing is below zero."""
    low = gaussian(cells, sigma, keys=keys).withColumnRenamed("v", "_g")
    high = shuffled(cells.where("v is not null")).join(shuffled(low), [*keys, "r", "c"]).select(*keys, "r", "c", (F.col("v") - F.col("_g")).alias("v"))
    least = high.groupBy(*keys).agg(F.least(F.min("v"), F.lit(0.0)).alias("_m"))
    both = high.join(least, list(keys)) if keys else high.crossJoin(F.broadcast(least))
    return both.select(*keys, "r", "c", (F.col("v") - F.col("_m")).alias("v"))


def bandpass(cells: DataFrame, sigma1: float, sigma2: float, keys: Sequence[str] = ()) -> DataFrame:
    return highpass(lowpass(cells, sigma2, keys), sigma1, keys)


def stack_smooth(cells: DataFrame, size: int = 7) -> DataFrame:
    return gaussian(cells, size=size, keys=["layer"])


def block_view(cells: DataFrame, h: int, w: int, stat=F.avg, keys: Sequence[str] = ()) -> DataFrame:
    """``stat`` of non-overlapping blocks of h by w cells."""
    return cells.groupBy(*keys, F.expr(f"cast(r div {h} as int)").alias("r"), F.expr(f"cast(c div {w} as int)").alias("c")).agg(stat("v").alias("v"))


def sliding(cells: DataFrame, h: int, w: int, step: int = 1, stat=F.avg, keys: Sequence[str] = ()) -> DataFrame:
    """``stat`` of full windows whose upper-left cell is a multiple of ``step``."""
    off = [(i, j) for i in range(h) for j in range(w)]
    if stat in tiles.WINDOW_STATS and max(h, w) <= tiles.SIZE:
        halo = max(h, w) - 1
        full = tiles.by_tile(cells, halo, tiles.windows_of(stat, off, halo, whole=True), keep_mask=False, keys=keys)
        return full.where((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") % step == 0) & (F.col("c") % step == 0))
    got = cells.select(*keys, "r", "c", "v", F.explode(_pairs(off)).alias("o")).select(*keys, (F.col("r") - F.col("o.i")).alias("r"), (F.col("c") - F.col("o.j")).alias("c"), "v").where((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") % step == 0) & (F.col("c") % step == 0))
    return got.groupBy(*keys, "r", "c").agg(F.count("*").alias("_n"), stat("v").alias("v")).where(F.col("_n") == h * w).drop("_n")


def rolling_series(series: DataFrame, n: int, stat=F.avg, order: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """``stat`` over trailing windows of n rows; rows without a full window go."""
    w = Window.partitionBy(*keys).orderBy(order)
    return series.withColumns({"_i": F.row_number().over(w), "stat": stat("val").over(w.rowsBetween(-(n - 1), 0))}).where(F.col("_i") >= n).drop("_i")


# --- terrain (Horn 3x3) -----------------------------------------------------

_NAMES = ["a", "b", "c3", "d", "e", "f", "g", "h", "i"]


def _three_by_three(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns a..i of each cell that has all nine; two window passes over sorted lines."""
    wr = Window.partitionBy(*keys, "r").orderBy("c")
    wc = Window.partitionBy(*keys, "c").orderBy("r")

    def near(col: str, shift: int, w: Window, axis: str) -> Column:
        f = F.lag if shift < 0 else F.lead
        return F.when(f(axis, 1).over(w) == F.col(axis) + shift, f(col, 1).over(w))

    h = cells.withColumns({"_w": near("v", -1, wr, "c"), "_e": near("v", 1, wr, "c")})
    cols = {}
    for name, col in (("a", "_w"), ("b", "v"), ("c3", "_e")):
        cols[name] = near(col, -1, wc, "r")
    for name, col in (("g", "_w"), ("h", "v"), ("i", "_e")):
        cols[name] = near(col, 1, wc, "r")
    full = h.withColumns(cols).withColumnsRenamed({"_w": "d", "_e": "f"}).withColumn("e", F.col("v"))
    return full.dropna(subset=_NAMES)


def gradients(cells: DataFrame, res: float = 1.0, scale: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """``dzdx, dzdy``: Horn's weighted differences; ``scale`` is 111120 for degrees."""
    n = _three_by_three(cells, keys)
    x = ((F.col("c3") + 2 * F.col("f") + F.col("i")) - (F.col("a") + 2 * F.col("d") + F.col("g"))) / (8 * res * scale)
    y = ((F.col("g") + 2 * F.col("h") + F.col("i")) - (F.col("a") + 2 * F.col("b") + F.col("c3"))) / (8 * res * scale)
    return n.select(*keys, "r", "c", "v", x.alias("dzdx"), y.alias("dzdy"))


def slope(cells: DataFrame, res: float = 1.0, scale: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Degrees from the horizontal."""
    g = gradients(cells, res, scale, keys)
    return g.select(*keys, "r", "c", F.degrees(F.atan(F.sqrt(F.col("dzdx") ** 2 + F.col("dzdy") ** 2))).alias("v"))


def aspect(cells: DataFrame, res: float = 1.0, scale: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Degrees clockwise from north that the slope faces; missing where it is flat."""
    g = gradients(cells, res, scale, keys)
    a = F.pmod(F.lit(90.0) - F.degrees(F.atan2("dzdy", -F.col("dzdx"))), F.lit(360.0))
    return g.select(*keys, "r", "c", F.when((F.col("dzdx") != 0) | (F.col("dzdy") != 0), a).alias("v"))


def hillshade(cells: DataFrame, res: float = 1.0, scale: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, z: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Illumination, 1 to 255."""
    g = gradients(cells, res, scale, keys)
    zen, az = math.radians(90 - altitude), math.radians(azimuth)
    x, y = F.col("dzdx") * z, F.col("dzdy") * z
    slope_, facing = F.atan(F.sqrt(x * x + y * y)), F.atan2(y, -x)
    # bearing of the light, turned into the mathematical angle
    lit = math.cos(zen) * F.cos(slope_) + math.sin(zen) * F.sin(slope_) * F.cos(math.pi / 2 - az - facing)
    return g.select(*keys, "r", "c", (1 + 254 * F.greatest(lit, F.lit(0.0))).alias("v"))


def _around(cells: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    return _three_by_three(cells, keys).select(*keys, "r", "c", value.alias("v"))


_OTHERS = [n for n in _NAMES if n != "e"]


def ruggedness(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """TRI: mean absolute difference from the eight neighbours."""
    return _around(cells, keys, sum((F.abs(F.col(n) - F.col("e")) for n in _OTHERS), F.lit(0.0)) / 8)


def position_index(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """TPI: value minus the mean of the eight neighbours."""
    return _around(cells, keys, F.col("e") - sum((F.col(n) for n in _OTHERS), F.lit(0.0)) / 8)


def roughness(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Largest difference among the nine cells."""
    return _around(cells, keys, F.greatest(*_NAMES) - F.least(*_NAMES))


def color_relief(cells: DataFrame, stops: DataFrame) -> DataFrame:
    """The colour of the highest stop at or below the value; ``stops(level, color)`` is a short table."""
    table = stops.agg(F.array_sort(F.collect_list(F.struct("level", "color"))).alias("_s"))
    own = cells.crossJoin(F.broadcast(table))
    return own.select("r", "c", F.try_element_at(F.filter("_s", lambda s: s["level"] <= F.col("v")), F.lit(-1))["color"].alias("color"))
