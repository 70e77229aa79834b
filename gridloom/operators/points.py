"""Points to cells, cells at points, and surfaces fitted to cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import map_to_pixel, pixel_to_map
from gridloom.model import lattice, shuffled
from gridloom.operators.neighbourhood import _pairs
from gridloom.operators.stats import NMAD, _with, percentiles

STATS: dict[str, Callable[[str], Column]] = {"median": F.median, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count, "sum": F.sum, "std": F.stddev_pop}

#: Columns of a grid that are filled from one start.
STRIP = 4096


def block_stats(points: DataFrame, x0: float, y0: float, res: float, nrows: int, ncols: int, stat: str | Callable[[str], Column] = "median", x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """``r, c, x, y, n, v``: a statistic of the points in each cell of a north-up grid; empty cells have no row."""
    f = STATS[stat] if isinstance(stat, str) else stat
    c = F.floor((F.col(x) - x0) / res).cast("int")
    r = F.floor((y0 - F.col(y)) / res).cast("int")
    inside = points.where(F.col(z).isNotNull()).select(r.alias("r"), c.alias("c"), F.col(z).alias("z")).where(F.col("r").between(0, nrows - 1) & F.col("c").between(0, ncols - 1))
    out = inside.groupBy("r", "c").agg(F.count("z").alias("n"), f("z").alias("v"))
    cx, cy = pixel_to_map([x0, res, 0.0, y0, 0.0, -res], F.col("c"), F.col("r"))
    return out.select("r", "c", cx.alias("x"), cy.alias("y"), "n", "v")


def block_stats_grid(points: DataFrame, x0: float, y0: float, res: float, nrows: int, ncols: int, stat: str = "median", **names: str) -> DataFrame:
    """The same on every cell of the grid.

    Cells with points and the starts of strips of a row are shuffled, the empty
    cells behind each of them are made from it: the grid itself never moves.
    """
    s = block_stats(points, x0, y0, res, nrows, ncols, stat, **names).select("r", "c", "v")
    starts = lattice(points.sparkSession, nrows, -(-ncols // STRIP)).select("r", (F.col("c") * STRIP).alias("c"), F.lit(None).cast(s.schema["v"].dataType).alias("v"))
    both = s.withColumn("_own", F.lit(1)).unionByName(starts.withColumn("_own", F.lit(0))).withColumn("_s", F.expr(f"c div {STRIP}"))
    after = F.lead("c").over(Window.partitionBy("r", "_s").orderBy("c", "_own"))
    last = (F.coalesce(after, F.least((F.col("_s") + 1) * STRIP, F.lit(ncols))) - 1).cast("int")
    runs = both.select("r", "c", "v", last.alias("_last")).where("_last >= c")
    return runs.select("r", F.col("c").alias("_c"), "v", F.explode(F.sequence("c", "_last")).alias("c")).select("r", "c", F.when(F.col("c") == F.col("_c"), F.col("v")).alias("v"))


def sample(cells: DataFrame, points: DataFrame, gt: list[float], pad: int = 0, min_percent: float = 50.0, circular: bool = False, x: str = "x", y: str = "y", pid: str = "pid") -> DataFrame:
    """``pid, n, med, nmad`` of the cells around each point; NULL where fewer than a share of the window is valid.

    Points are turned into cells, so this is an equi-join; the nearest cell is
    found by rounding half to even.
    """
    px, py = map_to_pixel(gt, F.col(x), F.col(y))
    off = [(i, j) for i in range(-pad, pad + 1) for j in range(-pad, pad + 1) if not circular or i * i + j * j <= pad * pad]
    need = len(off) * min_percent / 100.0
    at = points.select(F.col(pid).alias("pid"), F.rint(py).cast("int").alias("_r"), F.rint(px).cast("int").alias("_c"))
    if len(off) == 1:
        got = at.join(shuffled(cells.select(F.col("r").alias("_r"), F.col("c").alias("_c"), "v")), ["_r", "_c"], "left")
        return got.select("pid", F.when(F.col("v").isNotNull(), 1).otherwise(0).cast("long").alias("n"), F.col("v").alias("med"), F.when(F.col("v").isNotNull(), 0.0).alias("nmad"))
    spread = at.select("pid", F.explode(_pairs(off)).alias("o"), "_r", "_c").select("pid", (F.col("_r") + F.col("o.i")).alias("r"), (F.col("_c") + F.col("o.j")).alias("c"))
    got = shuffled(spread).join(shuffled(cells.where("v is not null").select("r", "c", "v")), ["r", "c"])
    vs = got.groupBy("pid").agg(F.array_sort(F.collect_list("v")).alias("_v"))  # at most the window's cells
    from gridloom.operators.stack import _array_median

    med = vs.withColumn("n", F.size("_v").cast("long")).withColumn("med", _array_median(F.col("_v")))
    med = med.withColumn("nmad", _array_median(F.array_sort(F.transform("_v", lambda v: F.abs(v - F.col("med"))))) * NMAD)
    ok = F.coalesce(F.col("n") >= need, F.lit(False))
    return at.select("pid").join(shuffled(med), "pid", "left").select("pid", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(ok, F.col("med")).alias("med"), F.when(ok, F.col("nmad")).alias("nmad"))


def bilinear(cells: DataFrame, points: DataFrame, gt: list[float], x: str = "x", y: str = "y", pid: str = "pid") -> DataFrame:
    """``pid, v``: interpolation between the four nearest centres; NULL if one is missing."""
    px, py = map_to_pixel(gt, F.col(x), F.col(y))
    at = points.select(F.col(pid).alias("pid"), px.alias("_x"), py.alias("_y")).withColumns({"_c0": F.floor("_x").cast("int"), "_r0": F.floor("_y").cast("int")})
    four = at.select("pid", "_x", "_y", "_c0", "_r0", F.explode(_pairs([(0, 0), (0, 1), (1, 0), (1, 1)])).alias("o"))
    fx, fy = F.col("_x") - F.col("_c0"), F.col("_y") - F.col("_r0")
    w = F.when(F.col("o.j") == 1, fx).otherwise(1 - fx) * F.when(F.col("o.i") == 1, fy).otherwise(1 - fy)
    keyed = four.select("pid", (F.col("_r0") + F.col("o.i")).alias("r"), (F.col("_c0") + F.col("o.j")).alias("c"), w.alias("w"))
    got = keyed.join(shuffled(cells.select("r", "c", "v")), ["r", "c"], "left")
    need = F.count(F.when((F.col("w") != 0) & F.col("v").isNull(), 1))
    return got.groupBy("pid").agg(F.when(need == 0, F.sum(F.col("w") * F.coalesce("v", F.lit(0.0)))).alias("v"))


def inverse_distance(cells: DataFrame, shape: tuple[int, int], reach: int = 3, power: float = 2.0) -> DataFrame:
    """Holes filled by inverse distance weights of valid cells in reach (in place of triangulation)."""
    off = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i, j) != (0, 0)]
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit((i * i + j * j) ** (-power / 2)).alias("w")) for i, j in off])
    near = cells.where("v is not null").select("v", "r", "c", F.explode(pairs).alias("o")).select((F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"), F.col("o.w").alias("w"), "v")
    near = near.where(F.col("r").between(0, shape[0] - 1) & F.col("c").between(0, shape[1] - 1)).groupBy("r", "c").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("_f"))
    return cells.where("v is not null").select("r", "c", "v").join(near, ["r", "c"], "full").select("r", "c", F.coalesce("v", "_f").alias("v"))


def fit_polynomial(points: DataFrame, order: int = 1, tensor: bool = False, perc: tuple[float, float] | None = (2, 98), x: str = "x", y: str = "y", z: str = "z") -> dict[tuple[int, int], float]:
    """Coefficients of x**i y**j by least squares, from one aggregate of moments.

    A plane is order 1; ``tensor`` has all i, j up to the order.  Points with z
    outside the percentiles are left out.  x and y are centred and scaled for the solution.
    """
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"))
    if perc:
        lim = percentiles(p.select(F.col("z").alias("v")), perc).withColumnRenamed("p", "_p")
        p = p.crossJoin(F.broadcast(lim)).where(F.col("z").between(F.col("_p")[0], F.col("_p")[1])).select("x", "y", "z")
    c = p.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).first()
    sx, sy = c.sx or 1.0, c.sy or 1.0
    u, w = (F.col("x") - (c.mx or 0.0)) / sx, (F.col("y") - (c.my or 0.0)) / sy
    terms = [(i, j) for i in range(order + 1) for j in range(order + 1) if tensor or i + j <= order]
    powers = sorted({(a[0] + b[0], a[1] + b[1]) for a in terms for b in terms})
    row = p.agg(*[F.coalesce(F.sum(F.pow(u, F.lit(float(i))) * F.pow(w, F.lit(float(j)))), F.lit(0.0)).alias(f"m{i}_{j}") for i, j in powers], *[F.coalesce(F.sum(F.col("z") * F.pow(u, F.lit(float(i))) * F.pow(w, F.lit(float(j)))), F.lit(0.0)).alias(f"z{i}_{j}") for i, j in terms]).first()
    m = np.array([[row[f"m{a[0] + b[0]}_{a[1] + b[1]}"] for b in terms] for a in terms])
    k = np.linalg.lstsq(m, np.array([row[f"z{i}_{j}"] for i, j in terms]), rcond=None)[0]
    out: dict[tuple[int, int], float] = {}
    from math import comb

    for (i, j), v in zip(terms, k):  # undo the scaling
        for a in range(i + 1):
            for b in range(j + 1):
                t = v * comb(i, a) * comb(j, b) * (-(c.mx or 0.0)) ** (i - a) * (-(c.my or 0.0)) ** (j - b) / sx**i / sy**j
                out[(a, b)] = out.get((a, b), 0.0) + float(t)
    return out


def polynomial(coefficients: dict[tuple[int, int], float], x: Column, y: Column) -> Column:
    out = F.lit(0.0)
    for (i, j), k in coefficients.items():
        out = out + k * F.pow(x, F.lit(float(i))) * F.pow(y, F.lit(float(j)))
    return out


def plane_residuals(points: DataFrame, plane: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """The points with ``fit`` (the plane's value, for all of them) and ``residual`` (z minus it)."""
    fit = F.col("_a") * F.col(x) + F.col("_b") * F.col(y) + F.col("_c")
    one = plane.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("c").alias("_c"))
    return points.crossJoin(F.broadcast(one)).withColumn("fit", fit).withColumn("residual", F.col(z) - F.col("fit")).drop("_a", "_b", "_c")


def plane_fit(points: DataFrame, keys: Sequence[str] = (), x: str = "x", y: str = "y", z: str = "z", perc: tuple[float, float] | None = (2, 98)) -> DataFrame:
    """``a, b, c, n`` of z = a x + b y + c for each key, as one aggregate and expressions; z outside the percentiles is left out."""
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    if perc:
        lim = percentiles(p.select(*keys, F.col(z).alias("v")), perc, keys).withColumnRenamed("p", "_p")
        p = _with(p, lim, keys).where(F.col(z).between(F.col("_p")[0], F.col("_p")[1])).drop("_p")
    x, y, z = (F.col(n).cast("double") for n in (x, y, z))
    m = p.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), F.covar_pop(x, x).alias("xx"), F.covar_pop(y, y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"))
    det = F.nullif(F.col("xx") * F.col("yy") - F.col("xy") ** 2, F.lit(0.0))
    a = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det
    b = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    return m.select(*keys, "n", a.alias("a"), b.alias("b"), (F.col("mz") - a * F.col("mx") - b * F.col("my")).alias("c"))
