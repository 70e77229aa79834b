"""Nodata-aware statistics of rasters; missing cells never count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import shuffled

NMAD = 1.4826


def _with(cells: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with the row of their key; without keys there is one row, which is broadcast."""
    return cells.join(stats, list(keys)) if keys else cells.crossJoin(F.broadcast(stats))


def basic_stats(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """count, min, max, ptp, mean, std (population), rmse."""
    v = F.col("v")
    return cells.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("vmin"), F.max(v).alias("vmax"), (F.max(v) - F.min(v)).alias("ptp"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rmse"))


#: Relative accuracy of the sketches that bracket an order statistic: a bracket holds some 1 / 2,500 of the values.
ACCURACY = 10_000


def percentiles(cells: DataFrame, at: Sequence[float], keys: Sequence[str] = (), empty: float | None = None) -> DataFrame:
    """``keys, p``: array of exact, linearly interpolated percentiles (0 to 100), NULL (or ``empty``) without values.

    Exact without any task that sees all values of a key: mergeable sketches
    bracket each percentile, all values outside the brackets are only counted, and
    just the distinct values inside are sorted.  A hot value is one row there.
    A sketch depends on the order of its rows, which is not the same each time a
    table is read or fetched, so all is counted in one pass behind one sketch.
    """
    keys = list(keys)
    values = cells.select(*keys, F.col("v").cast("double").alias("v"))
    eps = 2.0 / ACCURACY
    around = [min(1.0, max(0.0, a / 100 + e)) for a in at for e in (-eps, eps)]
    brackets = values.groupBy(*keys).agg(F.percentile_approx("v", F.array(*map(F.lit, around)), F.lit(ACCURACY)).alias("_q"))
    if keys:
        own = brackets.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_q")
        known = values.join(own, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]))
    else:
        known = values.crossJoin(F.broadcast(brackets))
    # where a value lies: 0 below, 1 inside, 2 above each bracket, as the digits of one number
    v, q, every = F.col("v"), F.col("_q"), range(len(at))
    sides = known.select(*keys, "v", *[((v >= q[2 * i]).cast("long") + (v > q[2 * i + 1]).cast("long")).alias(f"_s{i}") for i in every])
    digits = reduce(add, [F.col(f"_s{i}") * F.lit(3**i).cast("long") for i in every])
    inside = F.when(reduce(or_, [F.col(f"_s{i}") == 1 for i in every]), v)
    counts = sides.groupBy(*keys, digits.alias("_d"), inside.alias("_in")).agg(F.count("v").alias("_k"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_t"), F.lit(a / 100).alias("_a"), F.expr(f"_d div {3**i} % 3").alias("_s")) for i, a in enumerate(at)])).alias("_e")
    parts = counts.select(*keys, each, "_in", "_k", "_lo", "_hi").groupBy(*keys, "_e._t", "_e._a", "_e._s", F.when(F.col("_e._s") == 1, F.col("_in")).alias("_x")).agg(F.sum("_k").alias("_k"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    of = Window.partitionBy(*keys, "_t")
    ranked = parts.withColumns({"_upto": F.sum("_k").over(of.orderBy("_s", "_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_n": F.sum("_k").over(of)}).withColumn("_h", (F.col("_n") - 1) * F.col("_a"))
    low, upto, s = F.floor("_h"), F.col("_upto"), F.col("_s")
    before = upto - F.col("_k")

    def ranks(k: Column) -> Column:
        """The value of rank k (from 0): one inside, the last below or the first above."""
        known = F.when(s == 1, F.col("_x")).when((s == 0) & (k == upto - 1), F.col("_hi")).when((s == 2) & (k == before), F.col("_lo"))
        return F.max(F.when((before <= k) & (k < upto), known.otherwise(F.raise_error(F.lit("a sketch is less accurate than it should be")).cast("double"))))

    got = ranked.groupBy(*keys, "_t").agg(F.max("_h").alias("_h"), ranks(low).alias("_v0"), ranks(F.least(low + 1, F.col("_n") - 1)).alias("_v1"))
    value = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_h") - low)
    out = got.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", value.alias("x")))), lambda s: s["x"]).alias("p"))
    fallback = F.lit(None).cast("double") if empty is None else F.lit(float(empty))
    return out.select(*keys, F.when(F.exists("p", lambda x: x.isNotNull()), F.col("p")).otherwise(F.lit(None) if empty is None else F.array(*[fallback] * len(at))).alias("p"))


def symmetric_limit(cells: DataFrame, at: Sequence[float] = (0.1, 99.9), keys: Sequence[str] = ()) -> DataFrame:
    """``lo, hi`` = -m, m with m the larger absolute percentile."""
    m = F.greatest(F.abs(F.col("p")[0]), F.abs(F.col("p")[1]))
    return percentiles(cells, at, keys, 0.0).select(*keys, (-m).alias("lo"), m.alias("hi"))


def median_nmad(cells: DataFrame, keys: Sequence[str] = (), factor: float = NMAD) -> DataFrame:
    """``n, med, nmad``: the median and the scaled median absolute deviation from it.

    Keys are few and may be hot; where each key has a handful of values,
    :func:`gridloom.operators.stack.stack_stats` is the way.
    """
    keys = list(keys)
    own = cells.where("v is not null").select(*keys, "v")
    med = percentiles(own, (50,), keys).select(*keys, F.col("p")[0].alias("med"))
    away = _with(own, med, keys)
    size = away.groupBy(*keys).agg(F.count("v").alias("n"), F.first("med").alias("med"))
    dev = percentiles(away.select(*keys, F.abs(F.col("v") - F.col("med")).alias("v")), (50,), keys).select(*keys, (F.col("p")[0] * factor).alias("nmad"))
    return (size.join(dev, keys, "left") if keys else size.crossJoin(dev)).select(*keys, "n", "med", "nmad")


def mode(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, mode``: the most frequent value, the smallest of several."""
    counts = cells.where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("k"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("k")).alias("k"), "v"))["v"].alias("mode"))


def full_stats(cells: DataFrame, keys: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """All statistics of rasters, without a task that sees all values of one.

    ``approximate`` replaces exact percentiles by sketches alone.
    """
    keys = list(keys)
    q = (16, 25, 50, 75, 84)
    first = cells.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    sketch = lambda df, at: df.groupBy(*keys).agg(F.percentile_approx("v", F.array(*[F.lit(a / 100) for a in at]), F.lit(ACCURACY)).alias("p"))
    of = sketch if approximate else lambda df, at: percentiles(df, at, keys)
    p = of(cells, q).select(*keys, F.col("p").alias("_p"))
    away = _with(cells.where("v is not null"), p.select(*keys, F.col("_p")[2].alias("_med")), keys)
    dev = of(away.select(*keys, F.abs(F.col("v") - F.col("_med")).alias("v")), (50,)).select(*keys, (F.col("p")[0] * NMAD).alias("nmad"))
    both = first
    for other in (p, dev, mode(cells, keys)):
        both = both.join(other, keys, "left") if keys else both.crossJoin(other)
    x = F.col("_p")
    return both.select(*keys, "n", "vmin", "vmax", (F.col("vmax") - F.col("vmin")).alias("ptp"), "mean", "std", "nmad", x[2].alias("med"), x[1].alias("q1"), x[3].alias("q3"), (x[3] - x[1]).alias("iqr"), x[0].alias("p16"), x[4].alias("p84"), (F.abs(x[4] - x[0]) / 2).alias("spread"), "mode")


def describe(stats: DataFrame) -> DataFrame:
    """``line``: the statistics as text."""
    return stats.select(F.format_string("count: %d min: %.2f max: %.2f mean: %.2f std: %.2f med: %.2f nmad: %.2f", "n", "vmin", "vmax", "mean", "std", "med", "nmad").alias("line"))


def circular_error_90(x: str | Column, y: str | Column) -> Column:
    """CE90 of two error columns, as an aggregate."""
    x, y = (F.col(a) if isinstance(a, str) else a for a in (x, y))
    rx, ry = F.sqrt(F.avg(x * x)), F.sqrt(F.avg(y * y))
    ratio = F.least(rx, ry) / F.nullif(F.greatest(rx, ry), F.lit(0.0))
    return F.when((ratio > 0.6) & (ratio < 1), 2.146 * 0.5 * (rx + ry)).otherwise(2.146 * F.sqrt(rx * rx + ry * ry))


def linear_error_90(z: str) -> Column:
    return F.lit(1.6449) * F.sqrt(F.avg(F.col(z) * F.col(z)))


def is_empty(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*keys).agg((F.count("v") == 0).alias("empty"))


def common_mask(cells: DataFrame, layer: str, n_layers: int) -> DataFrame:
    """``r, c, missing``: whether any of the layers misses the cell."""
    return cells.groupBy("r", "c").agg((F.count("v") < n_layers).alias("missing"))


def apply_common_mask(cells: DataFrame, layer: str, n_layers: int) -> DataFrame:
    return cells.join(shuffled(common_mask(cells, layer, n_layers).where("not missing").select("r", "c")), ["r", "c"], "left_semi")


# --- bins -----------------------------------------------------------------


def bin_x_by_z(points: DataFrame, x: str, z: str, width: float) -> DataFrame:
    """Statistics of x for each bin of z: left edge, centre, count, median, NMAD, mean, std."""
    b = points.where(F.col(x).isNotNull() & F.col(z).isNotNull()).select((F.floor(F.col(z) / width) * width).cast("double").alias("edge"), F.col(x).alias("v"))
    m = median_nmad(b, ["edge"]).select("edge", "med", "nmad")
    s = b.groupBy("edge").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return s.join(m, "edge").withColumn("center", F.col("edge") + width / 2)


def equal_bins(points: DataFrame, x: str, y: str, nbins: int = 128, stat=F.avg) -> DataFrame:
    """``bin`` (from 1), ``n``, ``stat`` of y over equal bins of x between its extremes; the last bin is closed."""
    p = points.where(F.col(x).isNotNull())
    lim = p.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    b = p.crossJoin(F.broadcast(lim)).select(F.least(F.width_bucket(F.col(x).cast("double"), F.col("_lo").cast("double"), F.col("_hi").cast("double"), F.lit(nbins)), F.lit(nbins).cast("long")).alias("bin"), F.col(y).alias("y"))
    return b.groupBy("bin").agg(F.count("y").alias("n"), stat("y").alias("stat"))


def hist2d(points: DataFrame, x: str, y: str, nx: int = 128, ny: int = 128, limits: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``bx, by, n``: counts of non-empty bins; limits default to the 0.1 and 99.9 percentiles of both."""
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if limits is None:
        lim = None
        for n in ("x", "y"):
            own = percentiles(p.select(F.col(n).alias("v")), (0.1, 99.9)).select(F.col("p")[0].alias(f"{n}0"), F.col("p")[1].alias(f"{n}1"))
            lim = own if lim is None else lim.crossJoin(own)
        p = p.crossJoin(F.broadcast(lim))
    else:
        p = p.select("*", *[F.lit(float(v)).alias(n) for v, n in zip(limits, ("x0", "x1", "y0", "y1"))])
    p = p.where((F.col("x").between(F.col("x0"), F.col("x1"))) & (F.col("y").between(F.col("y0"), F.col("y1"))))
    bx = F.least(F.width_bucket("x", "x0", "x1", F.lit(nx)), F.lit(nx).cast("long"))
    by = F.least(F.width_bucket("y", "y0", "y1", F.lit(ny)), F.lit(ny).cast("long"))
    return p.groupBy(bx.alias("bx"), by.alias("by")).agg(F.count("*").alias("n"))


def bin_edges(cells: DataFrame, width: float = 100.0) -> DataFrame:
    """``edge``: bin edges that cover the percentiles 0.01 to 99.99."""
    p = percentiles(cells, (0.01, 99.99))
    lo, hi = F.floor(F.col("p")[0] / width), F.ceil(F.col("p")[1] / width)
    return p.select(F.explode(F.sequence(lo, hi)).alias("k")).select((F.col("k") * width).cast("double").alias("edge"))
