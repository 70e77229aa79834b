"""Filters that mask cells; none un-masks a cell, and the lattice is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import pixel_to_map
from gridloom.model import shuffled
from gridloom.operators.stats import _with, median_nmad, percentiles


def keep_where(cells: DataFrame, condition: Column) -> DataFrame:
    return cells.withColumn("v", F.when(F.coalesce(condition, F.lit(False)), F.col("v")))


def in_range(cells: DataFrame, a: float, b: float) -> DataFrame:
    """Closed range, bounds in either order."""
    return keep_where(cells, F.col("v").between(min(a, b), max(a, b)))


def in_abs_range(cells: DataFrame, a: float, b: float) -> DataFrame:
    return keep_where(cells, F.abs("v").between(min(a, b), max(a, b)))


def _limited(cells: DataFrame, limits: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    own = _with(cells, limits, keys)
    lo, hi = F.col("_lo"), F.col("_hi")
    inside = (F.col("v") > lo) & (F.col("v") < hi) if strict else F.col("v").between(lo, hi)
    return keep_where(own, inside).drop("_lo", "_hi")


def by_percentiles(cells: DataFrame, lo: float = 1.0, hi: float = 99.0, keys: Sequence[str] = ()) -> DataFrame:
    p = percentiles(cells, (lo, hi), keys).select(*keys, F.col("p")[0].alias("_lo"), F.col("p")[1].alias("_hi"))
    return _limited(cells, p, keys)


def by_sigma(cells: DataFrame, n: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    m, s = F.avg("v"), F.stddev_pop("v")
    return _limited(cells, cells.groupBy(*keys).agg((m - n * s).alias("_lo"), (m + n * s).alias("_hi")), keys)


def by_nmad(cells: DataFrame, n: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    m = median_nmad(cells, keys).select(*keys, (F.col("med") - n * F.col("nmad")).alias("_lo"), (F.col("med") + n * F.col("nmad")).alias("_hi"))
    return _limited(cells, m, keys)


def by_robust_spread(cells: DataFrame, sigma: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    """Strictly within the median -+ sigma times half the 16-84 percentile range."""
    p = percentiles(cells, (16, 50, 84), keys)
    half = (F.col("p")[2] - F.col("p")[0]) / 2
    return _limited(cells, p.select(*keys, (F.col("p")[1] - sigma * half).alias("_lo"), (F.col("p")[1] + sigma * half).alias("_hi")), keys, strict=True)


def by_reference_difference(cells: DataFrame, reference: DataFrame, perc: tuple[float, float] | None = None, limits: tuple[float, float] = (0.0, 30.0), keys: Sequence[str] = ()) -> DataFrame:
    """Masks where reference minus value is out of percentiles, or its size out of limits; no reference keeps the cell."""
    dz = cells.join(shuffled(reference.select(*keys, "r", "c", F.col("v").alias("_ref"))), [*keys, "r", "c"], "left").withColumn("_dz", F.col("_ref") - F.col("v"))
    bad = (F.abs("_dz") < limits[0]) | (F.abs("_dz") > limits[1])
    if perc:
        p = percentiles(dz.select(*keys, F.col("_dz").alias("v")), perc, keys).withColumnRenamed("p", "_p")
        dz = _with(dz, p, keys)
        bad = bad | ~F.col("_dz").between(F.col("_p")[0], F.col("_p")[1])
    return dz.withColumn("v", F.when(~F.coalesce(bad, F.lit(False)), F.col("v"))).select(*keys, "r", "c", "v")


def by_reference_range(cells: DataFrame, reference: DataFrame, pad: float = 30.0) -> DataFrame:
    """Within the reference's extremes, widened by ``pad``."""
    lim = reference.agg((F.min("v") - pad).alias("_lo"), (F.max("v") + pad).alias("_hi"))
    return _limited(cells, lim, ())


def by_mask(cells: DataFrame, mask: DataFrame, mask_value: float | None = None, invert: bool = False) -> DataFrame:
    """Mask with another raster.

    With ``mask_value``: cells where the mask differs are masked.  Else, a mask
    raster that varies masks where it has no value, and a constant one where it is zero
    (missing counts as zero) if that is anywhere, or where it is not.
    """
    m = mask.select("r", "c", F.col("v").alias("_m"))
    both = cells.join(shuffled(m), ["r", "c"], "left")
    if mask_value is not None:
        out = F.coalesce(F.col("_m") != mask_value, F.lit(True))
    else:
        kind = mask.agg(F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("_sd"), F.coalesce(F.max(F.coalesce("v", F.lit(0.0)) == 0), F.lit(True)).alias("_zero"))
        both = both.crossJoin(F.broadcast(kind))
        zero = F.coalesce("_m", F.lit(0.0)) == 0
        out = F.when(F.col("_sd") != 0, F.col("_m").isNull()).when(F.col("_zero"), zero).otherwise(~zero)
    return both.withColumn("v", F.when(out if invert else ~out, F.col("v"))).select("r", "c", "v")


def valid_xyz(cells: DataFrame, gt: Sequence[float] | None = None) -> DataFrame:
    """``x, y, z`` of valid cells: map coordinates of their centres, or columns and rows without a geotransform."""
    x, y = (F.col("c"), F.col("r")) if gt is None else pixel_to_map(list(gt), F.col("c"), F.col("r"))
    return cells.where("v is not null").select(x.alias("x"), y.alias("y"), F.col("v").alias("z"))


def by_slope(cells: DataFrame, res: float, limits: tuple[float, float] = (0.0, 40.0)) -> DataFrame:
    """Keeps cells whose slope in degrees is within the limits; cells without a slope (edges, beside holes) go."""
    from gridloom.operators.neighbourhood import slope

    lim = slope(cells, res).where(F.col("v").between(*limits)).select("r", "c")
    return cells.join(shuffled(lim.withColumn("_ok", F.lit(True))), ["r", "c"], "left").withColumn("v", F.when(F.col("_ok"), F.col("v"))).select("r", "c", "v")


def random_fill(cells: DataFrame, seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Holes filled with normal noise of the raster's mean and standard deviation."""
    own = _with(cells, cells.groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s")), keys)
    return own.withColumn("v", F.coalesce("v", F.randn(seed) * F.col("_s") + F.col("_m"))).drop("_m", "_s")


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """a - b where both have a value."""
    return shuffled(a).join(shuffled(b.select(*keys, "r", "c", F.col("v").alias("_b"))), [*keys, "r", "c"]).select(*keys, "r", "c", (F.col("v") - F.col("_b")).alias("v"))


