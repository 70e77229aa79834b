"""The data model: rasters as tables of cells, with a small metadata table.

A cell is ``(keys..., r, c, v)``; ``v`` NULL, or no row, means missing.  ``keys``
(raster, band, layer) let one plan work on any number of rasters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: GDAL pixel types by number, and the Spark type that holds all their values.
PIXEL_TYPES = {1: ("Byte", "smallint"), 2: ("UInt16", "int"), 3: ("Int16", "smallint"), 4: ("UInt32", "bigint"), 5: ("Int32", "int"), 6: ("Float32", "float"), 7: ("Float64", "double")}


def masked(v: Column, ndv: Column | float | None) -> Column:
    """NULL where the value is nodata (within 1e-5 relative), NaN or infinite."""
    v = v.cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    if ndv is not None:
        n = ndv if isinstance(ndv, Column) else F.lit(float(ndv))
        bad = bad | F.coalesce(F.abs(v - n) <= 1e-8 + 1e-5 * F.abs(n), F.lit(False))
    return F.when(~bad, v)


def fill_nodata(v: Column, ndv: float) -> Column:
    return F.coalesce(v, F.lit(float(ndv)))


def infer_nodata(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, ndv``: the first corner if it is NaN or equals the last corner, else 0."""
    corner = cells.groupBy(*keys).agg(F.min("r").alias("_r0"), F.min("c").alias("_c0"), F.max("r").alias("_r1"), F.max("c").alias("_c1"))
    with_ = cells.join(corner, list(keys)) if keys else cells.crossJoin(corner)
    first = F.max(F.when((F.col("r") == F.col("_r0")) & (F.col("c") == F.col("_c0")), F.col("v")))
    last = F.max(F.when((F.col("r") == F.col("_r1")) & (F.col("c") == F.col("_c1")), F.col("v")))
    return with_.groupBy(*keys).agg(F.when(F.isnan(first) | (first == last), first).otherwise(0.0).alias("ndv"))


def shuffled(cells: DataFrame) -> DataFrame:
    """The same rows, never broadcast in a join: cells that are generated or come out of arrays are many more than Spark's estimate."""
    return cells.hint("merge")


def lattice(spark: SparkSession, nrows: int, ncols: int) -> DataFrame:
    """All cells of a grid; rows are generated in parallel."""
    return spark.range(nrows).select(F.col("id").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(ncols - 1))).alias("c"))


def dense(cells: DataFrame, nrows: int, ncols: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every cell of the grid for each key, NULL where there was no row."""
    grid = lattice(cells.sparkSession, nrows, ncols)
    if keys:
        grid = cells.select(*keys).distinct().crossJoin(grid)
    return grid.join(shuffled(cells.select(*keys, "r", "c", "v")), [*keys, "r", "c"], "left")


def grid_of(xmin: float, ymin: float, xmax: float, ymax: float, res: float) -> dict:
    """Size and geotransform of an empty grid over an extent."""
    return {"nrows": int((ymax - ymin) / res + 0.99), "ncols": int((xmax - xmin) / res + 0.99), "gt": [xmin, res, 0.0, ymax, 0.0, -res]}


def decimate(cells: DataFrame, scale: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every ``scale``-th cell in both directions (a nearest, subsampled read)."""
    return cells.where((F.col("r") % scale == 0) & (F.col("c") % scale == 0)).select(*keys, F.expr(f"cast(r div {scale} as int)").alias("r"), F.expr(f"cast(c div {scale} as int)").alias("c"), "v")


def sub_dim(nrows: int, ncols: int, scale: float | None = None, maxdim: int | None = 1024) -> tuple[int, int, float]:
    """Columns, rows and scale of a subsampled read."""
    if scale is None:
        scale = max(1.0, max(nrows, ncols) / maxdim) if maxdim else 1.0
    return int(-(-ncols // scale)), int(-(-nrows // scale)), float(scale)


def to_tiles(cells: DataFrame, size: int = 256, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, tr, tc, data``: the cells of each tile, sorted by row and column."""
    tile = cells.select(*keys, F.expr(f"cast(r div {size} as int)").alias("tr"), F.expr(f"cast(c div {size} as int)").alias("tc"), F.struct("r", "c", "v").alias("x"))
    return tile.groupBy(*keys, "tr", "tc").agg(F.array_sort(F.collect_list("x")).alias("data"))


def from_tiles(tiles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return tiles.select(*keys, F.explode("data").alias("x")).select(*keys, "x.r", "x.c", "x.v")


def clip_and_reindex(cells: DataFrame, r0: int, r1: int, c0: int, c1: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows r0..r1 and columns c0..c1 (inclusive), numbered from zero; keys without a valid cell left go."""
    inside = cells.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1)).select(*keys, (F.col("r") - r0).alias("r"), (F.col("c") - c0).alias("c"), "v")
    if not keys:
        return inside
    return inside.join(inside.where("v is not null").select(*keys).distinct(), list(keys), "left_semi")
