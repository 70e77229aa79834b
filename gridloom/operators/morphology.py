"""Mask morphology, edges, trimming and holes.  The cross structure, n times, is the L1 ball of radius n."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import shuffled
from gridloom.operators.neighbourhood import _pairs


def _ball(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if abs(i) + abs(j) <= n]


def dilate(places: DataFrame, n: int, shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """All places within n steps of the given ``r, c``, inside the grid."""
    near = places.select(*keys, "r", "c", F.explode(_pairs(_ball(n))).alias("o")).select(*keys, (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
    return near.where(F.col("r").between(0, shape[0] - 1) & F.col("c").between(0, shape[1] - 1)).distinct()


def valid(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return cells.where("v is not null").select(*keys, "r", "c")


def missing(cells: DataFrame, shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """Places of the grid without a value; ``cells`` must be dense or is made so."""
    from gridloom.model import dense

    return dense(cells, *shape, keys=keys).where("v is null").select(*keys, "r", "c")


def grow_mask(cells: DataFrame, n: int, shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """Cells farther than n steps from every missing cell (mask_erode, erode_edge); the grid's border is not missing."""
    return cells.where("v is not null").join(shuffled(dilate(missing(cells, shape, keys), n, shape, keys)), [*keys, "r", "c"], "left_anti")


def dilate_valid(cells: DataFrame, n: int, shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """Places within n steps of a valid cell (mask_dilate)."""
    return dilate(valid(cells, keys), n, shape, keys)


def close_mask(cells: DataFrame, n: int, shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """The missing places of a closing of the mask (mask_islands): it never loses a missing place, and outside counts as missing."""
    grown = dilate(missing(cells, shape, keys), n, shape, keys)
    free = cells.where("v is not null").select(*keys, "r", "c").join(shuffled(grown), [*keys, "r", "c"], "left_anti")
    back = dilate(free, n, shape, keys)
    every = cells.select(*keys, "r", "c")
    return every.join(shuffled(back), [*keys, "r", "c"], "left_anti").unionByName(missing(cells, shape, keys)).distinct()


def remove_islands(cells: DataFrame, n: int, shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """Cells that survive growing the mask by n and shrinking it back."""
    return cells.join(shuffled(close_mask(cells, n, shape, keys)), [*keys, "r", "c"], "left_anti").where("v is not null")


def bounds(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last row and column with a value (inclusive)."""
    return cells.where("v is not null").groupBy(*keys).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def trim(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cells within the bounds, numbered from zero."""
    b = bounds(cells, keys)
    own = cells.join(b, list(keys)) if keys else cells.crossJoin(F.broadcast(b))
    inside = own.where(F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1")))
    return inside.select(*keys, (F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), "v")


def trimmed_geotransform(meta: DataFrame, bound: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metadata with the origin moved to the first valid cell."""
    own = meta.join(bound, list(keys)) if keys else meta.crossJoin(F.broadcast(bound))
    g = F.col("gt")
    moved = F.array(g[0] + F.col("c0") * g[1] + F.col("r0") * g[2], g[1], g[2], g[3] + F.col("c0") * g[4] + F.col("r0") * g[5], g[4], g[5])
    return own.withColumns({"gt": moved, "nrows": F.col("r1") - F.col("r0") + 1, "ncols": F.col("c1") - F.col("c0") + 1}).drop("r0", "r1", "c0", "c1")


def edges(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The first and last valid cell of each row and of each column."""
    v = valid(cells, keys)
    by_row = v.groupBy(*keys, "r").agg(F.min("c").alias("a"), F.max("c").alias("b")).select(*keys, "r", F.explode(F.array("a", "b")).alias("c"))
    by_col = v.groupBy(*keys, "c").agg(F.min("r").alias("a"), F.max("r").alias("b")).select(*keys, F.explode(F.array("a", "b")).alias("r"), "c")
    return by_row.unionByName(by_col).distinct()


def mask_edges(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return cells.where("v is not null").join(shuffled(edges(cells, keys)), [*keys, "r", "c"], "left_anti")


def enclosed_by_lines(cells: DataFrame, shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """Missing places that have a valid cell on all four sides in their row and column."""
    from gridloom.model import dense

    v = F.col("v").isNotNull().cast("int")
    row, col = Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")
    before, after = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    d = dense(cells, *shape, keys=keys).withColumns({"_a": F.max(v).over(row.rowsBetween(*before)), "_b": F.max(v).over(row.rowsBetween(*after)), "_c": F.max(v).over(col.rowsBetween(*before)), "_d": F.max(v).over(col.rowsBetween(*after))})
    return d.where("v is null and _a = 1 and _b = 1 and _c = 1 and _d = 1").select(*keys, "r", "c")


def holes(cells: DataFrame, shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """Missing places that no path of missing cells joins to the grid's border (maskfill).

    Column runs of missing cells are the nodes: few of them make a raster.
    Runs of neighbouring columns that touch are linked, and one grouped task per
    raster labels the runs; it holds runs, not cells.
    """
    m = missing(cells, shape, keys)
    w = Window.partitionBy(*keys, "c").orderBy("r")
    runs = m.withColumn("_g", F.col("r") - F.row_number().over(w)).groupBy(*keys, "c", "_g").agg(F.min("r").alias("r0"), F.max("r").alias("r1")).drop("_g")
    own = list(keys)
    schema = ", ".join([*(f"{k} {cells.schema[k].dataType.simpleString()}" for k in own), "c int, r0 int, r1 int"])

    def inner(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["c", "r0"], ignore_index=True)
        c, a, b = (frame[x].to_numpy() for x in ("c", "r0", "r1"))
        parent = np.arange(len(frame) + 1)  # the last is the border

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        border = len(frame)
        for i in np.flatnonzero((c == 0) | (c == shape[1] - 1) | (a == 0) | (b == shape[0] - 1)):
            parent[find(i)] = find(border)
        start = np.searchsorted(c, np.arange(shape[1] + 1))
        for col in range(shape[1] - 1):
            i, j = start[col], start[col + 1]
            while i < start[col + 1] and j < start[col + 2 if col + 2 <= shape[1] else col + 1]:
                if a[i] <= b[j] and a[j] <= b[i]:
                    parent[find(i)] = find(j)
                if b[i] < b[j]:
                    i += 1
                else:
                    j += 1
        keep = np.array([find(i) != find(border) for i in range(border)], bool)
        return frame[keep][[*own, "c", "r0", "r1"]]

    found = runs.select(*own, F.col("c").cast("int"), F.col("r0").cast("int"), F.col("r1").cast("int"))
    grouped = found.groupBy(*own) if own else found.withColumn("_one", F.lit(1)).groupBy("_one")
    labelled = grouped.applyInPandas(inner, schema)
    return labelled.select(*own, F.explode(F.sequence("r0", "r1")).alias("r"), "c")


def fill_holes(cells: DataFrame, fill: DataFrame, shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """Cells plus the values of ``fill`` at the holes."""
    at = holes(cells, shape, keys)
    return cells.where("v is not null").unionByName(fill.join(shuffled(at), [*keys, "r", "c"], "left_semi").select(*cells.columns))

