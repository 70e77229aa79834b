"""Vector features as vertex tables ``fid, ring, idx, x, y``: masks, outlines, profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import pixel_to_map
from gridloom.functions.geo import transform as move
from gridloom.model import lattice, shuffled


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """``fid, x1, y1, x2, y2``; rings are closed."""
    w = Window.partitionBy("fid", "ring").orderBy("idx")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(a).over(w), F.first(a).over(every)) for a in ("x", "y"))
    return vertices.select("fid", F.col("x").alias("x1"), F.col("y").alias("y1"), nx.alias("x2"), ny.alias("y2")).where("y1 <> y2")


def boxes_to_vertices(boxes: DataFrame, fid: str = "fid") -> DataFrame:
    corners = F.array(*[F.struct(F.lit(i).alias("idx"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for i, (x, y) in enumerate([("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")])])
    return boxes.select(F.col(fid).alias("fid"), F.lit(0).alias("ring"), F.explode(corners).alias("p")).select("fid", "ring", "p.idx", "p.x", "p.y")


def extents(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("fid").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def rasterize(vertices: DataFrame, nrows: int, ncols: int, gt: list[float]) -> DataFrame:
    """``fid, r, c`` of the cells whose centres are inside (even-odd rule), for north-up grids.

    An edge is sent to the rows it crosses only; between the sorted crossings of
    a row, cells are generated, so no cell meets a polygon it is not in.
    """
    x0, dx, _, y0, _, dy = gt
    e = polygon_edges(vertices)
    lo = F.ceil((F.greatest("y1", "y2") - y0) / dy - 0.5)
    hi = F.floor((F.least("y1", "y2") - y0) / dy - 0.5)
    rows = e.select("*", F.greatest(lo, F.lit(0).cast("long")).alias("a"), F.least(hi, F.lit(nrows - 1).cast("long")).alias("b")).where("a <= b").select("*", F.explode(F.sequence("a", "b")).alias("r"))
    cy = y0 + (F.col("r") + 0.5) * dy
    rows = rows.withColumn("_cy", cy).where((F.col("y1") > F.col("_cy")) != (F.col("y2") > F.col("_cy")))
    x = F.col("x1") + (F.col("_cy") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossed = rows.select("fid", "r", x.alias("x")).groupBy("fid", "r").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.element_at("xs", 2 * i + 1).alias("a"), F.element_at("xs", 2 * i + 2).alias("b")))
    spans = crossed.where(F.size("xs") >= 2).select("fid", "r", F.explode(pairs).alias("s"))
    first = F.greatest(F.ceil((F.col("s.a") - x0) / dx - 0.5), F.lit(0).cast("long"))
    last = F.least(F.ceil((F.col("s.b") - x0) / dx - 0.5) - 1, F.lit(ncols - 1).cast("long"))
    return spans.select("fid", "r", first.alias("a"), last.alias("b")).where("a <= b").select("fid", F.col("r").cast("int").alias("r"), F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int"))).alias("c"))


def heatmap(vertices: DataFrame, nrows: int, ncols: int, gt: list[float]) -> DataFrame:
    """``r, c, n``: how many features cover each cell; uncovered cells have no row."""
    return rasterize(vertices, nrows, ncols, gt).select("fid", "r", "c").distinct().groupBy("r", "c").agg(F.count("*").alias("n"))


def clip_by_polygons(cells: DataFrame, vertices: DataFrame, nrows: int, ncols: int, gt: list[float], invert: bool = False) -> DataFrame:
    inside = rasterize(vertices, nrows, ncols, gt).select("r", "c").distinct()
    return cells.join(shuffled(inside), ["r", "c"], "left_anti" if invert else "left_semi")


def crop(cells: DataFrame, vertices: DataFrame, gt: list[float], pad: float = 0.0) -> DataFrame:
    """Cells whose centres are in the extent of all vertices, widened by ``pad``; rows and columns stay as they are."""
    e = vertices.agg(*[(f(a) + s * pad).alias(f"_{n}{a}") for a in ("x", "y") for n, f, s in (("lo", F.min, -1), ("hi", F.max, 1))])
    x, y = pixel_to_map(gt, F.col("c"), F.col("r"))
    return cells.crossJoin(F.broadcast(e)).where(x.between(F.col("_lox"), F.col("_hix")) & y.between(F.col("_loy"), F.col("_hiy"))).select(cells.columns)


def reproject(vertices: DataFrame, source: str, target: str) -> DataFrame:
    """Vertices in another reference system; other columns stay."""
    x, y = move(source, target)(F.col("x"), F.col("y"))
    return vertices.withColumns({"x": x, "y": y})


def simplify(vertices: DataFrame, tolerance: float, keys: tuple[str, ...] = ("fid", "ring")) -> DataFrame:
    """Each line without the vertices that lie within ``tolerance`` of the line through those kept (Douglas and Peucker); ends stay.

    A line is one group: its vertices meet in one task.
    """

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        p = np.stack([table.column("x").to_numpy(), table.column("y").to_numpy()], axis=1)
        keep = np.zeros(len(p), bool)
        keep[[0, -1]] = True
        todo = [(0, len(p) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d, q = p[b] - p[a], p[a + 1 : b] - p[a]
            length = np.hypot(*d)
            far = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / length if length else np.hypot(q[:, 0], q[:, 1])
            k = int(far.argmax())
            if far[k] > tolerance:
                keep[a + 1 + k] = True
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return table.filter(pa.array(keep))

    return vertices.groupBy(*keys).applyInArrow(one, vertices.schema)


def profile(cells: DataFrame, line: DataFrame, gt: list[float], step: float, key: str = "fid") -> DataFrame:
    """``key, d, x, y, v``: bilinear values each ``step`` along a polyline."""
    from gridloom.operators.points import bilinear

    at = line_points(line, step, key)
    found = bilinear(cells, at.select(F.struct(key, "d", "x", "y").alias("pid"), "x", "y"), gt)
    return found.select("pid.*", "v")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of points and closed boxes that hold them; equi-joined on grid buckets.

    A box goes to buckets of ``size`` times the power of two that lets four of
    them cover it, so a large box is four rows too; a point looks in its bucket of
    each power that some box needs.
    """
    b = lambda v: F.floor(v / (size * F.pow(F.lit(2.0), F.col("_p"))))
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(1e-300))
    sized = boxes.where("xmin <= xmax and ymin <= ymax").withColumn("_p", F.greatest(F.ceil(F.log2(extent / size)), F.lit(0)).cast("int"))
    powers = sorted(r._p for r in sized.select("_p").distinct().collect())  # some tens at most
    cover = sized.withColumn("_bx", F.explode(F.sequence(b(F.col("xmin")), b(F.col("xmax"))))).withColumn("_by", F.explode(F.sequence(b(F.col("ymin")), b(F.col("ymax")))))
    own = points.withColumn("_p", F.explode(F.array(*map(F.lit, powers)).cast("array<int>"))).withColumns({"_bx": b(F.col(x)), "_by": b(F.col(y))})
    return own.join(cover, ["_p", "_bx", "_by"]).where(F.col(x).between(F.col("xmin"), F.col("xmax")) & F.col(y).between(F.col("ymin"), F.col("ymax"))).drop("_p", "_bx", "_by")


def outline(cells: DataFrame, gt: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Vertices of the polygon along the first valid row of each column and back along the last."""
    cols = cells.where("v is not null").groupBy(*keys, "c").agg(F.min("r").alias("top"), F.max("r").alias("bottom"))
    ends = cols.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("c").alias("o"), F.col("c"), F.col("top").alias("r")), F.struct(F.lit(1).alias("side"), (-F.col("c")).alias("o"), F.col("c"), F.col("bottom").alias("r")))).alias("p"))
    x, y = pixel_to_map(gt, F.col("p.c"), F.col("p.r"))
    w = Window.partitionBy(*keys).orderBy("p.side", "p.o")
    return ends.select(*keys, (F.row_number().over(w) - 1).alias("idx"), x.alias("x"), y.alias("y"))


def convex_hull(vertices: DataFrame, keys: tuple[str, ...] = ("fid",)) -> DataFrame:
    """Hull vertices of each feature, anticlockwise; a feature's distinct extreme points per x are reduced first."""
    extreme = vertices.groupBy(*keys, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    pts = F.array_sort(F.flatten(F.collect_list(F.array(F.struct(F.col("x"), F.col("lo").alias("y")), F.struct(F.col("x"), F.col("hi").alias("y"))))))
    cross = lambda o, a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])

    def push(stack: Column, p: Column) -> Column:
        # a point stays if the turn at it is left; dropping repeats until none is dropped
        n = F.size(stack)
        keep = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k <= 1) | (cross(F.element_at(stack, F.greatest(k - 1, F.lit(1))), F.element_at(stack, F.greatest(k, F.lit(1))), p) > 0))
        # left turns along a hull are a prefix, seen from p
        return F.concat(F.when(n > 0, F.slice(stack, 1, F.array_max(keep))).otherwise(stack), F.array(p))

    g = extreme.groupBy(*keys).agg(F.array_distinct(pts).alias("p"))
    empty = F.slice(F.col("p"), 1, 0)
    lower = F.aggregate("p", empty, push)
    upper = F.aggregate(F.reverse("p"), empty, push)
    ring = F.when(F.size("p") > 2, F.concat(F.slice(lower, 1, F.size(lower) - 1), F.slice(upper, 1, F.size(upper) - 1))).otherwise(F.col("p"))
    return g.select(*keys, F.posexplode(ring).alias("idx", "q")).select(*keys, "idx", "q.x", "q.y")


def line_points(vertices: DataFrame, step: float, key: str = "fid") -> DataFrame:
    """``key, d, x, y``: points each ``step`` along a polyline from its start."""
    w = Window.partitionBy(key).orderBy("idx")
    px, py = F.lag("x").over(w), F.lag("y").over(w)
    seg = vertices.withColumns({"px": px, "py": py}).where("px is not null").withColumn("len", F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)).where("len > 0")
    seg = seg.withColumn("end", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("len"))
    k = F.sequence(F.ceil(F.col("start") / step), F.ceil(F.col("end") / step) - 1)
    pts = seg.where(F.ceil(F.col("start") / step) < F.ceil(F.col("end") / step)).select("*", F.explode(k).alias("k")).withColumn("d", F.col("k") * step)
    t = (F.col("d") - F.col("start")) / F.col("len")
    return pts.select(key, F.col("d").cast("double").alias("d"), (F.col("px") + t * (F.col("x") - F.col("px"))).alias("x"), (F.col("py") + t * (F.col("y") - F.col("py"))).alias("y"))


def merge_layers(layers: list[DataFrame]) -> DataFrame:
    """Features of all layers in one table; fields a layer lacks are NULL."""
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def cells_as_boxes(nrows: int, ncols: int, gt: list[float], spark) -> DataFrame:
    x, y = pixel_to_map(gt, F.col("c"), F.col("r"))
    return lattice(spark, nrows, ncols).select("r", "c", x.alias("x"), y.alias("y"))
