"""Command line over Parquet cell tables: ``python -m gridloom.cli TOOL ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import model
from gridloom.functions import geo
from gridloom.functions.timefns import datetime_in_name
from gridloom.operators import cellfilters, morphology, neighbourhood, stack, stats, vector, warp
from gridloom.sources import raster_io


def _grid(text: str) -> warp.Grid:
    """``nrows,ncols,x0,y0,res[,srs]``"""
    p = text.split(",")
    n, m, x0, y0, res = int(p[0]), int(p[1]), *map(float, p[2:5])
    return warp.Grid(n, m, (x0, res, 0.0, y0, 0.0, -res), p[5] if len(p) > 5 else "")


def filtered(cells: DataFrame, name: str, params: list[float], reference: DataFrame | None = None) -> DataFrame:
    """One of the named filters with its parameters."""
    p = params
    if name == "dz":
        return cellfilters.by_reference_difference(cells, reference, limits=(p[0], p[1]) if len(p) > 1 else (0.0, 30.0))
    if name == "slope":  # cell size, then the limits
        return cellfilters.by_slope(cells, p[0] if p else 1.0, (p[1], p[2]) if len(p) > 2 else (0.0, 40.0))
    table = {
        "range": lambda: cellfilters.in_range(cells, p[0], p[1]),
        "absrange": lambda: cellfilters.in_abs_range(cells, p[0], p[1]),
        "perc": lambda: cellfilters.by_percentiles(cells, *(p[:2] or (1.0, 99.0))),
        "sigma": lambda: cellfilters.by_sigma(cells, *(p[:1] or (3.0,))),
        "mad": lambda: cellfilters.by_nmad(cells, *(p[:1] or (3.0,))),
        "med": lambda: neighbourhood.rolling(cells, F.median, int(p[0]) if p else 3),
        "gauss": lambda: neighbourhood.gaussian(cells, size=int(p[0]) if p else 3),
        "highpass": lambda: neighbourhood.highpass(cells, *(p[:1] or (1.0,))),
    }
    return table[name]()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridloom")
    sub = top.add_subparsers(dest="tool", required=True)

    def tool(name: str, *extra: tuple) -> None:
        p = sub.add_parser(name)
        for args, kw in extra:
            p.add_argument(*args, **kw)
        p.add_argument("--out", required=True)

    one = (("cells",), {})
    tool("filter", one, (("-filt",), {"required": True, "choices": "range absrange perc sigma mad med gauss highpass dz slope".split()}), (("-param",), {"nargs": "*", "type": float, "default": []}), (("-ref",), {}), (("-stats",), {"action": "store_true"}))
    tool("warp", one, (("-src",), {"required": True, "type": _grid}), (("-dst",), {"type": _grid}), (("-tr",), {}), (("-te",), {}), (("-t_srs",), {"default": "first"}), (("-r",), {"default": "cubic", "choices": sorted(warp.ALGORITHMS)}))
    tool("make_stack", one, (("-min_n",), {"type": int, "default": 2}), (("-min_dt_ptp",), {"type": float}), (("--no-trend",), {"action": "store_true"}), (("--robust",), {"action": "store_true"}), (("--med",), {"action": "store_true"}))
    tool("apply_mask", one, (("mask",), {}), (("-mask_val",), {"type": float}), (("-invert",), {"action": "store_true"}))
    tool("clip", one, (("vertices",), {}), (("-grid",), {"required": True, "type": _grid}), (("-invert",), {"action": "store_true"}), (("-extent",), {"action": "store_true"}), (("-bbox",), {"action": "store_true"}), (("-pad",), {"type": float, "default": 0.0}))
    tool("copyproj", (("src",), {}), (("dst",), {}))
    tool("trim", one)
    tool("replace_ndv", one, (("ndv",), {"type": float}))
    tool("outline", one, (("-grid",), {"required": True, "type": _grid}))
    tool("stats", one)
    p = sub.add_parser("proj_select")
    p.add_argument("lat", type=float)
    p.add_argument("lon", type=float)
    return top


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """The tool's result; also written to ``--out``."""
    a = parser().parse_args(argv)
    if a.tool == "proj_select":
        df = spark.range(1).select(F.lit(a.lon).alias("lon"), F.lit(a.lat).alias("lat"))
        return df.select(geo.preferred_epsg(F.col("lon"), F.col("lat")).alias("epsg"))
    if a.tool == "copyproj":
        from gridloom.sources import geotiff

        place, form = (geotiff.geotiff_info(spark, x).first() for x in (a.src, a.dst))
        name = a.dst.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        cells = geotiff.read_geotiff(spark, a.dst, dense=False).withColumn("name", F.lit(name))
        return geotiff.write_geotiff(cells, a.out, form.nrows, form.ncols, place.gt, place.srs, -9999.0 if form.ndv is None else form.ndv, form.dtype, "name", "band", form.bands)
    cells = raster_io.read_cells(spark, a.cells)
    if a.tool == "filter":
        out = filtered(cells, a.filt, a.param, raster_io.read_cells(spark, a.ref) if a.ref else None)
    elif a.tool == "warp":
        grid = a.dst
        if grid is None:
            own = warp.reprojected(spark, a.src, warp.parse_srs(a.t_srs, [a.src]))
            grid = warp.grid_for(warp.parse_extent(a.te or "first", [own]), warp.parse_res(a.tr or "first", [own]), own.srs)
        out = warp.warp(cells, a.src, grid, a.r)
    elif a.tool == "apply_mask":
        out = cellfilters.by_mask(cells, raster_io.read_cells(spark, a.mask), a.mask_val, a.invert)
    elif a.tool == "clip":
        vertices = spark.read.parquet(a.vertices)
        if a.extent or a.bbox or a.pad:
            out = vector.crop(cells, vertices, list(a.grid.gt), a.pad)
            if not a.bbox:
                out = vector.clip_by_polygons(out, vertices, a.grid.nrows, a.grid.ncols, list(a.grid.gt), a.invert) if not a.extent else out
        else:
            out = vector.clip_by_polygons(cells, vertices, a.grid.nrows, a.grid.ncols, list(a.grid.gt), a.invert)
    elif a.tool == "trim":
        out = morphology.trim(cells)
    elif a.tool == "replace_ndv":
        out = cells.withColumn("v", model.fill_nodata(F.col("v"), a.ndv))
    elif a.tool == "outline":
        out = vector.outline(cells, list(a.grid.gt))
    elif a.tool == "stats":
        out = stats.full_stats(cells)
    else:
        layers = stack.layer_table(cells.select("fn").distinct(), dt=datetime_in_name(F.col("fn")))
        layered = cells.join(layers.select("fn", "layer"), "fn").select("layer", "r", "c", "v")
        products = {"stats": stack.stack_stats(layered, robust=a.med), "dates": stack.date_stats(layered, layers)}
        if not a.no_trend:
            products["trend"] = stack.theil_sen(layered, layers) if a.robust else stack.trend(layered, layers, a.min_n, a.min_dt_ptp)
        raster_io.save_stack(layered, layers, a.out, products)
        return products["stats"]
    if a.tool == "filter" and a.stats:
        out.write.parquet(a.out)
        before, after = (stats.full_stats(x) for x in (cells, spark.read.parquet(a.out)))
        return stats.describe(before.unionByName(after))
    out.write.parquet(a.out)
    return spark.read.parquet(a.out)


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.getOrCreate(), sys.argv[1:]).show()
