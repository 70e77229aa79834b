"""Hand-made fixtures for what SQL does not check."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import model
from gridloom.functions import geo
from gridloom.functions import timefns as T
from gridloom.functions.signal import two_way
from gridloom.operators import cellfilters, morphology, neighbourhood, points, stack, stats, vector, warp
from gridloom.sources import raster_io
from gridloom.streaming import live

N = None


def raster(spark, rows):
    return spark.createDataFrame([(r, c, v if v is None else float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)], "r int, c int, v double")


def grid(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r.v is not None:
            out[r.r, r.c] = r.v
    return out


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


RING = [[1, 1, 1, 1, 1], [1, 1, N, 1, 1], [1, N, N, N, 1], [1, 1, N, 1, N], [1, 1, 1, 1, 1]]


def test_holes_are_those_not_joined_to_the_border(spark):
    df = raster(spark, RING)
    assert {(x.r, x.c) for x in morphology.holes(df, (5, 5)).collect()} == {(1, 2), (2, 1), (2, 2), (2, 3), (3, 2)}
    assert (2, 2) in {(x.r, x.c) for x in morphology.enclosed_by_lines(df, (5, 5)).collect()}
    filled = morphology.fill_holes(df, raster(spark, [[9] * 5] * 5), (5, 5))
    assert grid(filled, (5, 5))[2, 2] == 9


def test_closing_keeps_missing_places(spark):
    df = raster(spark, RING)
    closed = {(x.r, x.c) for x in morphology.close_mask(df, 1, (5, 5)).collect()}
    assert {(1, 2), (2, 1), (3, 4)} <= closed
    kept = {(x.r, x.c) for x in morphology.remove_islands(df, 1, (5, 5)).collect()}
    assert kept.isdisjoint(closed)


def test_empty_and_all_missing(spark):
    none = raster(spark, [[N, N], [N, N]])
    r = stats.full_stats(none).first()
    assert r.n == 0 and r.med is None and r.nmad is None
    assert stats.percentiles(none, (1, 99), empty=0.0).first().p == [0.0, 0.0]
    assert cellfilters.by_sigma(none).where("v is not null").count() == 0
    assert stack.stack_stats(spark.createDataFrame([], "layer int, r int, c int, v double")).count() == 0


def test_gaussian_against_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(7, 9))
    a[2, 3] = a[6, 8] = np.nan
    k = np.array(neighbourhood.gauss_kernel(1.0))
    h = len(k) // 2
    want = np.full(a.shape, np.nan)
    for r in range(7):
        for c in range(9):
            s = w = 0.0
            for i in range(-h, h + 1):
                for j in range(-h, h + 1):
                    if 0 <= r + i < 7 and 0 <= c + j < 9 and not np.isnan(a[r + i, c + j]):
                        s += a[r + i, c + j] * k[i + h] * k[j + h]
                        w += k[i + h] * k[j + h]
            want[r, c] = s / w
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in a]
    got = grid(neighbourhood.gaussian(raster(spark, rows), 1.0, keep_mask=False, shape=(7, 9)), (7, 9))
    assert np.allclose(got, want)


def test_band_filters_and_pyramid(spark):
    df = raster(spark, [[float((r * c) % 5) for c in range(8)] for r in range(8)])
    assert neighbourhood.bandpass(df, 1.0, 2.0).agg(F.min("v")).first()[0] >= 0
    assert neighbourhood.gaussian_pyramid(df, 4).count() == 4


def test_legacy_disc():
    assert {i for i, _ in neighbourhood.circular_offsets(5, legacy=True)} == {-1, 0, 1, 2}
    assert {i for i, _ in neighbourhood.circular_offsets(5)} == {-2, -1, 0, 1, 2}


def test_masks(spark):
    a = raster(spark, [[1, 2], [3, 4]])
    m = raster(spark, [[1, N], [2, 2]])
    assert np.array_equal(np.isnan(grid(cellfilters.by_mask(a, m), (2, 2))), [[False, True], [False, False]])
    assert np.array_equal(np.isnan(grid(cellfilters.by_mask(a, m, mask_value=2), (2, 2))), [[True, True], [False, False]])
    flat = raster(spark, [[1, N], [1, 1]])
    assert np.array_equal(np.isnan(grid(cellfilters.by_mask(a, flat), (2, 2))), [[False, True], [False, False]])
    assert cellfilters.random_fill(m, 1).where("v is null").count() == 0


NAMES = {
    "20180101_1200_dem.tif": dt.datetime(2018, 1, 1, 12),
    "20180101T1200_dem.tif": dt.datetime(2018, 1, 1, 12),
    "201801011200_dem.tif": dt.datetime(2018, 1, 1, 12),
    "a/20080101_dem.tif": dt.datetime(2008, 1, 1),
    "WV02_20130315_10300100207D5600_1030010020151700-DEM.tif": dt.datetime(2013, 3, 15, 10, 30),
    "20180101_20190203_x.tif": dt.datetime(2018, 1, 1, 20, 19),
    "20130304_1510_1030010020770600_1030010020CEAB00-DEM_4x.tif": dt.datetime(2013, 3, 4, 15, 10),
    "dem_2018.tif": dt.datetime(2018, 1, 1),
    "03jul67.tif": dt.datetime(2067, 7, 3),
    "nodate.tif": None,
    "WV02_1030010020121105-DEM.tif": None,
    "run12018x.tif": None,
    "WV01_12JUN152223255-P1BS.tif": None,
    "dem_2018.5_x.tif": None,
    "dem_2018.50_x.tif": dt.datetime(2018, 7, 2, 12),
    "a_20180101.tif": dt.datetime(2018, 1, 1),
    "a_20180101b.tif": None,
    "31xyz67.tif": None,
}


def test_dates_in_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "fn string")
    assert {r.fn: r.d for r in df.select("fn", T.datetime_in_name(F.col("fn")).alias("d")).collect()} == NAMES
    two = spark.createDataFrame([("a_20180101_1200__20190203_0405_x.tif",)], "fn string").select(T.datetimes_in_name(F.col("fn")).alias("d")).first().d
    assert two == [dt.datetime(2018, 1, 1, 12), dt.datetime(2019, 2, 3, 4, 5)]


def test_t_limit_beyond_the_table(spark):
    df = spark.createDataFrame([(float(n),) for n in (1, 5, 30, 31, 60, 120, 100_000)], "n double")
    got = [r.t for r in df.select(stack.t_limit(F.col("n")).alias("t")).collect()]
    assert np.allclose(got, [12.7062, 2.57058, 2.04227, 2.03951, 2.00030, 1.97993, 1.95999], atol=2e-5)


def test_warp_between_reference_systems(spark):
    src = warp.Grid(60, 60, (480000.0, 1000.0, 0.0, 5240000.0, 0.0, -1000.0), "EPSG:32610")
    cells = spark.range(3600).select((F.col("id") / 60).cast("int").alias("r"), (F.col("id") % 60).cast("int").alias("c"))
    # the value is the cell's longitude, so it must be the longitude of where it lands
    x, y = geo.pixel_to_map(list(src.gt), F.col("c"), F.col("r"))
    lon, lat = geo.transform("EPSG:32610", "EPSG:4326")(x, y)
    cells = cells.select("r", "c", lon.alias("v"))
    utm11 = warp.Grid(50, 50, (20000.0, 1000.0, 0.0, 5240000.0, 0.0, -1000.0), "EPSG:32611")
    flat = spark.range(2500).select((F.col("id") / 50).cast("int").alias("r"), (F.col("id") % 50).cast("int").alias("c"), F.lit(1.0).alias("v"))
    (a, b), grid_ = warp.warp_multi([(cells, src), (flat, utm11)], extent="union", srs="EPSG:4326", algorithm="bilinear")
    assert grid_.srs == "EPSG:4326" and -124 < grid_.gt[0] < -120 and 46 < grid_.gt[3] < 48
    got = a.withColumn("want", F.lit(grid_.gt[0]) + (F.col("c") + 0.5) * grid_.gt[1])
    off = got.agg(F.count("*"), F.max(F.abs(F.col("v") - F.col("want"))), F.avg(F.abs(F.col("v") - F.col("want")))).first()
    assert off[0] > 1000 and off[1] < 0.0135 and off[2] < 0.0005  # at the border a source cell's width, 1,000 m
    assert b.count() > 500
    with pytest.raises(ValueError, match="transformation"):
        warp.warp(flat, warp.Grid(5, 5, (0, 1, 0, 5, 0, -1), "EPSG:2193"), grid_)


def test_plane_residuals(spark):
    p = spark.createDataFrame([(float(i % 10), float(i // 10), 2.0 * (i % 10) - (i // 10) + 5 + (1000.0 if i == 7 else 0.0)) for i in range(100)], "x double, y double, z double")
    out = points.plane_residuals(p, points.plane_fit(p))
    assert out.where("abs(residual) > 1e-6").count() == 1 and out.count() == 100


def test_time_round_trips(spark):
    ts = F.col("ts")
    table = spark.createDataFrame([(dt.datetime(2016, 2, 29, 13, 45, 30, 250000),)], "ts timestamp_ntz")
    r = table.select(T.from_ordinal(T.ordinal(ts)).alias("o"), T.from_decimal_year(T.decimal_year(ts)).alias("y"), T.from_matlab_day(T.matlab_day(ts)).alias("m"), T.julian_day(ts).alias("jd"), T.from_julian(F.lit(2457448.0)).alias("fj"), T.round_to_day(ts).alias("day"), T.ordinal(F.expr("timestamp_ntz'1970-01-01'")).alias("epoch")).first()
    want = dt.datetime(2016, 2, 29, 13, 45, 30, 250000)
    assert abs(r.o - want) < dt.timedelta(milliseconds=1) and abs(r.y - want) < dt.timedelta(seconds=1) and abs(r.m - want) < dt.timedelta(milliseconds=1)
    assert r.jd == 2457448 and r.fj == dt.datetime(2016, 2, 29, 12) and r.day == dt.datetime(2016, 3, 1) and r.epoch == 719163.0


def test_fixed_dates_increase(spark):
    rows = [(i, dt.datetime(2020, 1, 1)) for i in range(4)] + [(9, dt.datetime(2020, 1, 1, 0, 0, 0, 2000))]
    got = sorted(r.fixed for r in T.fix_repeated(spark.createDataFrame(rows, "idx int, ts timestamp_ntz")).collect())
    assert all(a < b for a, b in zip(got, got[1:]))


def test_date_ranges(spark):
    r = one(spark, T.date_range(F.lit("2020-01-01").cast("date"), F.lit("2020-01-10").cast("date"), 4).alias("d")).d
    assert r == [dt.date(2020, 1, 1), dt.date(2020, 1, 5), dt.date(2020, 1, 9)]


def test_pixels_and_projections(spark):
    gt = [500000.0, 30.0, 2.0, 5200000.0, 1.0, -30.0]
    x, y = geo.pixel_to_map(gt, F.lit(7.0), F.lit(3.0))
    px, py = geo.map_to_pixel(gt, x, y)
    r = one(spark, px.alias("px"), py.alias("py"))
    assert math.isclose(r.px, 7, abs_tol=1e-6) and math.isclose(r.py, 3, abs_tol=1e-6)
    ux, uy = geo.to_utm(F.lit(-123.0), F.lit(49.0), F.lit(10))
    r = one(spark, ux.alias("x"), uy.alias("y"), geo.distance_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d"), geo.distance_km(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("z"))
    assert math.isclose(r.x, 500000, abs_tol=1e-3) and 5.42e6 < r.y < 5.44e6
    assert math.isclose(r.d, 111.3194908, abs_tol=1e-4) and r.z == 0
    sx, sy = geo.polar_stereographic(F.lit(-45.0), F.lit(90.0))
    r = one(spark, sx.alias("x"), sy.alias("y"), geo.polar_scale(F.lit(70.0)).alias("k"), geo.dms_text_to_dd(F.lit("47 30 36 S")).alias("dd"))
    assert abs(r.x) < 1e-6 and abs(r.y) < 1e-6 and math.isclose(r.k, 1.0, abs_tol=1e-6) and math.isclose(r.dd, -47.51)
    assert geo.invert_gt([0, 0, 0, 0, 0, 0]) is None


def test_warp_and_metadata(spark):
    a = warp.Grid(4, 4, (0.0, 1.0, 0.0, 4.0, 0.0, -1.0), "x")
    b = warp.Grid(2, 2, (1.0, 2.0, 0.0, 5.0, 0.0, -2.0), "x")
    assert warp.parse_extent("intersection", [a, b]) == (1.0, 1.0, 4.0, 4.0) and warp.parse_extent("union", [a, b]) == (0.0, 0.0, 5.0, 5.0)
    assert warp.parse_res("common_scale_factor", [a, b]) == pytest.approx(math.sqrt(2)) and warp.parse_res("mean", [a, b]) == 1.5
    df = raster(spark, [[1, 2, 3, 4]] * 4)
    assert warp.warp(df, a, a).count() == 16
    out, g = warp.warp_multi([(df, a), (df, a)], algorithm="bilinear")
    assert g.nrows == 4 and all(x.count() == 16 for x in out)
    up = grid(warp.warp(df, a, warp.grid_for(a.extent, 0.5, "x"), "cubic"), (8, 8))
    assert np.isfinite(up).all()
    with pytest.raises(ValueError):
        warp.warp(df, a, b, "nope")


def test_vectors(spark):
    tri = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 0, 1, 4.0, 0.0), (1, 0, 2, 0.0, 4.0)], "fid int, ring int, idx int, x double, y double")
    inside = {(r.r, r.c) for r in vector.rasterize(tri, 4, 4, [0.0, 1.0, 0.0, 4.0, 0.0, -1.0]).collect()}
    assert (3, 0) in inside and (0, 3) not in inside and (1, 0) in inside
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 3.0, 4.0)], "fid int, idx int, x double, y double")
    p = [(r.d, r.x, r.y) for r in vector.line_points(line, 2.0).orderBy("d").collect()]
    assert p == [(0.0, 0.0, 0.0), (2.0, 2.0, 0.0), (4.0, 3.0, 1.0), (6.0, 3.0, 3.0)]
    pts = spark.createDataFrame([(1, float(x), float(y)) for x in range(4) for y in range(4)], "fid int, x double, y double")
    assert {(r.x, r.y) for r in vector.convex_hull(pts).collect()} == {(0, 0), (3, 0), (3, 3), (0, 3)}


def test_surfaces(spark):
    pts = spark.createDataFrame([(float(x), float(y), 2.0 * x - 3.0 * y + 5.0) for x in range(6) for y in range(6)], "x double, y double, z double")
    k = points.fit_polynomial(pts, 1, perc=None)
    assert k[(1, 0)] == pytest.approx(2) and k[(0, 1)] == pytest.approx(-3) and k[(0, 0)] == pytest.approx(5)
    assert set(points.fit_polynomial(pts, 2, tensor=True, perc=None)) == {(i, j) for i in range(3) for j in range(3)}
    assert grid(points.inverse_distance(raster(spark, RING), (5, 5)), (5, 5))[2, 2] == pytest.approx(1)


def test_trend_drops_an_outlier(spark):
    days = [dt.datetime(2000 + y, 7, 1) for y in range(8)]
    layers = spark.createDataFrame(list(enumerate(days)), "layer int, dt timestamp_ntz")
    v = [float(y) + 0.01 * (-1) ** y for y in range(8)]
    v[5] = 60.0
    cells = spark.createDataFrame([(i, 0, 0, x) for i, x in enumerate(v)], "layer int, r int, c int, v double")
    r = stack.trend(cells, layers, remove_outliers=True).first()
    assert r.n < 8 and r.slope == pytest.approx(1, abs=0.05)
    assert stack.theil_sen(cells, layers).first().slope == pytest.approx(1, abs=0.2)
    assert stack.significant(stack.trend(cells, layers, remove_outliers=True)).count() == 1


def test_storage(spark, tmp_path):
    raster_io.register(spark)
    assert spark.read.format("lattice").option("nrows", 3).option("ncols", 2).load().count() == 6
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 3.0)], "layer int, r int, c int, v double")
    layers = spark.createDataFrame([(0, "a"), (1, "b")], "layer int, fn string")
    raster_io.save_stack(cells, layers, str(tmp_path / "stack"))
    _, l2, s = raster_io.load_stack(spark, str(tmp_path / "stack"))
    assert l2.count() == 2 and s.first()["mean"] == 2.0
    assert raster_io.existing(spark, [str(tmp_path / "stack"), str(tmp_path / "no")]) == [str(tmp_path / "stack")]


def test_tiles_and_nodata(spark):
    df = raster(spark, RING)
    assert sorted(map(tuple, model.from_tiles(model.to_tiles(df, 2)).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    r = one(spark, model.masked(F.lit(-9999.0001), -9999).alias("a"), model.masked(F.lit(float("nan")), None).alias("b"), model.masked(F.lit(5), -9999).alias("c"))
    assert (r.a, r.b, r.c) == (None, None, 5.0)
    assert model.grid_of(0, 0, 100, 50, 30)["ncols"] == 4 and model.sub_dim(4000, 2000)[2] > 3


def test_filter_passes_constants():
    assert np.allclose(two_way(np.full(50, 3.0), 3, 0.1), 3.0)
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * t / 200), np.sin(2 * np.pi * t / 4)
    assert np.abs(two_way(slow + fast, 3, 0.1)[50:-50] - slow[50:-50]).max() < 0.05


def test_streams(spark, tmp_path):
    spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0)], "r int, c int, v double").write.parquet(str(tmp_path / "in"))
    s = live.live_cell_stats(spark.readStream.schema("r int, c int, v double").parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("cellstats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("cellstats").first()["mean"] == 2.0
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), 1.0) for m in (0, 1, 30)], "ts timestamp, value double")
    assert live.live_clusters(e, "10 minutes").count() == 2


def test_features_as_json(spark, tmp_path):
    from gridloom.sources import geojson

    (tmp_path / "a.geojson").write_text('''{"type": "FeatureCollection", "features": [
      {"type": "Feature", "properties": {"name": "p", "n": 3}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 0.5], [2, 0.5], [2, 1], [1, 0.5]]]}},
      {"type": "Feature", "properties": {"name": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},
      {"type": "Feature", "properties": null, "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4], [6, 4]]}},
      {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [7, 8]}},
      {"type": "Feature", "properties": {}, "geometry": null}]}''')
    v = geojson.read_geojson(spark, str(tmp_path / "a.geojson"))
    count = {(r.fid, r.kind, r.ring): r["count"] for r in v.groupBy("fid", "kind", "ring").count().collect()}
    assert count == {(0, "Polygon", 0): 3, (0, "Polygon", 1): 3, (1, "MultiPolygon", 0): 3, (1, "MultiPolygon", 1): 3, (2, "LineString", 0): 3, (3, "Point", 0): 1}
    assert v.where("fid = 0").first().properties == {"name": "p", "n": "3"}
    polygons = v.where("fid < 2").withColumn("name", F.col("properties")["name"])
    geojson.write_geojson(polygons, str(tmp_path / "out"), properties=["name"])
    back = geojson.read_geojson(spark, str(tmp_path / "out/*.txt"))
    of = lambda df, name: sorted((name(r), r.ring, r.idx, r.x, r.y) for r in df.collect())
    assert of(back, lambda r: r.properties["name"]) == of(polygons, lambda r: r.name)
    line = vector.line_points(v.where("fid = 2"), 1.0)
    assert line.count() == 8
    lonlat = vector.reproject(spark.createDataFrame([(1, 3.0, 45.0)], "fid int, x double, y double"), "EPSG:4326", "EPSG:32631").first()
    assert (round(lonlat.x, 2), round(lonlat.y, 2)) == (500000.0, 4982950.4)


def test_simplified_lines_profiles_and_crops(spark):
    bent = [(0, 0, i, float(i), 0.05 * (i % 2) if i != 5 else 3.0) for i in range(11)]
    got = vector.simplify(spark.createDataFrame(bent, "fid int, ring int, idx int, x double, y double"), 0.2)
    assert sorted(r.idx for r in got.collect()) == [0, 4, 5, 6, 10]
    cells = raster(spark, [[float(r + 10 * c) for c in range(10)] for r in range(10)])
    gt = [0.0, 1.0, 0.0, 10.0, 0.0, -1.0]
    along = spark.createDataFrame([(1, 0, 1.5, 5.5), (1, 1, 8.5, 5.5)], "fid int, idx int, x double, y double")
    values = [r.v for r in vector.profile(cells, along, gt, 1.0).orderBy("d").collect()]
    assert np.allclose(values, [4 + 10 * k for k in range(1, 1 + len(values))]) and len(values) >= 7
    box = spark.createDataFrame([(1, 0, 0, 3.0, 3.0), (1, 0, 1, 5.0, 6.0)], "fid int, ring int, idx int, x double, y double")
    assert vector.crop(cells, box, gt).count() == 6 and vector.crop(cells, box, gt, 1.0).count() == 20


def test_command_line(spark, tmp_path):
    from gridloom import cli

    cells, out = str(tmp_path / "cells"), str(tmp_path / "out")
    raster(spark, RING).write.parquet(cells)
    assert cli.run(spark, ["filter", cells, "-filt", "range", "-param", "0", "2", "--out", out]).where("v is not null").count() == 19
    assert cli.run(spark, ["proj_select", "--", "49", "-123"]).first().epsg == 32610
    assert cli.run(spark, ["warp", cells, "-src", "5,5,0,5,1", "-dst", "5,5,0,5,1", "-r", "near", "--out", out + "2"]).count() == 19
    assert cli.run(spark, ["warp", cells, "-src", "5,5,0,5,1", "-tr", "2.5", "-r", "average", "--out", out + "3"]).count() == 4
    assert "count" in cli.run(spark, ["filter", cells, "-filt", "mad", "-stats", "--out", out + "4"]).first().line
    box = str(tmp_path / "box")
    spark.createDataFrame([(1, 0, i, x, y) for i, (x, y) in enumerate([(1.0, 1.0), (3.0, 1.0), (3.0, 4.0), (1.0, 4.0)])], "fid int, ring int, idx int, x double, y double").write.parquet(box)
    assert cli.run(spark, ["clip", cells, box, "-grid", "5,5,0,5,1", "-bbox", "--out", out + "5"]).count() == 6
    from gridloom.sources import geotiff

    geotiff.write_geotiff(raster(spark, RING), f"file://{tmp_path}/tif", 5, 5, [0.0, 1.0, 0.0, 5.0, 0.0, -1.0], "EPSG:32610", name=None)
    geotiff.write_geotiff(raster(spark, RING), f"file://{tmp_path}/other", 5, 5, [7.0, 2.0, 0.0, 9.0, 0.0, -2.0], "EPSG:3413", name=None)
    cli.run(spark, ["copyproj", str(tmp_path / "other/raster.tif"), str(tmp_path / "tif/raster.tif"), "--out", f"file://{tmp_path}/done"])
    info = geotiff.geotiff_info(spark, str(tmp_path / "done/raster.tif")).first()
    assert info.srs == "EPSG:3413" and info.gt == [7.0, 2.0, 0.0, 9.0, 0.0, -2.0]


def test_points_in_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(7)
    p = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-50, 50, (200, 2)))]
    boxes = [(j, a, b, a + w, b + h) for j, (a, b, w, h) in enumerate(np.c_[rng.uniform(-50, 40, (30, 2)), np.exp(rng.uniform(-3, 6, (30, 2)))].tolist())] + [(90, 1.0, 1.0, 1.0, 1.0), (91, 5.0, 0.0, 4.0, 1.0), (92, -1e6, -1e6, 1e6, 1e6)]
    p.append((900, 1.0, 1.0))
    got = vector.points_in_boxes(spark.createDataFrame(p, "pid int, x double, y double"), spark.createDataFrame(boxes, "fid int, xmin double, ymin double, xmax double, ymax double"), 0.5)
    want = sorted((i, j) for i, x, y in p for j, a, b, c, d in boxes if a <= x <= c and b <= y <= d)
    assert sorted((r.pid, r.fid) for r in got.collect()) == want
    none = spark.createDataFrame([], "fid int, xmin double, ymin double, xmax double, ymax double")
    assert vector.points_in_boxes(spark.createDataFrame(p, "pid int, x double, y double"), none, 0.5).count() == 0


def test_ransac_agrees_with_the_line_without_outliers(spark):
    years = list(range(2000, 2012))
    layers = spark.createDataFrame([(k, dt.datetime(y, 7, 1)) for k, y in enumerate(years)], "layer int, dt timestamp_ntz")
    days = np.array([dt.datetime(y, 7, 1).toordinal() for y in years], float)
    rows = [(k, 0, 0, float(5.0 + 0.01 * (days[k] - days[0]) + (500.0 if k in (3, 9) else 0.01 * (k % 3)))) for k in range(12)]
    rows += [(k, 0, 1, None if k > 1 else 1.0) for k in range(12)] + [(k, 1, 1, 7.0) for k in range(12)]
    got = {(r.r, r.c): r for r in stack.ransac(spark.createDataFrame(rows, "layer int, r int, c int, v double"), layers).collect()}
    assert set(got) == {(0, 0), (1, 1)} and got[1, 1].slope == 0 and got[1, 1].agree == 12
    assert got[0, 0].n == 12 and got[0, 0].agree == 10 and abs(got[0, 0].slope / 365.25 - 0.01) < 1e-4
    assert stack.ransac(spark.createDataFrame(rows, "layer int, r int, c int, v double").limit(0), layers).count() == 0


def test_date_raster(spark):
    cells = spark.createDataFrame([("a_20180101_1200.tif", 0, 0, 3.0), ("a_20180101_1200.tif", 0, 1, None)], "fn string, r int, c int, v double")
    day = T.datetime_in_name(F.col("fn"))
    assert [r.v for r in T.date_raster(cells, day).orderBy("c").collect()] == [736695.5, None]
    assert T.date_raster(cells, day, F.lit(dt.datetime(2017, 12, 31))).orderBy("c").first().v == 1.5


def test_percentiles_are_exact_whatever_the_order_of_rows(spark):
    """Sketches of rows in another order differ, and a table's rows are read or fetched in any order."""
    import pandas as pd

    def mixed(parts):
        yield pd.concat(list(parts)).sample(frac=1, random_state=np.random.default_rng())

    cells = spark.range(0, 400_001, 1, 4).select((F.col("id") * 7919 % 400_001).cast("double").alias("v"), F.lit(1).alias("k")).mapInPandas(mixed, "v double, k int")
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert stats.percentiles(cells, (50, 25, 99)).first().p == [200000.0, 100000.0, 396000.0]
        assert stats.percentiles(cells, (50,), ["k"]).first().p == [200000.0]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)


def test_percentiles_of_keys_without_values(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 4.0), (1, N), (2, N), (N, 7.0)], "k int, v double")
    assert {r.k: r.p for r in stats.percentiles(df, (0, 50, 100), ["k"]).collect()} == {1: [1.0, 2.5, 4.0], 2: N, N: [7.0, 7.0, 7.0]}
    assert stats.percentiles(df.limit(0), (50,)).first().p is N
    assert stats.percentiles(df.limit(0), (50, 60), empty=0.0).first().p == [0.0, 0.0]


def test_pairs_of_dates_are_merged_on_numbers(spark):
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) for m in (0, 9, 10, 11, 60)]
    q = spark.createDataFrame(list(enumerate(times)), "id int, ts timestamp_ntz")
    pairs = T.within(q, q.select(F.col("id").alias("other"), F.col("ts").alias("cts")), 10 / 1440)
    assert pairs.columns == ["id", "ts", "other", "cts"]
    near = {(i, j) for i, a in enumerate(times) for j, b in enumerate(times) if abs(a - b) < dt.timedelta(minutes=10)}
    assert {(r.id, r.other) for r in pairs.collect()} == near
    plan = pairs.select("id", "other")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("Broadcast" in line or "timestampdiff" in line for line in joins), joins


def test_a_grid_of_block_statistics_is_made_behind_the_shuffle(spark):
    at = [(0.5, 1.5, 2.0), (0.5, 1.5, 4.0), (4095.5, 0.5, 5.0), (4096.5, 0.5, 6.0), (9999.5, 1.5, 7.0), (5000.5, 5.0, 8.0)]
    p = spark.createDataFrame(at, "x double, y double, z double")
    df = points.block_stats_grid(p, 0.0, 3.0, 1.0, 3, 10_000, "mean")
    rows = df.collect()
    assert sorted((r.r, r.c) for r in rows) == [(r, c) for r in range(3) for c in range(10_000)]
    assert {(r.r, r.c): r.v for r in rows if r.v is not None} == {(1, 0): 3.0, (2, 4095): 5.0, (2, 4096): 6.0, (1, 9999): 7.0}
    moved, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
        if "Adaptive" in plan.nodeName():
            todo.append(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            todo.append(plan.plan())
        if plan.nodeName() == "ShuffleQueryStage":
            moved = max(moved, int(plan.getRuntimeStatistics().rowCount().get()))
    assert 0 < moved < 100
