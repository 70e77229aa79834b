"""Queries over tables larger than the smallest: nothing of a raster or of the points is left out."""

import duckdb
import numpy as np
import pytest

from gridloom.catalog import ORACLE, QUERIES
from gridloom.operators import cellfilters, warp
from gridloom.plans import fixtures as fx

SF = "/root/testdata/sf0.1"
#: The SQL with the bounds of these tables (2000 x 64 cells; x to 19999.5, y to 999.5) in place of its own.
WIDER = {
    "block_stats_median": [("200.0 - y", "1000.0 - y"), ("200 - (floor", "1000 - (floor"), ("between 0 and 99 ", "between 0 and 999 "), ("between 0 and 9 ", "between 0 and 49 ")],
    "block_stats_full_grid": [],
    "hist2d": [("between 0 and 2048", "between 0 and 20032"), ("between 0 and 128", "between 0 and 1000"), ("1, 32)", "1, 313)"), ("1, 16)", "1, 125)")],
    "rolling_max_disc": [],
    "mask_dilate": [("between 0 and 499", "between 0 and 1999")],
    "warp_bilinear": [("range(1000) a", "range(4000) a")],
    "gauss_fill": [],
    "erode_edge": [],
    "warp_average": [],
    "warp_nearest": [],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(WIDER))
def test_whole_tables(spark, duck, name):
    sql = ORACLE[name]
    for a, b in WIDER[name]:
        assert a in sql
        sql = sql.replace(a, b)
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(sql).df()[list(got.columns)]
    keys = [c for c in got.columns if c in ("r", "c", "bx", "by")]
    got, want = (d.sort_values(keys, ignore_index=True) for d in (got, want))
    assert len(got) == len(want)
    for c in got.columns:
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=0, atol=2e-4 if name.startswith("block") else 2e-8, equal_nan=True), c


@pytest.mark.parametrize("name", ["cubic", "lanczos"])
def test_kernels_reach_the_last_row(spark, name):
    src = warp.Grid(2000, 64, tuple(fx.GT), "EPSG:32610")
    dst = warp.Grid(3000, 96, (fx.GT[0], 20.0, 0.0, fx.GT[3], 0.0, -20.0), "EPSG:32610")
    assert warp.warp(fx.raster(spark, SF), src, dst, name).agg({"r": "max"}).first()[0] == 2999


def test_enclosed_holes_of_all_rows(spark):
    cells = fx.raster(spark, SF).toPandas()
    gap = np.zeros((2000, 64), bool)
    gap[cells.r, cells.c] = ~(cells.v.abs() >= 0.04)
    todo = [(r, c) for r, c in zip(*np.nonzero(gap)) if r in (0, 1999) or c in (0, 63)]
    while todo:
        r, c = todo.pop()
        if 0 <= r < 2000 and 0 <= c < 64 and gap[r, c]:
            gap[r, c] = False
            todo += [(r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)]
    assert {(r.r, r.c) for r in QUERIES["enclosed_holes"](spark, SF).collect()} == set(zip(*(x.tolist() for x in np.nonzero(gap))))


def test_frames_hold_points_on_their_edges(spark):
    p = spark.createDataFrame([(-3.0, -20.0, 1.0), (2000.0, 201.0, 2.0), (0.0, 0.0, 3.0)], "x double, y double, z double")
    left, top, res, rows, cols = fx.frame(p, 20.0, 2000.0, 200.0)
    assert (left, top, res, rows, cols) == (-20.0, 220.0, 20.0, 13, 102)
    assert fx.frame(p.limit(0), 20.0, 2000.0, 200.0) == (0.0, 200.0, 20.0, 10, 100)


@pytest.mark.parametrize("name", ["sample_points", "bilinear_samples", "warp_nearest", "erode_edge", "by_slope"])
def test_generated_cells_are_not_broadcast(spark, name):
    df = cellfilters.by_slope(fx.raster(spark, SF), 30.0) if name == "by_slope" else QUERIES[name](spark, SF)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
