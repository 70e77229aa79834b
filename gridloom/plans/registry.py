"""Registered queries over the derived fixtures, each with the DuckDB SQL for the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import model
from gridloom.functions import geo
from gridloom.functions import timefns as T
from gridloom.operators import cellfilters, morphology, neighbourhood, points, stack, stats, vector, warp
from gridloom.plans import fixtures as fx
from gridloom.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rnd(df: DataFrame, n: int = 6, **over: int) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show."""
    return df.select(*[F.round(c, over.get(c, n)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- statistics -----------------------------------------------------------------


@query(f"with {fx.RASTER} select count(v) as n, min(v) as vmin, max(v) as vmax, round(max(v) - min(v), 6) as ptp, round(avg(v), 8) as mean, round(stddev_pop(v), 8) as std, round(sqrt(avg(v * v)), 8) as rmse from raster")
def raster_basic_stats(spark, sf):
    return rnd(stats.basic_stats(fx.raster(spark, sf)), 8, ptp=6, vmin=16, vmax=16)


@query(f"""with {fx.RASTER}, p as (select count(v) as n, min(v) as vmin, max(v) as vmax, avg(v) as mean, stddev_pop(v) as std, quantile_cont(v, 0.5) as med, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3, quantile_cont(v, 0.16) as p16, quantile_cont(v, 0.84) as p84 from raster),
m as (select v as mode from raster where v is not null group by v order by count(*) desc, v limit 1),
d as (select quantile_cont(abs(v - med), 0.5) * 1.4826::double as nmad from raster, p where v is not null)
select n, round(vmin, 8) as vmin, round(vmax, 8) as vmax, round(vmax - vmin, 8) as ptp, round(mean, 8) as mean, round(std, 8) as std, round(nmad, 8) as nmad, round(med, 8) as med, round(q1, 8) as q1, round(q3, 8) as q3, round(q3 - q1, 8) as iqr, round(p16, 8) as p16, round(p84, 8) as p84, round(abs(p84 - p16) / 2, 8) as spread, round(mode, 8) as mode from p, m, d""")
def raster_stats(spark, sf):
    return rnd(stats.full_stats(fx.raster(spark, sf)), 8)


@query(f"with {fx.RASTER}, k as (select c, v from raster), m as (select c, quantile_cont(v, 0.5) as med from k where v is not null group by c) select c, count(v) as n, round(any_value(med), 8) as med, round(quantile_cont(abs(v - med), 0.5) * 1.4826::double, 8) as nmad from k join m using (c) where v is not null group by c")
def column_nmad(spark, sf):
    return rnd(stats.median_nmad(fx.raster(spark, sf), ["c"]), 8)


@query(f"with {fx.RASTER} select round(-greatest(abs(quantile_cont(v, 0.001)), abs(quantile_cont(v, 0.999))), 8) as lo, round(greatest(abs(quantile_cont(v, 0.001)), abs(quantile_cont(v, 0.999))), 8) as hi from raster")
def symmetric_limits(spark, sf):
    return rnd(stats.symmetric_limit(fx.raster(spark, sf)), 8)


@query(f"with {fx.RASTER}, p as (select quantile_cont(v, 0.16) as a, quantile_cont(v, 0.84) as b from raster) select round(a, 8) as p16, round(b, 8) as p84, round(abs(b - a) / 2, 8) as spread from p")
def robust_spread(spark, sf):
    p = stats.percentiles(fx.raster(spark, sf), (16, 84))
    return rnd(p.select(F.col("p")[0].alias("p16"), F.col("p")[1].alias("p84"), (F.abs(F.col("p")[1] - F.col("p")[0]) / 2).alias("spread")), 8)


@query(f"with {fx.POINTS}, e as (select x - y as dx, y - x / 2 as dy, z / 1000 as dz from points), s as (select sqrt(avg(dx * dx)) as rx, sqrt(avg(dy * dy)) as ry, sqrt(avg(dz * dz)) as rz from e) select round(case when least(rx, ry) / greatest(rx, ry) > 0.6 and least(rx, ry) / greatest(rx, ry) < 1 then 2.146::double * 0.5 * (rx + ry) else 2.146::double * sqrt(rx * rx + ry * ry) end, 5) as ce90, round(1.6449::double * rz, 5) as le90 from s")
def error_percentiles(spark, sf):
    e = fx.points(spark, sf).select((F.col("x") - F.col("y")).alias("dx"), (F.col("y") - F.col("x") / 2).alias("dy"), (F.col("z") / 1000).alias("dz"))
    return rnd(e.agg(stats.circular_error_90("dx", "dy").alias("ce90"), stats.linear_error_90("dz").alias("le90")), 5)


@query(f"with {fx.RASTER} select c, count(v) = 0 as empty from raster group by c")
def empty_columns(spark, sf):
    return stats.is_empty(fx.raster(spark, sf), ["c"])


@query(f"with {fx.RASTER}, s as (select sum(case when v is null then 1 else 0 end) as holes, count(*) as cells from raster), d as (select (select any_value(v) from raster where r = 0 and c = 0) as first, (select v from raster where r = (select max(r) from raster) and c = 63) as last) select case when first = last then first else 0.0::double end as ndv from s, d")
def inferred_nodata(spark, sf):
    return model.infer_nodata(fx.raster(spark, sf))


# --- filters ------------------------------------------------------------------


def _filtered(limits: str, keep: str = "v between lo and hi") -> str:
    return f"with {fx.RASTER}, lim as ({limits}) select r, c, case when {keep} then v end as v from raster, lim"


@query(_filtered("select -0.1::double as lo, 0.1::double as hi"))
def range_filter(spark, sf):
    return cellfilters.in_range(fx.raster(spark, sf), 0.1, -0.1)


@query(_filtered("select 0.05::double as lo, 0.2::double as hi", "abs(v) between lo and hi"))
def abs_range_filter(spark, sf):
    return cellfilters.in_abs_range(fx.raster(spark, sf), 0.05, 0.2)


@query(_filtered("select quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi from raster"))
def perc_filter(spark, sf):
    return cellfilters.by_percentiles(fx.raster(spark, sf))


@query(_filtered("select avg(v) - 2 * stddev_pop(v) as lo, avg(v) + 2 * stddev_pop(v) as hi from raster"))
def sigma_filter(spark, sf):
    return cellfilters.by_sigma(fx.raster(spark, sf), 2.0)


@query(_filtered("select med - 2 * nmad as lo, med + 2 * nmad as hi from (select any_value(med) as med, quantile_cont(abs(v - med), 0.5) * 1.4826::double as nmad from raster, (select quantile_cont(v, 0.5) as med from raster) where v is not null)"))
def mad_filter(spark, sf):
    return cellfilters.by_nmad(fx.raster(spark, sf), 2.0)


@query(_filtered("select quantile_cont(v, 0.5) - 2 * (quantile_cont(v, 0.84) - quantile_cont(v, 0.16)) / 2 as lo, quantile_cont(v, 0.5) + 2 * (quantile_cont(v, 0.84) - quantile_cont(v, 0.16)) / 2 as hi from raster", "v > lo and v < hi"))
def robust_spread_filter(spark, sf):
    return cellfilters.by_robust_spread(fx.raster(spark, sf), 2.0)


def _pair(spark, sf):
    s = fx.stack(spark, sf)
    pick = lambda y: s.where(F.col("layer") == y).select("r", "c", "v")
    return pick(1996), pick(2000)


PAIR = f"{fx.STACK}, a as (select r, c, v from stack where layer = 1996), b as (select r, c, v from stack where layer = 2000)"


@query(f"with {PAIR} select r, c, round(a.v - b.v, 6) as v from a join b using (r, c)")
def raster_diff(spark, sf):
    return rnd(cellfilters.difference(*_pair(spark, sf)), 6)


@query(f"with {PAIR} select r, c, round(case when b.v is null or abs(b.v - a.v) between 1000 and 20000 then a.v end, 6) as v from a left join b using (r, c)")
def dz_filter(spark, sf):
    a, b = _pair(spark, sf)
    return rnd(cellfilters.by_reference_difference(a, b, limits=(1000.0, 20000.0)), 6)


@query(f"with {PAIR}, d as (select r, c, a.v as v, b.v - a.v as dz from a left join b using (r, c)), p as (select quantile_cont(dz, 0.05) as lo, quantile_cont(dz, 0.95) as hi from d) select r, c, round(case when dz is null or (dz between lo and hi and abs(dz) between 0 and 30000) then v end, 6) as v from d, p")
def dz_percentile_filter(spark, sf):
    a, b = _pair(spark, sf)
    return rnd(cellfilters.by_reference_difference(a, b, perc=(5.0, 95.0), limits=(0.0, 30000.0)), 6)


@query(f"with {PAIR}, l as (select min(v) + 9000 as lo, max(v) - 9000 as hi from b) select r, c, round(case when v between lo and hi then v end, 6) as v from a, l")
def reference_range_filter(spark, sf):
    a, b = _pair(spark, sf)
    return rnd(cellfilters.by_reference_range(a, b, -9000.0), 6)


@query(f"with {PAIR} select r, c, round(case when b.v is not null then a.v end, 6) as v from a left join b using (r, c)")
def mask_by_raster(spark, sf):
    return rnd(cellfilters.by_mask(*_pair(spark, sf)), 6)


@query(f"with {fx.STACK}, full_ as (select r, c from stack group by r, c having count(v) = 7) select layer, r, c, round(v, 6) as v from stack join full_ using (r, c)")
def common_mask(spark, sf):
    return rnd(stats.apply_common_mask(fx.stack(spark, sf), "layer", 7).select("layer", "r", "c", "v"), 6)


# --- bins ---------------------------------------------------------------------


@query(f"with {fx.POINTS} select cast(floor((200.0 - y) / 20) as integer) as r, cast(floor(x / 20) as integer) as c, floor(x / 20) * 20 + 10 as x, 200 - (floor((200.0 - y) / 20) * 20 + 10) as y, count(z) as n, round(quantile_cont(z, 0.5), 4) as v from points where floor(x / 20) between 0 and 99 and floor((200.0 - y) / 20) between 0 and 9 group by all")
def block_stats_median(spark, sf):
    p = fx.points(spark, sf)
    return rnd(points.block_stats(p, *fx.frame(p, 20.0, 2000.0, 200.0), "median"), 4)


@query(f"""with {fx.POINTS}, l as (select greatest(500, ceil(max(x) / 10) * 10) as x1, greatest(200, ceil(max(y) / 10) * 10) as y1 from points),
rr as (select unnest(range(cast(round(y1 / 10) as bigint))) as r from l), cc as (select unnest(range(cast(round(x1 / 10) as bigint))) as c from l),
m as (select floor((y1 - y) / 10) as r, floor(x / 10) as c, avg(z) as v from points, l group by all)
select cast(rr.r as integer) as r, cast(cc.c as integer) as c, round(m.v, 7) as v from rr cross join cc left join m on rr.r = m.r and cc.c = m.c""")
def block_stats_full_grid(spark, sf):
    p = fx.points(spark, sf)
    return rnd(points.block_stats_grid(p, *fx.frame(p, 10.0, 500.0, 200.0), "mean"), 7)


@query(f"with {fx.POINTS}, b as (select floor(y / 10) * 10 as edge, z as v from points), m as (select edge, quantile_cont(v, 0.5) as med from b group by edge), d as (select edge, quantile_cont(abs(v - med), 0.5) * 1.4826::double as nmad from b join m using (edge) group by edge) select edge, count(v) as n, round(avg(v), 4) as mean, round(stddev_pop(v), 4) as std, round(any_value(med), 4) as med, round(any_value(nmad), 4) as nmad, edge + 5 as center from b join m using (edge) join d using (edge) group by edge")
def bin_x_by_z(spark, sf):
    return rnd(stats.bin_x_by_z(fx.points(spark, sf), "z", "y", 10.0), 4)


@query(f"with {fx.POINTS}, l as (select min(x) as lo, max(x) as hi from points) select least(cast(floor((x - lo) / (hi - lo) * 128) as bigint) + 1, 128) as bin, count(z) as n, round(avg(z), 6) as stat from points, l group by 1")
def equal_bin_stats(spark, sf):
    return rnd(stats.equal_bins(fx.points(spark, sf), "x", "z"), 6)


@query(f"with {fx.POINTS}, q as (select * from points where x between 0 and 2048 and y between 0 and 128) select least(cast(floor(x / 64) as bigint) + 1, 32) as bx, least(cast(floor(y / 8) as bigint) + 1, 16) as by, count(*) as n from q group by all")
def hist2d(spark, sf):
    p = fx.points(spark, sf)
    x0, x1, y0, y1 = fx.limits(p, 64.0, 8.0, 2048.0, 128.0)
    return stats.hist2d(p, "x", "y", round((x1 - x0) / 64), round((y1 - y0) / 8), (x0, x1, y0, y1))


@query(f"with {fx.POINTS}, p as (select floor(quantile_cont(z, 0.0001) / 5000) as a, ceil(quantile_cont(z, 0.9999) / 5000) as b from points) select cast(unnest(range(cast(a as bigint), cast(b as bigint) + 1)) * 5000 as double) as edge from p")
def bin_edges(spark, sf):
    return stats.bin_edges(fx.points(spark, sf).select(F.col("z").alias("v")), 5000.0)


# --- stacks -------------------------------------------------------------------


@query(f"with {fx.STACK}, o as (select r, c, v, {fx.ORD} as t from stack) select r, c, count(v) as n, round(avg(v), 6) as mean, round(case when count(v) > 1 then stddev_pop(v) end, 6) as std, round(min(v), 6) as vmin, round(max(v), 6) as vmax, round(regr_slope(v, t - 728000) * 365.25::double, 3) as slope from o group by r, c having count(v) > 1")
def stack_stats_trend(spark, sf):
    s = stack.stats_and_trend(fx.stack(spark, sf), fx.layers(spark, sf)).where("slope is not null")
    return rnd(s.select("r", "c", "n", "mean", "std", "vmin", "vmax", "slope"), 6, slope=3)


@query(f"with {fx.STACK} select r, c, count(v) as n, round(avg(v), 6) as mean, round(case when count(v) > 1 then stddev_pop(v) end, 6) as std, round(min(v), 6) as vmin, round(max(v), 6) as vmax from stack group by r, c")
def stack_stats(spark, sf):
    return rnd(stack.stack_stats(fx.stack(spark, sf)), 6)


@query(f"with {fx.STACK}, m as (select r, c, quantile_cont(v, 0.5) as med from stack group by r, c) select r, c, count(v) as n, round(any_value(med), 6) as med, round(quantile_cont(abs(v - med), 0.5) * 1.4826::double, 3) as nmad from stack join m using (r, c) group by r, c")
def stack_nmad(spark, sf):
    return rnd(stack.stack_stats(fx.stack(spark, sf), robust=True).select("r", "c", "n", "med", "nmad"), 6, nmad=3)


@query(f"with {fx.STACK}, o as (select r, c, {fx.ORD} as t from stack) select r, c, min(t) as dt_min, max(t) as dt_max, nullif(max(t) - min(t), 0) as dt_ptp, min(t) + (max(t) - min(t)) / 2 as dt_center from o group by r, c")
def date_stats(spark, sf):
    return stack.date_stats(fx.stack(spark, sf), fx.layers(spark, sf))


@query(f"with {fx.STACK}, o as (select r, c, {fx.ORD} as t from stack), s as (select max(t) - min(t) as ptp from o group by r, c) select round(quantile_cont(nullif(ptp, 0), 0.96) * 0.2::double, 6) as min_span from s")
def default_min_span(spark, sf):
    return rnd(stack.default_min_span(stack.date_stats(fx.stack(spark, sf), fx.layers(spark, sf))))


@query(f"""with {fx.STACK}, o as (select r, c, v, {fx.ORD} - 728000 as t from stack),
f as (select r, c, count(v) as n, regr_slope(v, t) as b, regr_intercept(v, t) as a, regr_r2(v, t) as r2, max(t) - min(t) as span from o group by r, c having count(v) >= 3 and max(t) - min(t) >= 1000),
e as (select r, c, v - a - b * t as res, n, a, b, r2 from o join f using (r, c)), m as (select r, c, quantile_cont(res, 0.5) as med from e group by r, c)
select r, c, any_value(n) as n, round(any_value(b) * 365.25::double, 3) as slope, round(any_value(a - b * 728000), 0) as intercept, round(quantile_cont(abs(res - med), 0.5) * 1.4826::double, 3) as detrended_std, round(any_value(r2), 5) as rsq from e join m using (r, c) group by r, c""")
def stack_trend(spark, sf):
    return rnd(stack.trend(fx.stack(spark, sf), fx.layers(spark, sf), 3, 1000.0), 3, intercept=0, rsq=5)


@query(f"""with {fx.STACK}, o as (select r, c, v, {fx.ORD} - 728000 as t from stack),
f as (select r, c, count(v) as n, regr_slope(v, t) as b, regr_r2(v, t) as r2 from o group by r, c having count(v) >= 3),
x as (select *, sqrt(r2 * (n - 2) / (1 - r2)) as stat, [{', '.join(map(str, stack.T95))}][n - 2] as lim from f)
select r, c, n, round(b * 365.25::double, 3) as slope from x where stat > lim""")
def significant_trends(spark, sf):
    found = stack.significant(stack.trend(fx.stack(spark, sf), fx.layers(spark, sf), 3))
    return rnd(found.select("r", "c", "n", "slope"), 3)


@query("select * from (values (1, 500000.0::double, 4982950.4::double), (2, 833978.557::double, 0.0::double), (3, 166021.443::double, 0.0::double), (4, 500000.0::double, 10000000.0 - 4982950.4::double)) t(id, x, y)")
def utm_known_points(spark, sf):
    """Published values: the meridian arc to 45 degrees, and both edges of a zone on the equator."""
    p = spark.createDataFrame([(1, 3.0, 45.0), (2, 6.0, 0.0), (3, 0.0, 0.0), (4, 3.0, -45.0)], "id int, lon double, lat double")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.lit(31))
    return p.select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"with {fx.LONLAT}, p as (select * from lonlat where abs(lat) between 60 and 89) select id, round(((lon + 180) - 360 * floor((lon + 180) / 360)) - 180, 7) as lon, round(lat, 7) as lat from p")
def polar_round_trip(spark, sf):
    """Through both polar grids and back by way of UTM-free inverses."""
    p = fx.lonlat(spark, sf).where("abs(lat) between 60 and 89")
    back = []
    for code, own in (("EPSG:3413", F.col("lat") > 0), ("EPSG:3031", F.col("lat") < 0)):
        x, y = geo.transform("EPSG:4326", code)(F.col("lon"), F.col("lat"))
        lon, lat = geo.transform(code, "EPSG:4326")(F.col("x"), F.col("y"))
        back.append(p.where(own).select("id", x.alias("x"), y.alias("y")).select("id", geo.lon_180(F.round(lon, 7)).alias("lon"), lat.alias("lat")))
    return rnd(back[0].unionByName(back[1]), 7)


def _round_sql(k: int) -> str:
    """CTEs that fit the lines of observations o{k} and keep, as o{k+1}, what is within three deviations."""
    return f"""f{k} as (select r, c, regr_slope(v, t) as b, regr_intercept(v, t) as a from o{k} group by r, c having count(v) >= 3 and max(t) > min(t)),
e{k} as (select r, c, v, t, v - a - b * t as res from o{k} join f{k} using (r, c)), m{k} as (select r, c, quantile_cont(res, 0.5) as med from e{k} group by r, c),
d{k} as (select r, c, quantile_cont(abs(res - med), 0.5) * 1.4826::double as nmad from e{k} join m{k} using (r, c) group by r, c), o{k + 1} as (select r, c, v, t from e{k} join d{k} using (r, c) where nmad < 1e-5 or abs(res) < 3 * nmad)"""


@query(f"with {fx.STACK}, o0 as (select r, c, v, {fx.ORD} - 728000 as t from stack), {_round_sql(0)}, {_round_sql(1)} select r, c, count(v) as n, round(regr_slope(v, t) * 365.25::double, 3) as slope, round(regr_r2(v, t), 5) as rsq from o2 group by r, c having count(v) >= 3 and max(t) > min(t)")
def stack_trend_without_outliers(spark, sf):
    found = stack.trend(fx.stack(spark, sf), fx.layers(spark, sf), 3, remove_outliers=True)
    return rnd(found.select("r", "c", "n", "slope", "rsq"), 3, rsq=5)


@query(f"""with {fx.STACK}, o as (select r, c, v, {fx.ORD} as t from stack), s as (select a.r, a.c, quantile_cont((b.v - a.v) / (b.t - a.t), 0.5) as m from o a join o b on a.r = b.r and a.c = b.c and b.t > a.t group by all)
select o.r, o.c, count(*) as n, round(any_value(m) * 365.25::double, 3) as slope, round(quantile_cont(v - m * t, 0.5), 0) as intercept from o join s on o.r = s.r and o.c = s.c group by o.r, o.c""")
def stack_theil_sen(spark, sf):
    return rnd(stack.theil_sen(fx.stack(spark, sf), fx.layers(spark, sf)), 3, intercept=0)


@query(f"with {fx.STACK} select layer, r, c, round(v, 6) as v from stack where layer in (1996, 1998, 2000)")
def stack_subset(spark, sf):
    return rnd(stack.subset(fx.stack(spark, sf), [1996, 1998, 2000]).select("layer", "r", "c", "v"), 6)


@query(f"with {fx.STACK}, a as (select * from stack where layer <= 1997), m as (select max(layer) as m from a) select cast(layer as bigint) as layer, r, c, round(v, 6) as v from a union all select layer - 1997 + m, r, c, round(v, 6) from stack, m where layer > 1997")
def stack_merge(spark, sf):
    s = fx.stack(spark, sf)
    a, b = s.where("layer <= 1997"), s.where("layer > 1997").withColumn("layer", F.col("layer") - 1997)
    return rnd(stack.merge(a, b.select(*a.columns)).select(F.col("layer").cast("long").alias("layer"), "r", "c", "v"), 6)


@query(f"with {fx.STACK} select layer, r - 8 as r, c - 4 as c, round(v, 6) as v from stack where r between 8 and 23 and c between 4 and 19")
def stack_clip(spark, sf):
    return rnd(model.clip_and_reindex(fx.stack(spark, sf), 8, 23, 4, 19, ["layer"]), 6)


@query(f"with {fx.STACK} select r, c, round(arg_min(v, layer), 6) as v from stack group by r, c")
def mosaic_first(spark, sf):
    return rnd(stack.mosaic(fx.stack(spark, sf), "first"), 6)


@query(f"with {fx.STACK} select r, c, round(quantile_cont(v, 0.5), 6) as v from stack group by r, c")
def mosaic_median(spark, sf):
    return rnd(stack.mosaic(fx.stack(spark, sf), "median"), 6)


# --- neighbourhoods --------------------------------------------------------------

NEAR = "off as (select cast(a.range - {n} as integer) as i, cast(b.range - {n} as integer) as j from range({m}) a, range({m}) b)"


@query(f"with {fx.RASTER}, {NEAR.format(n=1, m=3)}, s as (select r - i as r, c - j as c, v from raster, off where v is not null) select s.r, s.c, round(quantile_cont(s.v, 0.5), 8) as v from s join raster t on s.r = t.r and s.c = t.c and t.v is not null group by all")
def rolling_median(spark, sf):
    return rnd(neighbourhood.rolling(fx.raster(spark, sf)), 8)


@query(f"with {fx.RASTER}, {NEAR.format(n=2, m=5)}, s as (select r - i as r, c - j as c, v from raster, off where v is not null and i * i + j * j <= 4) select s.r, s.c, max(s.v) as v from s where s.r between 0 and (select max(r) from raster) and s.c between 0 and (select max(c) from raster) group by all")
def rolling_max_disc(spark, sf):
    return neighbourhood.rolling(fx.raster(spark, sf), F.max, 5, circular=True, keep_mask=False, shape=fx.raster_shape(spark, sf))


@query(f"with {fx.RASTER}, {NEAR.format(n=3, m=7)}, s as (select r - i as r, c - j as c, v from raster, off where v is not null) select t.r, t.c, case when t.v is not null then round(avg(s.v), 8) end as v from raster t left join s on s.r = t.r and s.c = t.c group by t.r, t.c, t.v")
def box_mean(spark, sf):
    return rnd(neighbourhood.box_mean(fx.raster(spark, sf), 7), 8)


def _kernel_sql(sigma: float, size: int | None = None) -> str:
    k = neighbourhood.gauss_kernel(sigma, size)
    return "k as (select cast(unnest(range(%d)) - %d as integer) as o, unnest([%s]) as w)" % (len(k), len(k) // 2, ", ".join(f"{x!r}::double" for x in k))


_GAUSS = f"{_kernel_sql(1.0)}, g1 as (select r, c + o as c, sum(v * w) as s, sum(w) as w from raster, k where v is not null group by all), g2 as (select g1.r + o as r, c, sum(s * k.w) as s, sum(g1.w * k.w) as w from g1, k group by all)"


@query(f"with {fx.RASTER}, {_GAUSS} select raster.r, raster.c, round(s / w, 8) as v from raster join g2 on raster.r = g2.r and raster.c = g2.c where v is not null")
def gauss_smooth(spark, sf):
    return rnd(neighbourhood.gaussian(fx.raster(spark, sf), 1.0), 8)


@query(f"with {fx.RASTER}, {_GAUSS} select raster.r, raster.c, round(coalesce(v, s / w), 8) as v from raster left join g2 on raster.r = g2.r and raster.c = g2.c")
def gauss_fill(spark, sf):
    return rnd(neighbourhood.gaussian_fill(fx.raster(spark, sf), 1.0, fx.raster_shape(spark, sf)), 8)


@query(f"with {fx.RASTER}, {_GAUSS}, h as (select raster.r, raster.c, v - s / w as v from raster join g2 on raster.r = g2.r and raster.c = g2.c where v is not null) select r, c, round(v - (select least(min(v), 0) from h), 8) as v from h")
def highpass(spark, sf):
    return rnd(neighbourhood.highpass(fx.raster(spark, sf), 1.0), 8)


@query(f"with {fx.RASTER} select cast(r // 10 as integer) as r, cast(c // 8 as integer) as c, round(avg(v), 8) as v from raster group by all")
def block_means(spark, sf):
    return rnd(neighbourhood.block_view(fx.raster(spark, sf), 10, 8), 8)


@query(f"with {fx.RASTER}, w as (select a.r, a.c, b.v from raster a join raster b on b.r between a.r and a.r + 2 and b.c between a.c and a.c + 2 where a.r % 3 = 0 and a.c % 3 = 0) select r, c, min(v) as v from w group by r, c having count(*) = 9")
def sliding_min(spark, sf):
    return neighbourhood.sliding(fx.raster(spark, sf), 3, 3, 3, F.min)


@query(f"with {fx.SERIES}, w as (select ts, avg(val) over (order by ts rows between 5 preceding and current row) as stat, row_number() over (order by ts) as i, val from series) select ts, round(val, 6) as val, round(stat, 6) as stat from w where i >= 6")
def rolling_series(spark, sf):
    return rnd(neighbourhood.rolling_series(fx.series(spark, sf), 6))


def _at(dr: int, dc: int) -> str:
    return f"max(av) filter (dr = {dr} and dc = {dc})"


_HORN = f"""nb as (select b.r, b.c, b.v, a.v as av, a.r - b.r as dr, a.c - b.c as dc from raster b join raster a on a.r between b.r - 1 and b.r + 1 and a.c between b.c - 1 and b.c + 1 where a.v is not null and b.v is not null),
h as (select r, c, v, ({_at(-1, 1)} + 2 * {_at(0, 1)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(0, -1)} - {_at(1, -1)}) / 0.8::double as gx, ({_at(1, -1)} + 2 * {_at(1, 0)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(-1, 0)} - {_at(-1, 1)}) / 0.8::double as gy, max(av) as hi, min(av) as lo, sum(av) - v as others, sum(abs(av - v)) as away from nb group by r, c, v having count(*) = 9)"""


def _horn(select: str) -> str:
    return f"with {fx.RASTER}, {_HORN} select r, c, {select} as v from h"


@query(_horn("round(degrees(atan(sqrt(gx * gx + gy * gy))), 6)"))
def slope(spark, sf):
    return rnd(neighbourhood.slope(fx.raster(spark, sf), 0.1))


@query(_horn("round(case when gx <> 0 or gy <> 0 then (90 - degrees(atan2(gy, -gx))) - 360 * floor((90 - degrees(atan2(gy, -gx))) / 360) end, 5)"))
def aspect(spark, sf):
    return rnd(neighbourhood.aspect(fx.raster(spark, sf), 0.1), 5)


@query(_horn("round(1 + 254 * greatest(cos(pi() / 4) * cos(atan(sqrt(gx * gx + gy * gy))) + sin(pi() / 4) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(pi() / 2 - radians(315) - atan2(gy, -gx)), 0), 5)"))
def hillshade(spark, sf):
    return rnd(neighbourhood.hillshade(fx.raster(spark, sf), 0.1), 5)


@query(_horn("round(hi - lo, 8)"))
def roughness(spark, sf):
    return rnd(neighbourhood.roughness(fx.raster(spark, sf)), 8)


@query(_horn("round(v - others / 8, 8)"))
def position_index(spark, sf):
    return rnd(neighbourhood.position_index(fx.raster(spark, sf)), 8)


@query(_horn("round(away / 8, 8)"))
def ruggedness(spark, sf):
    return rnd(neighbourhood.ruggedness(fx.raster(spark, sf)), 8)


# --- morphology --------------------------------------------------------------------

_BALL = "ball as (select cast(a.range - 2 as integer) as i, cast(b.range - 2 as integer) as j from range(5) a, range(5) b where abs(a.range - 2) + abs(b.range - 2) <= 2)"


@query(f"with {fx.RASTER}, {_BALL} select distinct r + i as r, c + j as c from raster, ball where v > 0.2 and r + i between 0 and 499 and c + j between 0 and 63")
def mask_dilate(spark, sf):
    return morphology.dilate_valid(cellfilters.in_range(fx.raster(spark, sf), 0.2000000001, 9.0), 2, fx.raster_shape(spark, sf))


@query(f"with {fx.RASTER}, {_BALL}, g as (select distinct r + i as r, c + j as c from raster, ball where v is null) select r, c, v from raster where v is not null and (r, c) not in (select (r, c) from g)")
def erode_edge(spark, sf):
    return morphology.grow_mask(fx.raster(spark, sf), 2, fx.raster_shape(spark, sf)).select("r", "c", "v")


@query(f"with {fx.RASTER}, v as (select r, c from raster where v > 0.2), a as (select r, unnest([min(c), max(c)]) as c from v group by r), b as (select unnest([min(r), max(r)]) as r, c from v group by c) select r, c from a union select r, c from b")
def valid_edges(spark, sf):
    return morphology.edges(cellfilters.in_range(fx.raster(spark, sf), 0.2000000001, 9.0))


@query(f"with {fx.RASTER}, b as (select min(r) as r0, max(r) as r1, min(c) as c0, max(c) as c1 from raster where abs(v) >= 0.35) select r - r0 as r, c - c0 as c, case when abs(v) >= 0.35 then v end as v from raster, b where r between r0 and r1 and c between c0 and c1")
def edge_trim(spark, sf):
    return morphology.trim(cellfilters.in_abs_range(fx.raster(spark, sf), 0.35, 9.0))


@query(f"""with recursive {fx.RASTER}, m as (select r, c, abs(v) < 0.04 or v is null as gap from raster), h(r, c) as (
select r, c from m where gap and (r in (0, 499) or c in (0, 63)) union select m.r, m.c from h join m on m.gap and abs(m.r - h.r) + abs(m.c - h.c) = 1)
select r, c from m where gap and (r, c) not in (select (r, c) from h)""")
def enclosed_holes(spark, sf):
    cells = cellfilters.in_abs_range(fx.raster(spark, sf), 0.04, 9.0)
    return morphology.holes(cells, fx.raster_shape(spark, sf)).select(F.col("r").cast("int").alias("r"), "c")


# --- time --------------------------------------------------------------------------


@query("select event_id, date_trunc('minute', ts) as dt from events")
def fn_datetime(spark, sf):
    return fx.names(spark, sf).select("event_id", T.datetime_in_name(F.col("fn")).alias("dt"))


# Forms of names, by the event's number modulo six, and the date that each holds; four digits behind a date pass as a clock.
@query("""select event_id, case event_id % 6 when 0 then date_trunc('day', ts) + interval 630 minute when 1 then null when 2 then null when 3 then date_trunc('minute', ts) when 4 then date_trunc('year', ts) else date_trunc('day', ts) end::timestamp as dt from events""")
def catalogue_names(spark, sf):
    e, day = fx.events(spark, sf), F.date_format("ts", "yyyyMMdd")
    number = F.col("event_id").cast("string")
    form = F.expr("event_id % 6")
    fn = (
        F.when(form == 0, F.concat(F.lit("/data/v1_2020/dem_"), day, F.lit("_10300100207D5600-DEM.tif")))
        .when(form == 1, F.concat(F.lit("WV02_1030010020"), day, F.lit("-DEM.tif")))
        .when(form == 2, F.concat(F.lit("run1"), day, F.lit("x"), number, F.lit(".tif")))
        .when(form == 3, F.concat(F.lit("x-"), F.date_format("ts", "yyyyMMdd'T'HHmm"), F.lit("_20010101.tif")))
        .when(form == 4, F.concat(F.lit("dem_"), F.date_format("ts", "yyyy"), F.lit("_1x"), number, F.lit(".v2.tif")))
        .otherwise(F.concat(F.lower(F.date_format("ts", "ddMMMyy")), F.lit(".tif")))
    )
    return e.select("event_id", T.datetime_in_name(fn).alias("dt"))


@query("select event_id, round(year(ts) + epoch_us(ts - make_timestamp(year(ts), 1, 1, 0, 0, 0.0)::timestamp::timestamp)::double / 1 / 86400000000.0 / 366, 9) as decyear from (select event_id, ts from events)".replace("epoch_us(ts - make_timestamp(year(ts), 1, 1, 0, 0, 0.0)::timestamp::timestamp)::double / 1", "(epoch_us(ts) - epoch_us(make_timestamp(year(ts), 1, 1, 0, 0, 0.0)))::double"))
def dec_year(spark, sf):
    return fx.events(spark, sf).select("event_id", F.round(T.decimal_year("ts"), 9).alias("decyear"))


@query("select event_id, cast(floor(julian(cast(ts as date)) + 0.5) as bigint) as jd from events")
def julian_date(spark, sf):
    return fx.events(spark, sf).select("event_id", T.julian_day("ts").alias("jd"))


@query("select event_id, epoch_us(ts)::double / 86400000000.0::double + 719163.0::double as o, epoch_us(ts)::double / 86400000000.0::double + 719163.0::double + 366.0::double as matlab, cast(dayofyear(ts) as integer) as doy, strftime(ts, '%Y%m%d_%H%M') as stamp, date_trunc('day', ts + interval 12 hour) as day from events")
def time_scales(spark, sf):
    e = fx.events(spark, sf)
    return e.select("event_id", T.ordinal("ts").alias("o"), T.matlab_day("ts").alias("matlab"), T.day_of_year("ts").alias("doy"), T.stamp("ts").alias("stamp"), T.round_to_day("ts").alias("day"))


@query("select o_orderkey, cast(o_orderdate as timestamp) as gps from orders")
def gps_round_trip(spark, sf):
    ms = F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1980-01-06 00:00:00'"), F.col("o_orderdate"))
    o = fx.table(spark, sf, "orders").withColumn("_ms", ms)
    return o.select("o_orderkey", T.gps_to_timestamp(F.floor(F.col("_ms") / 604800000), F.pmod(F.col("_ms"), F.lit(604800000))).alias("gps"))


@query("""with q as (select o_orderkey as id, o_orderdate - interval '3' hour as qts from orders), c as (select distinct cast(o_orderdate as timestamp) as cts from orders), n as (select cts, epoch_us(cts) as idx from c)
select id, arg_min(idx, (abs(epoch_us(qts) - epoch_us(cts)), idx)) as idx from q, n group by id""")
def nearest_date(spark, sf):
    o = fx.table(spark, sf, "orders")
    q = o.select(F.col("o_orderkey").alias("id"), F.expr("o_orderdate - interval '3' hour").alias("ts"))
    c = o.select(F.col("o_orderdate").alias("cts"), T.micros("o_orderdate").alias("idx")).distinct()
    return T.nearest(q, c, bucket_days=400).select("id", "idx")


@query("select a.event_id as id, b.event_id as other from events a join events b on a.ts > b.ts - interval 10 minute and a.ts < b.ts + interval 10 minute where b.event_type = 'purchase'")
def padded_dates(spark, sf):
    e = fx.events(spark, sf)
    q = e.select(F.col("event_id").alias("id"), "ts")
    c = e.where("event_type = 'purchase'").select(F.col("event_id").alias("other"), F.col("ts").alias("cts"))
    return T.within(q, c, 10 / 1440).select("id", "other")


@query("with g as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over w) > 43200000000 then 1 else 0 end as new from events window w as (partition by user_id order by ts)), k as (select user_id, ts, cast(sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as bigint) as cluster from g) select user_id, cluster, min(ts) as first, max(ts) as last, count(*) as n from k group by all")
def dt_cluster(spark, sf):
    return T.clusters(fx.events(spark, sf), "ts", 0.5, ("user_id",))


@query("with d as (select event_id as idx, date_trunc('hour', ts) as ts, event_type from events), n as (select *, row_number() over (partition by event_type order by ts, idx) as k from d), m as (select *, max(epoch_us(ts) - (k - 1) * 1000) over (partition by event_type order by ts, idx rows between unbounded preceding and current row) + (k - 1) * 1000 as us from n) select idx, make_timestamp(cast(us as bigint)) as fixed from m")
def fix_repeated_dates(spark, sf):
    d = fx.events(spark, sf).select(F.col("event_id").alias("idx"), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"), "event_type")
    return T.fix_repeated(d, keys=("event_type",)).select("idx", "fixed")


@query("select o_orderkey from orders where month(o_orderdate) * 100 + day(o_orderdate) >= 1115 or month(o_orderdate) * 100 + day(o_orderdate) <= 210")
def seasonal_dates(spark, sf):
    return T.seasonal(fx.table(spark, sf, "orders"), (11, 15), (2, 10), "o_orderdate").select("o_orderkey")


@query("with y as (select unnest(range(min(year(o_orderdate)) - 1, max(year(o_orderdate)) + 1)) as y from orders), b as (select make_date(y, 10, 1) as b0, make_date(y + 1, 4, 1) as b1 from y) select o_orderkey, b0 from orders join b on o_orderdate >= b0 and o_orderdate < b1")
def annual_windows(spark, sf):
    o = fx.table(spark, sf, "orders")
    return T.in_bounds(o, T.annual_bounds(o, (10, 1), (4, 1), "o_orderdate"), "o_orderdate").select("o_orderkey", "b0")


@query("select to_timestamp(0)::timestamp + to_microseconds(cast(round_even(avg(epoch_us(ts)::double), 0) as bigint)) as mean_date, make_timestamp(cast(round_even((min(epoch_us(ts)) + max(epoch_us(ts))) / 2, 0) as bigint)) as mid_date, make_timestamp(cast(round_even(quantile_cont(epoch_us(ts)::double, 0.5), 0) as bigint)) as median_date, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 86400000000.0, 8) as span_days from events")
def date_summary(spark, sf):
    return rnd(T.date_summary(fx.events(spark, sf)), 8)


@query("select cast(ts as date) as day, min(event_id) as idx from events group by 1")
def first_of_day(spark, sf):
    return T.first_of_day(fx.events(spark, sf), "ts", "event_id").withColumnRenamed("event_id", "idx")


@query("select distinct year(o_orderdate)::integer as y, month(o_orderdate)::integer as m from orders")
def year_months(spark, sf):
    return fx.table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()


@query("select date_trunc('hour', ts) as start, count(value) as n, round(avg(value), 6) as mean from events group by 1")
def tumbling_events(spark, sf):
    w = live.tumbling(fx.events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))
    return rnd(w.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "mean"))


# --- geometry ----------------------------------------------------------------------


@query(f"with {fx.FOOT} select min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from foot")
def footprint_union(spark, sf):
    return geo.union_extent(fx.footprints(spark, sf))


@query(f"with {fx.FOOT}, i as (select fid // 2 as k, max(xmin) as xmin, max(ymin) as ymin, min(xmax) as xmax, min(ymax) as ymax from foot group by 1) select cast(k as integer) as k, case when ok then xmin end as xmin, case when ok then ymin end as ymin, case when ok then xmax end as xmax, case when ok then ymax end as ymax from (select *, xmin < xmax and ymin < ymax as ok from i)")
def footprint_intersection(spark, sf):
    return geo.intersection_extent(fx.footprints(spark, sf).withColumn("k", F.expr("cast(fid div 2 as int)")), ("k",))


@query(f"with {fx.FOOT} select fid, region, xmin - 1.2 as xmin, ymin - 0.6 as ymin, xmax + 1.2 as xmax, ymax + 0.6 as ymax from foot".replace("1.2", "12.0::double * 0.1").replace("0.6", "6.0::double * 0.1"))
def padded_footprints(spark, sf):
    return geo.pad_extent(fx.footprints(spark, sf))


_CELLS = "g as (select cast(a.range as integer) as r, cast(b.range as integer) as c, b.range + 0.5::double as x, 40 - (a.range + 0.5::double) as y from range(40) a, range(260) b)"


@query(f"with {fx.FOOT}, {_CELLS} select r, c, count(*) as n from g join foot on x > xmin and x < xmax and y > ymin and y < ymax group by r, c")
def heatmap(spark, sf):
    v = vector.boxes_to_vertices(fx.footprints(spark, sf))
    return vector.heatmap(v, 40, 260, [0.0, 1.0, 0.0, 40.0, 0.0, -1.0])


@query(f"with {fx.FOOT}, p as (select c_custkey as id, (c_custkey % 260)::double as x, (c_custkey % 31)::double as y from customer) select id, fid from p join foot on x between xmin and xmax and y between ymin and ymax")
def points_in_footprints(spark, sf):
    p = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 260).cast("double").alias("x"), (F.col("c_custkey") % 31).cast("double").alias("y"))
    return vector.points_in_boxes(p, fx.footprints(spark, sf), 10.0).select("id", "fid")


@query(f"with {fx.RASTER}, {fx.FOOT}, inside as (select distinct r, c from raster join foot on c * 4 + 2 >= xmin and c * 4 + 2 < xmax and 500 - r - 0.5 > ymin and 500 - r - 0.5 < ymax) select r, c, v from raster where (r, c) in (select (r, c) from inside)")
def clip_by_footprints(spark, sf):
    v = vector.boxes_to_vertices(fx.footprints(spark, sf))
    return vector.clip_by_polygons(fx.raster(spark, sf), v, 500, 64, [0.0, 4.0, 0.0, 500.0, 0.0, -1.0])


@query(f"with {fx.LONLAT} select id, round((lon * 2 + 180) - 360 * floor((lon * 2 + 180) / 360) - 180, 8) as lon180, round(lon - 360 * floor(lon / 360), 8) as lon360 from lonlat")
def lon_wrap(spark, sf):
    return rnd(fx.lonlat(spark, sf).select("id", geo.lon_180(F.col("lon") * 2).alias("lon180"), geo.lon_360(F.col("lon")).alias("lon360")), 8)


@query(f"""with {fx.LONLAT}, n as (select id, lat, lon + 180 - 360 * floor((lon + 180) / 360) - 180 as lon from lonlat), z as (select id, lat, case when lat >= 56 and lat < 64 and lon >= 3 and lon < 12 then 32 when lat >= 72 and lat < 84 and lon >= 0 and lon < 9 then 31 when lat >= 72 and lat < 84 and lon >= 9 and lon < 21 then 33 when lat >= 72 and lat < 84 and lon >= 21 and lon < 33 then 35 when lat >= 72 and lat < 84 and lon >= 33 and lon < 42 then 37 else cast(floor((lon + 180) / 6) as integer) + 1 end as zone from n)
select id, cast(zone as integer) as zone, cast(case when lat >= 0 then 32600 else 32700 end + zone as integer) as epsg from z""")
def utm_zone(spark, sf):
    ll = fx.lonlat(spark, sf)
    return ll.select("id", geo.utm_zone(F.col("lon"), F.col("lat")).alias("zone"), geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query(f"with {fx.LONLAT}, a as (select id, lon, abs(lon) as a from lonlat) select id, cast(case when lon < 0 then -1 else 1 end as integer) as sign, cast(floor(a) as bigint) as d, cast(floor((a - floor(a)) * 60) as bigint) as m, round((a - floor(a)) * 3600 - floor((a - floor(a)) * 60) * 60, 6) as s from a")
def dms(spark, sf):
    x = fx.lonlat(spark, sf).select("id", geo.dd_to_dms(F.col("lon")).alias("q")).select("id", "q.sign", "q.d", "q.m", "q.s")
    return rnd(x)


@query(f"with {fx.LONLAT}, n as (select id, radians(lat) as p, radians(lon) as l from lonlat), e as (select id, p, l, 6378137.0::double / sqrt(1 - 0.0066943799901413165::double * sin(p) * sin(p)) as n from n) select id, round((n + 100) * cos(p) * cos(l), 4) as x, round((n + 100) * cos(p) * sin(l), 4) as y, round((n * (1 - 0.0066943799901413165::double) + 100) * sin(p), 4) as z from e")
def ecef(spark, sf):
    x, y, z = geo.to_ecef(F.col("lon"), F.col("lat"), F.lit(100.0))
    return rnd(fx.lonlat(spark, sf).select("id", x.alias("x"), y.alias("y"), z.alias("z")), 4)


@query(f"with {fx.LONLAT} select id, round(lon - 360 * floor((lon + 180) / 360), 6) as lon, round(lat, 6) as lat, round(100.0::double, 3) as h from lonlat where abs(lat) < 90")
def ecef_round_trip(spark, sf):
    lon, lat, h = geo.from_ecef(*geo.to_ecef(F.col("lon"), F.col("lat"), F.lit(100.0)))
    return rnd(fx.lonlat(spark, sf).where("abs(lat) < 90").select("id", geo.lon_180(F.round(lon, 9)).alias("lon"), lat.alias("lat"), h.alias("h")), 6, h=3)


@query(f"with {fx.LONLAT} select id, round(lon - 360 * floor((lon + 180) / 360), 6) as lon, round(lat, 6) as lat from lonlat where abs(lat) < 84")
def utm_round_trip(spark, sf):
    ll = fx.lonlat(spark, sf).where("abs(lat) < 84").withColumn("zone", geo.utm_zone(F.col("lon"), F.col("lat")))
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    m = ll.select("id", "zone", "lat", x.alias("x"), y.alias("y"))
    lon, back = geo.from_utm(F.col("x"), F.col("y"), F.col("zone"), F.col("lat") >= 0)
    return rnd(m.select("id", geo.lon_180(F.round(lon, 9)).alias("lon"), back.alias("lat")))


def _plane(cut: str) -> str:
    return f"with {fx.POINTS}, l as (select quantile_cont(z, 0.02) as lo, quantile_cont(z, 0.98) as hi from points), m as (select count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, var_pop(x) as xx, var_pop(y) as yy, covar_pop(x, y) as xy, covar_pop(x, z) as xz, covar_pop(y, z) as yz from points, l where {cut}) select n, round((xz * yy - yz * xy) / (xx * yy - xy * xy), 5) as a, round((yz * xx - xz * xy) / (xx * yy - xy * xy), 5) as b, round(mz - (xz * yy - yz * xy) / (xx * yy - xy * xy) * mx - (yz * xx - xz * xy) / (xx * yy - xy * xy) * my, 3) as c from m"


@query(_plane("true"))
def plane_fit(spark, sf):
    return rnd(points.plane_fit(fx.points(spark, sf), perc=None), 5, c=3)


@query(_plane("z between lo and hi"))
def plane_fit_within_percentiles(spark, sf):
    return rnd(points.plane_fit(fx.points(spark, sf)), 5, c=3)


_SAMPLED = "p as (select p_partkey as pid, (p_partkey % 600)::double as py, (p_partkey * 7 % 70)::double as px from part)"


def _sample_points(spark, sf):
    x, y = geo.pixel_to_map(fx.GT, F.col("p_partkey") * 7 % 70, F.col("p_partkey") % 600)
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("pid"), x.alias("x"), y.alias("y"))


@query(f"with {fx.RASTER}, {_SAMPLED}, {NEAR.format(n=1, m=3)}, w as (select pid, v from p, off join raster on r = py + i and c = px + j where v is not null), m as (select pid, quantile_cont(v, 0.5) as med, count(*) as n from w group by pid), d as (select pid, quantile_cont(abs(v - med), 0.5) * 1.4826::double as nmad from w join m using (pid) group by pid) select p.pid, coalesce(n, 0) as n, round(case when n >= 4.5 then med end, 8) as med, round(case when n >= 4.5 then nmad end, 8) as nmad from p left join m using (pid) left join d using (pid)")
def sample_points(spark, sf):
    return rnd(points.sample(fx.raster(spark, sf), _sample_points(spark, sf), fx.GT, 1), 8)


@query(f"with {fx.RASTER}, p as (select p_partkey as pid, p_partkey % 490 as r0, p_partkey * 7 % 60 as c0 from part), f as (select pid, a.v as a, b.v as b, c.v as c, d.v as d from p left join raster a on a.r = r0 and a.c = c0 left join raster b on b.r = r0 and b.c = c0 + 1 left join raster c on c.r = r0 + 1 and c.c = c0 left join raster d on d.r = r0 + 1 and d.c = c0 + 1) select pid, round(a * 0.375::double + b * 0.125::double + c * 0.375::double + d * 0.125::double, 8) as v from f")
def bilinear_samples(spark, sf):
    x, y = geo.pixel_to_map(fx.GT, F.col("p_partkey") * 7 % 60 + 0.25, F.col("p_partkey") % 490 + 0.5)
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("pid"), x.alias("x"), y.alias("y"))
    return rnd(points.bilinear(fx.raster(spark, sf), p, fx.GT), 8)


def _warped(spark, sf, res: float, algorithm: str):
    """The raster on a grid of cells of ``res`` that covers all of it."""
    src = warp.Grid(*fx.raster_shape(spark, sf), tuple(fx.GT), "EPSG:32610")
    xmin, ymin, xmax, ymax = src.extent
    rows, cols = math.ceil((ymax - ymin) / res), math.ceil((xmax - xmin) / res)
    return warp.warp(fx.raster(spark, sf), src, warp.Grid(rows, cols, (xmin, res, 0.0, ymax, 0.0, -res), src.srs), algorithm)


@query(f"with {fx.RASTER} select cast(r // 4 as integer) as r, cast(c // 4 as integer) as c, round(avg(v), 8) as v from raster where v is not null group by all")
def warp_average(spark, sf):
    return rnd(_warped(spark, sf, 120.0, "average"), 8)


@query(f"with {fx.RASTER} select cast(r * 3 + i as integer) as r, cast(c * 3 + j as integer) as c, v from raster, (select a.range as i, b.range as j from range(3) a, range(3) b) where v is not null")
def warp_nearest(spark, sf):
    return _warped(spark, sf, 10.0, "near")


@query(f"""with {fx.RASTER}, g as (select cast(a.range as integer) as r, cast(b.range as integer) as c, (a.range + 0.5::double) / 2 - 0.5 as y, (b.range + 0.5::double) / 2 - 0.5 as x from range(1000) a, range(128) b),
k as (select g.r, g.c, v, (1 - abs(x - t.c)) * (1 - abs(y - t.r)) as w from g, (select a.range as i, b.range as j from range(2) a, range(2) b), lateral (select floor(y) + i as rr, floor(x) + j as cc) join raster t on t.r = rr and t.c = cc where v is not null)
select r, c, round(sum(w * v) / sum(w), 8) as v from k where w <> 0 group by r, c""")
def warp_bilinear(spark, sf):
    return rnd(_warped(spark, sf, 15.0, "bilinear"), 8)


_KERNELS = {
    "cubic": (2, "case when {a} < 1 then 1.5 * {a} ** 3 - 2.5 * {a} ** 2 + 1 when {a} < 2 then -0.5 * {a} ** 3 + 2.5 * {a} ** 2 - 4 * {a} + 2 else 0 end"),
    "cubicspline": (2, "case when {a} < 1 then 2.0::double / 3 - {a} ** 2 + {a} ** 3 / 2 when {a} < 2 then (2 - {a}) ** 3 / 6 else 0 end"),
    "lanczos": (3, "case when {a} < 1e-12 then 1 when {a} < 3 then 3 * sin(pi() * {a}) * sin(pi() * {a} / 3) / (pi() ** 2 * {a} ** 2) else 0 end"),
}


def _kernel_warp(algorithm: str) -> str:
    """From cells of 30 to cells of 20; places whose weights nearly cancel have no steady value and are left out on both sides."""
    half, weight = _KERNELS[algorithm]
    at = lambda d: weight.format(a=f"abs({d})")
    return f"""with {fx.RASTER}, size as (select max(r) + 1 as n, max(c) + 1 as m from raster), rr as (select cast(unnest(range(cast(ceil(n * 1.5) as bigint))) as integer) as r from size), cc as (select cast(unnest(range(cast(ceil(m * 1.5) as bigint))) as integer) as c from size),
g as (select r, c, (r + 0.5::double) / 1.5::double - 0.5 as y, (c + 0.5::double) / 1.5::double - 0.5 as x from rr, cc), taps as (select unnest(range({1 - half}, {half + 1})) as o),
k as (select g.r, g.c, v, ({at('x - t.c')}) * ({at('y - t.r')}) as w from g, taps i, taps j, lateral (select floor(y) + i.o as qr, floor(x) + j.o as qc) join raster t on t.r = qr and t.c = qc where v is not null)
select r, c, round(sum(w * v) / sum(w), 6) as v from k group by r, c having abs(sum(w)) > 0.05 and count(*) = {4 * half * half}"""


def _inner(spark, sf, algorithm: str) -> DataFrame:
    """The warped cells all of whose source cells are valid."""
    half = _KERNELS[algorithm][0]
    got = _warped(spark, sf, 20.0, algorithm)
    # how many valid source cells each place has: windows of 2 * half cells from the one half - 1 before it
    first = lambda x: (F.floor((F.col(x) + 0.5) / 1.5 - 0.5) + 1 - half).cast("int")
    whole = neighbourhood.sliding(fx.raster(spark, sf).where("v is not null"), 2 * half, 2 * half, 1, F.count).select(F.col("r").alias("_r"), F.col("c").alias("_c"))
    return rnd(got.withColumns({"_r": first("r"), "_c": first("c")}).join(model.shuffled(whole), ["_r", "_c"]).select("r", "c", "v"), 6)


@query(_kernel_warp("cubic"))
def warp_cubic(spark, sf):
    return _inner(spark, sf, "cubic")


@query(_kernel_warp("cubicspline"))
def warp_cubicspline(spark, sf):
    return _inner(spark, sf, "cubicspline")


@query(_kernel_warp("lanczos"))
def warp_lanczos(spark, sf):
    return _inner(spark, sf, "lanczos")


@query(f"with {fx.RASTER}, t as (select cast(r // 4 as integer) as r, cast(c // 4 as integer) as c, round(v * 20) as v, count(*) as n from raster where v is not null group by all) select r, c, arg_min(v, (-n, v)) as v from t group by r, c")
def warp_mode(spark, sf):
    src = warp.Grid(*fx.raster_shape(spark, sf), tuple(fx.GT), "EPSG:32610")
    dst = warp.Grid(math.ceil(src.nrows / 4), math.ceil(src.ncols / 4), (src.gt[0], 120.0, 0.0, src.gt[3], 0.0, -120.0), src.srs)
    return warp.warp(fx.raster(spark, sf).withColumn("v", F.round(F.col("v") * 20)), src, dst, "mode")


@query("select 54.97227::double as km")
def known_distance(spark, sf):
    """Flinders Peak to Buninyong, the published line of the inverse problem."""
    one = spark.range(1).select(geo.distance_km(F.lit(144.42486788888888), F.lit(-37.951033417), F.lit(143.92649552777777), F.lit(-37.65282114)).alias("km"))
    return rnd(one, 5)


@query(f"with {fx.RASTER} select cast(r // 5 as integer) as r, cast(c // 5 as integer) as c, v from raster where r % 5 = 0 and c % 5 = 0")
def decimated_read(spark, sf):
    return model.decimate(fx.raster(spark, sf), 5)


@query(f"with {fx.RASTER} select r, c, coalesce(v, -9999) as v from raster")
def replace_nodata(spark, sf):
    r = fx.raster(spark, sf)
    return r.withColumn("v", model.fill_nodata(F.col("v"), -9999.0))


@query(f"with {fx.RASTER}, b as (select c, min(r) as top, max(r) as bottom from raster where abs(v) >= 0.3 group by c), e as (select 0 as side, c as o, c, top as r from b union all select 1, -c, c, bottom from b) select row_number() over (order by side, o) - 1 as idx, 500000 + (c + 0.5::double) * 30 as x, 5200000 - (r + 0.5::double) * 30 as y from e")
def outline(spark, sf):
    o = vector.outline(cellfilters.in_abs_range(fx.raster(spark, sf), 0.3, 9.0), fx.GT)
    return o.select(F.col("idx").cast("long").alias("idx"), "x", "y")
