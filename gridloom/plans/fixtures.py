"""Rasters, stacks, points, series and features derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GT = [500000.0, 30.0, 0.0, 5200000.0, 0.0, -30.0]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raster(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("r"), F.posexplode("embedding").alias("c", "x"))
    x = F.col("x").cast("double")
    return e.select("r", F.col("c").cast("int").alias("c"), F.when(F.abs(x) >= 0.005, x).alias("v"))


def raster_shape(spark: SparkSession, sf: str) -> tuple[int, int]:
    """Rows and columns of :func:`raster`, from the table."""
    row = table(spark, sf, "embeddings").agg(F.max("vec_id").alias("r"), F.max(F.size("embedding")).alias("n")).first()
    return (int(row.r) + 1, int(row.n)) if row.r is not None else (0, 0)


RASTER = "raster as (select r, c, case when abs(x) >= 0.005 then x end as v from (select cast(vec_id as integer) as r, cast(generate_subscripts(embedding, 1) - 1 as integer) as c, cast(unnest(embedding) as double) as x from embeddings))"


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_partkey") + 0.5).cast("double").alias("x"), (F.col("l_suppkey") + 0.5).cast("double").alias("y"), F.col("l_extendedprice").alias("z"))


def limits(points: DataFrame, dx: float, dy: float, x1: float, y1: float) -> tuple[float, float, float, float]:
    """0 to x1 by 0 to y1, extended by whole cells of dx by dy until every point is inside: x0, x1, y0, y1."""
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    low = lambda v, d: min(0.0, math.floor(v / d) * d) if v is not None else 0.0
    high = lambda v, d, least: max(least, math.ceil(v / d) * d) if v is not None else least
    return low(b.x0, dx), high(b.x1, dx, x1), low(b.y0, dy), high(b.y1, dy, y1)


def frame(points: DataFrame, res: float, x1: float, y1: float) -> tuple[float, float, float, int, int]:
    """Left, top, cell size, rows and columns of a north-up grid over :func:`limits`; points on its open edges get a cell more."""
    left, right, bottom, top = limits(points, res, res, x1, y1)
    edge = points.agg(F.max(F.col("x") == right).alias("x"), F.max(F.col("y") == bottom).alias("y")).first()
    return left, top, res, round((top - bottom) / res) + bool(edge.y), round((right - left) / res) + bool(edge.x)


POINTS = "points as (select cast(l_partkey as double) + 0.5 as x, cast(l_suppkey as double) + 0.5 as y, l_extendedprice as z from lineitem)"


def stack(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_quantity <= 25")
    return li.groupBy(F.year("l_shipdate").cast("int").alias("layer"), (F.col("l_suppkey") % 32).cast("int").alias("r"), (F.col("l_partkey") % 32).cast("int").alias("c")).agg(F.avg("l_extendedprice").alias("v"))


STACK = "stack as (select cast(year(l_shipdate) as integer) as layer, cast(l_suppkey % 32 as integer) as r, cast(l_partkey % 32 as integer) as c, avg(l_extendedprice) as v from lineitem where l_quantity <= 25 group by 1, 2, 3)"


def layers(spark: SparkSession, sf: str) -> DataFrame:
    years = table(spark, sf, "lineitem").select(F.year("l_shipdate").cast("int").alias("layer")).distinct()
    return years.select("layer", F.make_date("layer", F.lit(7), F.lit(1)).cast("timestamp_ntz").alias("dt"))


#: Ordinal of a layer's date.
ORD = "(epoch_ms(make_timestamp(layer, 7, 1, 0, 0, 0.0)) / 86400000.0 + 719163.0)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def series(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("val"))


SERIES = "series as (select date_trunc('hour', ts) as ts, avg(value) as val from events group by 1)"


def footprints(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    x, y = F.col("n_nationkey") * 10.0, F.col("n_regionkey") * 5.0
    return n.select(F.col("n_nationkey").cast("int").alias("fid"), F.col("n_regionkey").cast("int").alias("region"), x.alias("xmin"), y.alias("ymin"), (x + 12.0).alias("xmax"), (y + 6.0).alias("ymax"))


FOOT = "foot as (select cast(n_nationkey as integer) as fid, cast(n_regionkey as integer) as region, n_nationkey * 10.0::double as xmin, n_regionkey * 5.0::double as ymin, n_nationkey * 10.0::double + 12 as xmax, n_regionkey * 5.0::double + 6 as ymax from nation)"


def lonlat(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * F.lit(0.24) - 180.0).alias("lon"), (F.col("c_custkey") % 181 - 90).cast("double").alias("lat"))


LONLAT = "lonlat as (select c_custkey as id, c_custkey * 0.24::double - 180.0::double as lon, cast(c_custkey % 181 - 90 as double) as lat from customer)"


def names(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", F.concat(F.date_format("ts", "yyyyMMdd_HHmm"), F.lit("_"), F.col("event_id").cast("string"), F.lit("-DEM.tif")).alias("fn"))
