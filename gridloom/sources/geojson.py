"""GeoJSON features to vertex tables and back, with Spark's own JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURE = "struct<type string, properties map<string,string>, geometry struct<type string, coordinates string>>"
_PART = "array<array<array<double>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``fid, kind, properties, ring, idx, x, y`` of feature collections (a file each) or of one feature a line.

    ``fid`` numbers features over all files, ``ring`` the rings or lines of a
    feature from 0; a closing vertex that repeats the first one of a ring is
    left out.  A feature without a geometry has no row.
    """
    text = spark.read.text(path, wholetext=True).select("value", F.monotonically_increasing_id().alias("file"))
    whole = F.col("value").rlike(r'(?s)^\s*\{.*"type"\s*:\s*"FeatureCollection"')
    parsed = F.from_json("value", f"struct<features array<{_FEATURE}>>")["features"]
    lines = F.transform(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, _FEATURE))
    found = text.select("file", F.posexplode(F.when(whole, parsed).otherwise(lines)).alias("at", "f"))
    c, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    parts = (
        F.when(kind.isin("Polygon", "MultiLineString"), F.from_json(c, _PART))
        .when(kind == "MultiPolygon", F.flatten(F.from_json(c, f"array<{_PART}>")))
        .when(kind.isin("LineString", "MultiPoint"), F.array(F.from_json(c, "array<array<double>>")))
        .when(kind == "Point", F.array(F.array(F.from_json(c, "array<double>"))))
    )
    rows = found.select((F.col("file") * F.lit(1 << 20) + F.col("at")).alias("fid"), kind.alias("kind"), F.col("f.properties").alias("properties"), F.posexplode(parts).alias("ring", "p"))
    open_ = lambda p: F.when(F.col("kind").contains("Polygon") & (F.size(p) > 1) & (F.element_at(p, 1) == F.element_at(p, -1)), F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return rows.select("fid", "kind", "properties", "ring", F.posexplode(open_(F.col("p"))).alias("idx", "v")).select("fid", "kind", "properties", "ring", "idx", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


def to_geojson(vertices: DataFrame, kind: str = "Polygon", properties: list[str] | None = None) -> DataFrame:
    """``value``: one feature a line from ``fid, ring, idx, x, y``; Polygon, MultiLineString, LineString or Point."""
    names = list(properties or [])
    v = F.struct("idx", F.array("x", "y").alias("p"))
    rings = vertices.groupBy("fid", "ring").agg(F.transform(F.array_sort(F.collect_list(v)), lambda s: s["p"]).alias("p"), *[F.first(n).alias(n) for n in names])
    if kind == "Polygon":
        rings = rings.withColumn("p", F.concat("p", F.slice("p", 1, 1)))
    own = rings.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "p"))), lambda s: s["p"]).alias("p"), *[F.first(n).alias(n) for n in names])
    shape = {"Polygon": F.col("p"), "MultiLineString": F.col("p"), "LineString": F.col("p")[0], "Point": F.col("p")[0][0]}[kind]
    fields = F.struct(*[F.col(n) for n in names]) if names else F.create_map().cast("map<string,string>")
    return own.select(F.to_json(F.struct(F.lit("Feature").alias("type"), fields.alias("properties"), F.struct(F.lit(kind).alias("type"), shape.alias("coordinates")).alias("geometry"))).alias("value"))


def write_geojson(vertices: DataFrame, path: str, kind: str = "Polygon", properties: list[str] | None = None) -> None:
    """A folder of files with one feature a line, written by all tasks."""
    to_geojson(vertices, kind, properties).write.text(path)
