"""Rasters, stacks and tables on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def write_cells(cells: DataFrame, path: str, keys: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Parquet, partitioned by raster or layer and sorted by row and column so that row groups can be skipped."""
    out = cells.sortWithinPartitions(*keys, "r", "c").write.mode(mode)
    (out.partitionBy(*keys) if keys else out).parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_stack(cells: DataFrame, layers: DataFrame, path: str, products: dict[str, DataFrame] | None = None, mode: str = "overwrite") -> None:
    """Cells, layers and product tables, one folder each."""
    write_cells(cells, f"{path}/cells", ("layer",), mode)
    layers.write.mode(mode).parquet(f"{path}/layers")
    for name, df in (products or {}).items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_stack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, layers and statistics, which are computed where they were not saved."""
    from gridloom.operators.stack import stack_stats

    cells, layers = spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/layers")
    stats = spark.read.parquet(f"{path}/stats") if _exists(spark, f"{path}/stats") else stack_stats(cells)
    return cells, layers, stats


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there, on any Hadoop file system."""
    return [p for p in paths if _exists(spark, p)]


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, length, modificationTime`` of files, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def read_csv(spark: SparkSession, path: str, header: bool = True, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", header)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def features_to_dicts(features: DataFrame) -> DataFrame:
    """One map of field name to text per feature; fields whose names hold "date" are parsed to timestamps first."""
    from gridloom.functions.timefns import datetime_in_name

    cols = [datetime_in_name(F.col(c).cast("string")).cast("string").alias(c) if "date" in c.lower() else F.col(c).cast("string").alias(c) for c in features.columns]
    return features.select(F.create_map(*[x for c, v in zip(features.columns, cols) for x in (F.lit(c), v)]).alias("fields"))


class LatticeSource(DataSource):
    """``spark.read.format("lattice")``: empty grids of ``nrows`` by ``ncols``, a partition for each band of rows."""

    @classmethod
    def name(cls) -> str:
        return "lattice"

    def schema(self) -> str:
        return "r int, c int, v double"

    def reader(self, schema) -> DataSourceReader:
        return _LatticeReader(self.options)


class _LatticeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.nrows, self.ncols = int(options.get("nrows", 1)), int(options.get("ncols", 1))

    def partitions(self):
        step = max(1, 1_000_000 // max(1, self.ncols))
        return [InputPartition((a, min(a + step, self.nrows))) for a in range(0, self.nrows, step)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        a, b = partition.value
        step = max(1, 100_000 // max(1, self.ncols))
        for r in range(a, b, step):
            rows = np.arange(r, min(b, r + step), dtype=np.int32)
            n = len(rows) * self.ncols
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, self.ncols)), pa.array(np.tile(np.arange(self.ncols, dtype=np.int32), len(rows))), pa.nulls(n, pa.float64())], names=["r", "c", "v"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LatticeSource)
