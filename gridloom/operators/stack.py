"""Stacks of co-registered rasters in time: ``layer, r, c, v`` and a layer table ``layer, fn, dt``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.timefns import ordinal
from gridloom.operators.stats import NMAD, percentiles

CELL = ["r", "c"]


def layer_table(files: DataFrame, fn: str = "fn", dt: Column | None = None) -> DataFrame:
    """Layers numbered by date, then base name; a single global sort over a small table."""
    named = files.withColumn("_base", F.element_at(F.split(F.col(fn), "/"), -1)).withColumn("dt", dt if dt is not None else F.col("dt"))
    return named.withColumn("layer", F.row_number().over(Window.orderBy(F.col("dt").asc_nulls_last(), "_base")).cast("int")).drop("_base")


def stack_stats(cells: DataFrame, robust: bool = False) -> DataFrame:
    """Per cell: n, mean, std (missing for one value), vmin, vmax, and with ``robust`` med and nmad."""
    v = cells.where("v is not null")
    aggs = [F.count("v").alias("n"), F.avg("v").alias("mean"), F.when(F.count("v") > 1, F.stddev_pop("v")).alias("std"), F.min("v").alias("vmin"), F.max("v").alias("vmax")]
    if not robust:
        return v.groupBy(*CELL).agg(*aggs)
    # one shuffle: the values of a cell are one array of at most as many entries as there are layers
    vs = F.array_sort(F.collect_list("v"))
    got = v.groupBy(*CELL).agg(*aggs, vs.alias("_vs"))
    med = _array_median(F.col("_vs"))
    got = got.withColumn("med", med)
    dev = F.array_sort(F.transform("_vs", lambda x: F.abs(x - F.col("med"))))
    return got.withColumn("nmad", _array_median(dev) * NMAD).drop("_vs")


def _array_median(a: Column) -> Column:
    """Median of a sorted, non-empty array."""
    n = F.size(a)
    low = F.element_at(a, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(a, F.floor((n + 2) / 2).cast("int"))
    return (low + high) / 2


def date_stats(cells: DataFrame, layers: DataFrame) -> DataFrame:
    """Per cell: first and last date, span in days (missing if zero) and centre date (ordinals)."""
    d = cells.where("v is not null").join(layers.where("dt is not null").select("layer", ordinal(F.col("dt")).alias("o")), "layer")
    lo, hi = F.min("o"), F.max("o")
    return d.groupBy(*CELL).agg(lo.alias("dt_min"), hi.alias("dt_max"), F.nullif(hi - lo, F.lit(0.0)).alias("dt_ptp"), (lo + F.coalesce(F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)) / 2).alias("dt_center"))


def default_min_span(date_stats_: DataFrame, factor: float = 0.20) -> DataFrame:
    """``min_span``: a share of the 96th percentile of the cells' date spans."""
    return percentiles(date_stats_.select(F.col("dt_ptp").alias("v")), (96,)).select((F.col("p")[0] * factor).alias("min_span"))


def _observed(cells: DataFrame, layers: DataFrame, *aggs: Column) -> DataFrame:
    """Per cell ``p``: an array of (t, v) by time, of dated layers; and other aggregates of all values in the same shuffle."""
    dated = cells.where("v is not null").join(layers.select("layer", ordinal(F.col("dt")).alias("o")), "layer", "left")
    pairs = F.array_sort(F.collect_list(F.when(F.col("o").isNotNull(), F.struct(F.col("o").alias("t"), "v"))))
    return dated.groupBy(*CELL).agg(pairs.alias("p"), *aggs)


def _fitted(df: DataFrame) -> DataFrame:
    """The line through ``p`` by least squares: ``t0, _n, _mt, _mv, _sxx, _sxy, _syy, _b, _res, _nmad``."""
    t = lambda s: s["t"] - F.col("t0")
    add = lambda f: F.aggregate("p", F.lit(0.0), lambda a, s: a + f(s))
    df = df.withColumn("t0", F.get("p", F.lit(0))["t"])
    df = df.withColumns({"_n": F.size("p").cast("double"), "_st": add(t), "_sv": add(lambda s: s["v"])})
    df = df.withColumns({"_mt": F.col("_st") / F.nullif("_n", F.lit(0.0)), "_mv": F.col("_sv") / F.nullif("_n", F.lit(0.0))})
    df = df.withColumns({"_sxx": add(lambda s: (t(s) - F.col("_mt")) ** 2), "_sxy": add(lambda s: (t(s) - F.col("_mt")) * (s["v"] - F.col("_mv"))), "_syy": add(lambda s: (s["v"] - F.col("_mv")) ** 2)})
    df = df.withColumn("_b", F.col("_sxy") / F.nullif(F.col("_sxx"), F.lit(0.0)))
    df = df.withColumn("_res", F.transform("p", lambda s: s["v"] - F.col("_mv") - F.col("_b") * (t(s) - F.col("_mt"))))
    df = df.withColumn("_med", _array_median(F.array_sort("_res")))
    return df.withColumn("_nmad", _array_median(F.array_sort(F.transform("_res", lambda x: F.abs(x - F.col("_med"))))) * NMAD)


def _enough(min_n: int, min_span: float | None) -> Column:
    ok = (F.size("p") >= min_n) & (F.size("p") >= 2)
    if min_span is not None:
        ok = ok & (F.try_element_at("p", F.lit(-1))["t"] - F.get("p", F.lit(0))["t"] >= min_span)
    return ok


def _line() -> list[Column]:
    slope = F.col("_b") * 365.25
    intercept = F.col("_mv") - F.col("_b") * (F.col("_mt") + F.col("t0"))
    r2 = F.col("_sxy") * F.col("_sxy") / F.nullif(F.col("_sxx") * F.col("_syy"), F.lit(0.0))
    return [slope.alias("slope"), intercept.alias("intercept"), F.col("_nmad").alias("detrended_std"), r2.alias("rsq")]


def _without_outliers(obs: DataFrame, min_n: int, min_span: float | None, rounds: int = 2, factor: float = 3.0) -> DataFrame:
    """``p`` without values that lie ``factor`` NMAD or more from the line, in each round; cells without a line go."""

    def kept(t: np.ndarray, v: np.ndarray) -> np.ndarray | None:
        own = np.arange(len(t))
        for _ in range(rounds):
            x, y = t[own], v[own]
            if len(own) < min_n or (min_span is not None and x[-1] - x[0] < min_span) or x[0] == x[-1]:
                return None
            x = x - x[0]
            x, y = x - x.mean(), y - y.mean()
            res = y - (x @ y) / (x @ x) * x
            nmad = np.median(np.abs(res - np.median(res))) * NMAD
            if nmad > 1e-9 * np.abs(v[own]).max():  # else the middle residuals are the same but for rounding
                own = own[np.abs(res) < factor * nmad]
        return own

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(batch.num_columns - 1)
            ends, flat = p.offsets.to_numpy(), p.values
            t, v = flat.field("t").to_numpy(), flat.field("v").to_numpy()
            rows, take, sizes = [], [], [0]
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                own = kept(t[a:b], v[a:b]) if b > a else None
                if own is not None:
                    rows.append(i)
                    take.append(a + own)
                    sizes.append(len(own))
            values = flat.take(pa.array(np.concatenate(take) if take else np.empty(0, np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]), lists], names=batch.schema.names)

    return obs.mapInArrow(each, obs.schema)


def trend(cells: DataFrame, layers: DataFrame, min_n: int = 2, min_span: float | None = None, remove_outliers: bool = False) -> DataFrame:
    """Per cell: n, slope per year of 365.25 days, intercept at ordinal zero, NMAD of residuals, R squared.

    All layers of a cell meet in one shuffle, as an array of at most as many
    entries as there are layers.  ``remove_outliers`` drops |residual| >= 3 NMAD
    and fits again, twice, inside that array (Arrow batches of arrays in NumPy:
    as nested expressions the rounds would grow the plan beyond use).
    """
    obs = _observed(cells, layers)
    if remove_outliers:
        obs = _without_outliers(obs.select(*CELL, "p"), max(2, min_n), min_span)
    fit = _fitted(obs.where(_enough(min_n, min_span)))
    return fit.where("_b is not null").select(*CELL, F.size("p").cast("long").alias("n"), *_line())


def stats_and_trend(cells: DataFrame, layers: DataFrame, min_n: int = 2) -> DataFrame:
    """Statistics and trend of each cell from one shuffle; cells without a trend have none of its columns set."""
    v = F.col("v")
    obs = _observed(cells, layers, F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.count(v) > 1, F.stddev_pop(v)).alias("std"), F.min(v).alias("vmin"), F.max(v).alias("vmax"))
    fit = _fitted(obs.withColumn("p", F.when(_enough(min_n, None), F.col("p"))))
    return fit.select(*CELL, "n", "mean", "std", "vmin", "vmax", *_line())


def theil_sen(cells: DataFrame, layers: DataFrame) -> DataFrame:
    """Per cell: median of pairwise slopes (per year) and median intercept; pairs stay inside a cell's array."""
    obs = cells.where("v is not null").join(layers.where("dt is not null").select("layer", ordinal(F.col("dt")).alias("o")), "layer").groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct(F.col("o").alias("t"), "v"))).alias("p"))
    slopes = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b["t"] > a["t"]), lambda b: (b["v"] - a["v"]) / (b["t"] - a["t"]))))
    got = obs.withColumn("_s", F.array_sort(slopes)).where(F.size("_s") > 0).withColumn("_b", _array_median(F.col("_s")))
    left = F.array_sort(F.transform("p", lambda a: a["v"] - F.col("_b") * a["t"]))
    return got.select(*CELL, F.size("p").cast("long").alias("n"), (F.col("_b") * 365.25).alias("slope"), _array_median(left).alias("intercept"))


def ransac(cells: DataFrame, layers: DataFrame, min_n: int = 3, trials: int = 200, seed: int = 0) -> DataFrame:
    """Per cell: n, slope per year and intercept of the line that most values agree with, and how many do.

    Lines through pairs of values are tried: all pairs where there are no more
    than ``trials``, else as many drawn with a fixed seed.  A value agrees within
    the median absolute deviation of the cell's values; of lines with equally many,
    that with the least sum of residuals counts.  The line is then fitted to those
    that agree.  Cells with fewer than ``min_n`` values or one date only have no row.
    """

    def line(t: np.ndarray, v: np.ndarray) -> tuple[float, float, int] | None:
        if len(t) < min_n or t[0] == t[-1]:
            return None
        i, j = np.triu_indices(len(t), 1)
        if len(i) > trials:
            some = np.random.default_rng(seed).choice(len(i), trials, replace=False)
            i, j = i[some], j[some]
        i, j = i[t[i] != t[j]], j[t[i] != t[j]]
        if not len(i):
            return None
        x = t - t[0]
        b = (v[j] - v[i]) / (x[j] - x[i])
        off = np.abs(v[None, :] - v[i][:, None] - b[:, None] * (x[None, :] - x[i][:, None]))
        near = off <= np.median(np.abs(v - np.median(v))) + 1e-9 * np.abs(v).max()
        best = np.lexsort((np.where(near, off, 0).sum(axis=1), -near.sum(axis=1)))[0]
        own = near[best]
        xo, vo = x[own] - x[own].mean(), v[own] - v[own].mean()
        if not (xo @ xo):
            return None
        slope = (xo @ vo) / (xo @ xo)
        return slope * 365.25, v[own].mean() - slope * (x[own].mean() + t[0]), int(own.sum())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2)
            ends, t, v = p.offsets.to_numpy(), p.values.field("t").to_numpy(), p.values.field("v").to_numpy()
            found = [(k, b - a, line(t[a:b], v[a:b])) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
            kept = [(k, n, *x) for k, n, x in found if x is not None]
            at = pa.array([k for k, *_ in kept], pa.int64())
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([x[c + 1] for x in kept], kind) for c, kind in enumerate(kinds))], names=[*CELL, "n", "slope", "intercept", "agree"])

    obs = _observed(cells, layers).select(*CELL, "p")
    kinds = [obs.schema[c].dataType.simpleString() for c in CELL]
    return obs.mapInArrow(each, f"r {kinds[0]}, c {kinds[1]}, n long, slope double, intercept double, agree long")


#: Two-sided 95 % points of Student's t by degrees of freedom.
T95 = [12.7062, 4.30265, 3.18245, 2.77645, 2.57058, 2.44691, 2.36462, 2.30600, 2.26216, 2.22814, 2.20099, 2.17881, 2.16037, 2.14479, 2.13145, 2.11991, 2.10982, 2.10092, 2.09302, 2.08596, 2.07961, 2.07387, 2.06866, 2.06390, 2.05954, 2.05553, 2.05183, 2.04841, 2.04523, 2.04227]


def t_limit(df: Column) -> Column:
    """The two-sided 95 % point: a table up to 30 degrees of freedom, beyond it the expansion about the normal quantile (within 1e-5)."""
    z = 1.959963984540054
    more = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    far = F.lit(z)
    for k, a in enumerate(more, 1):
        far = far + a / F.pow(df, F.lit(float(k)))
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, T95)), F.when(df >= 1, df.cast("int")).otherwise(F.lit(1))), far)


def significant(trends: DataFrame) -> DataFrame:
    """Trends whose slope differs from zero at the 95 % level."""
    df = F.col("n") - 2
    t = F.sqrt(F.col("rsq") * df / F.nullif(1 - F.col("rsq"), F.lit(0.0)))
    return trends.where((df > 0) & (F.coalesce(t, F.lit(float("inf"))) > t_limit(df)))


def subset(cells: DataFrame, layers: list[int]) -> DataFrame:
    return cells.where(F.col("layer").isin(*layers))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two stacks on one grid; b's layers come after a's."""
    shift = a.agg(F.max("layer").alias("_m"))
    return a.unionByName(b.crossJoin(F.broadcast(shift)).withColumn("layer", F.col("layer") + F.col("_m")).drop("_m").select(*a.columns))


def drop_empty_layers(cells: DataFrame) -> DataFrame:
    return cells.join(cells.where("v is not null").select("layer").distinct(), "layer", "left_semi")


def mosaic(cells: DataFrame, how: str = "mean", order: str = "layer") -> DataFrame:
    """Per cell over overlapping rasters: mean, min, max, median, first, last or count."""
    v = cells.where("v is not null")
    agg = {"mean": F.avg("v"), "min": F.min("v"), "max": F.max("v"), "median": F.median("v"), "first": F.min_by("v", order), "last": F.max_by("v", order), "count": F.count("v")}[how]
    return v.groupBy(*CELL).agg(agg.alias("v"))
