"""Dates and time scales as Column functions on TIMESTAMP_NTZ (no time zone anywhere)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import shuffled

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
DAY = 86_400_000_000


def _ntz(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _ntz(c))


def from_micros(m: Column) -> Column:
    return F.timestamp_add("MICROSECOND", m.cast("long"), F.expr(_EPOCH)).cast("timestamp_ntz")


def ordinal(c: Column | str) -> Column:
    """Days since 0001-01-01 plus one, time of day as a fraction (1970-01-01 is 719163)."""
    return micros(c) / F.lit(float(DAY)) + F.lit(719163.0)


def from_ordinal(o: Column) -> Column:
    return from_micros(F.rint((o - 719163.0) * float(DAY)))


def decimal_year(c: Column | str) -> Column:
    ts = _ntz(c)
    year = F.year(ts)
    first, after = F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year + 1, F.lit(1), F.lit(1))
    return year + (micros(ts) - micros(first.cast("timestamp_ntz"))) / (F.date_diff(after, first) * float(DAY))


def from_decimal_year(d: Column) -> Column:
    year = F.floor(d).cast("int")
    first, after = F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year + 1, F.lit(1), F.lit(1))
    return from_micros(F.rint(micros(first.cast("timestamp_ntz")) + (d - year) * F.date_diff(after, first) * float(DAY)))


def julian_day(c: Column | str) -> Column:
    """Julian day number of the date at noon."""
    return F.date_diff(_ntz(c).cast("date"), F.make_date(F.lit(1970), F.lit(1), F.lit(1))).cast("long") + F.lit(2440588).cast("long")


def from_julian(jd: Column) -> Column:
    """Timestamp of a (fractional) Julian date."""
    return from_micros(F.rint((jd - 2440587.5) * float(DAY)))


def gps_to_timestamp(week: Column, ms: Column) -> Column:
    return F.timestamp_add("MILLISECOND", (week.cast("long") * 604_800_000 + ms.cast("long")), F.expr("timestamp_ntz'1980-01-06 00:00:00'")).cast("timestamp_ntz")


def matlab_day(c: Column | str) -> Column:
    return ordinal(c) + 366.0


def from_matlab_day(m: Column) -> Column:
    return from_ordinal(m - 366.0)


def day_of_year(c: Column | str) -> Column:
    return F.dayofyear(_ntz(c).cast("date"))


def from_day_of_year(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def seconds_since_epoch(c: Column | str) -> Column:
    return micros(c) / 1e6


def round_to_day(c: Column | str) -> Column:
    """Nearest midnight; noon goes up."""
    return from_micros(F.floor((micros(c) + DAY // 2) / F.lit(DAY)) * DAY)


def date_range(start: Column, stop: Column, step_days: int) -> Column:
    """Array of dates from start, before stop."""
    days = F.date_diff(stop, start)
    return F.when(days > 0, F.transform(F.sequence(F.lit(0), F.floor((days - 1) / step_days).cast("int")), lambda k: F.date_add(start, k * step_days))).otherwise(F.array().cast("array<date>"))


def stamp(c: Column | str) -> Column:
    return F.date_format(_ntz(c), "yyyyMMdd_HHmm")


def days(interval_seconds: Column) -> Column:
    return interval_seconds / 86400.0


def decimal_years(interval_seconds: Column) -> Column:
    return interval_seconds / (86400.0 * 365.25)


def years_between(a: Column, b: Column) -> Column:
    """|b - a| in years of 365.25 days; missing if equal."""
    d = F.abs(ordinal(b) - ordinal(a)) / 365.25
    return F.when(d != 0, d)


def solar_time_offset(lon: Column) -> Column:
    """Hours to add to UTC for mean local solar time."""
    return lon / 15.0


def local_time(c: Column, tz: Column) -> Column:
    return F.from_utc_timestamp(_ntz(c).cast("timestamp"), tz).cast("timestamp_ntz")


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def datetimes_in_name(fn: Column) -> Column:
    """Array of the dates in a file's base name, without its extension: all stamps of the first kind that occurs.

    Kinds, in order: date and clock (``20180101_1200``, ``20180101T1200``), the
    same without a separator, a date, a decimal year, a year (which means January
    1st), and ``03jul67`` in lower case.  All but the last must follow the start,
    ``_`` or ``-``; a date, decimal year or year must also end the name or be
    followed by one of these.  So catalogue numbers are not taken for dates.
    """
    base = F.regexp_replace(F.element_at(F.split(fn, "/"), -1), r"^(\.*[^.].*)\.[^.]*$", "$1")
    date = r"(?:19|20)\d\d(?:0[1-9]|1[012])(?:0[1-9]|[12]\d|3[01])"
    clock = r"(?:[01]\d|2[0-3])[0-5]\d"
    begin, end = "(?:^|_|-)", "(?:$|_|-)"

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(base, F.lit(pattern), F.lit(0))

    def stamps(pattern: str, suffix: str) -> tuple[Column, Callable[[Column], Column]]:
        return found(pattern), lambda x: F.try_to_timestamp(F.concat(F.regexp_replace(x, r"\D", ""), F.lit(suffix)), F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")

    def worded(x: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.substring(x, 3, 3))
        two = F.substring(x, 6, 2)
        century = F.when(two <= "68", F.lit("20")).otherwise(F.lit("19"))
        return F.when(month > 0, F.try_to_timestamp(F.concat(century, two, F.lpad(month.cast("string"), 2, "0"), F.substring(x, 1, 2)), F.lit("yyyyMMdd")).cast("timestamp_ntz"))

    kinds = [
        stamps(f"{begin}{date}[_T]{clock}", ""),
        stamps(f"{begin}{date}{clock}", ""),
        stamps(f"{begin}{date}{end}", "0000"),
        (found(f"{begin}(?:19|20)\\d\\d\\.\\d\\d+{end}"), lambda x: from_decimal_year(F.regexp_replace(x, "[_-]", "").cast("double"))),
        stamps(f"{begin}(?:19|20)\\d\\d{end}", "01010000"),
        (found(r"[0-3]\d[a-z]{3}\d\d"), worded),
    ]
    out = F.array().cast("array<timestamp_ntz>")
    for texts, read in reversed(kinds):
        out = F.when(F.size(texts) > 0, F.transform(texts, read)).otherwise(out)
    return out


def datetime_in_name(fn: Column) -> Column:
    """The first of :func:`datetimes_in_name`, or NULL."""
    return F.try_element_at(datetimes_in_name(fn), F.lit(1))


# --- tables of dates --------------------------------------------------------


def nearest(queries: DataFrame, candidates: DataFrame, q: str = "ts", c: str = "cts", value: str = "idx", bucket_days: int | None = None) -> DataFrame:
    """For each query row the candidate nearest in time; ties to the smaller ``value``.

    An as-of union: candidates and queries are sorted by time together, and the
    last candidate before and the first after are carried over, so the work is
    one shuffle rather than a cross join.  A query's row travels as a struct.
    ``bucket_days`` splits the sort into independent ranges; each also gets the
    last candidate before it and the first after it.  Queries without a time, or
    of an empty table of candidates, have a NULL ``value``.
    """
    cand = candidates.where(F.col(c).isNotNull()).select(F.col(c).alias("_t"), F.col(value).alias("_v")).groupBy("_t").agg(F.min("_v").alias("_v"))
    kind = cand.schema["_v"].dataType
    row = F.struct(*[F.col(f"`{n}`") for n in queries.columns]).alias("_row")
    asked = queries.select(F.col(q).alias("_t"), row)
    rows = asked.select("_t", "_row", F.lit(None).cast(kind).alias("_v")).unionByName(cand.select("_t", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), "_v"))
    size = (bucket_days or 3650) * DAY
    rows = rows.withColumn("_m", micros(F.col("_t"))).withColumn("_b", F.floor(F.col("_m") / size))
    mine = F.when(F.col("_row").isNull(), F.struct("_m", "_v"))
    # the extreme candidates of each range, carried to the ranges around it: one row for each range
    edge = cand.withColumn("_m", micros(F.col("_t"))).groupBy(F.floor(F.col("_m") / size).alias("_b")).agg(F.min(F.struct("_m", "_v")).alias("_lo"), F.max(F.struct("_m", "_v")).alias("_hi"))
    ranges = asked.select(F.floor(micros(F.col("_t")) / size).alias("_b")).where("_b is not null").distinct().unionByName(edge.select("_b")).distinct()
    order = Window.orderBy("_b")
    spans = ranges.join(edge, "_b", "left").select("_b", F.last("_hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_lo", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    forward = Window.partitionBy("_b").orderBy("_m", F.col("_row").isNotNull())
    back = Window.partitionBy("_b").orderBy(F.desc("_m"), F.col("_row").isNotNull())
    seen = rows.withColumn("_p", F.last(mine, True).over(forward)).withColumn("_n", F.last(mine, True).over(back)).where("_row is not null").join(spans, "_b", "left")
    p, n = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    gap = lambda s: F.abs(F.col("_m") - s["_m"])
    best = F.when(n.isNull() | (gap(p) < gap(n)) | ((gap(p) == gap(n)) & (p["_v"] <= n["_v"])), p["_v"]).otherwise(n["_v"])
    return seen.select("_row.*", F.coalesce(best, p["_v"], n["_v"]).alias(value))


def within(queries: DataFrame, candidates: DataFrame, pad_days: float, q: str = "ts", c: str = "cts") -> DataFrame:
    """Pairs closer in time than ``pad_days`` (strictly); equi-joined on time buckets.

    The rows out are as many as there are such pairs, so they grow with the square
    of how dense the times are.  Memory does not: buckets are merged, not broadcast,
    and a pair costs a difference of two numbers that each row has once.
    """
    pad = int(pad_days * DAY)
    bucket = lambda m: F.floor(F.col(m) / pad)
    a = queries.withColumn("_m", micros(F.col(q))).withColumn("_b", bucket("_m")).withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    b = candidates.withColumn("_n", micros(F.col(c))).withColumn("_b", bucket("_n"))
    return shuffled(a).join(shuffled(b), "_b").where(F.abs(F.col("_m") - F.col("_n")) < pad).drop("_b", "_m", "_n")


def clusters(times: DataFrame, ts: str = "ts", gap_days: float = 16.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs of times with no gap over ``gap_days``: number, first, last, count; by series."""
    w = Window.partitionBy(*keys).orderBy(ts)
    new = F.coalesce((micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w) > int(gap_days * DAY)).cast("int"), F.lit(0))
    numbered = times.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "cluster").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))


def fix_repeated(times: DataFrame, ts: str = "ts", order: str = "idx", step_us: int = 1000, keys: tuple[str, ...] = ()) -> DataFrame:
    """Strictly increasing times: t[i] becomes the larger of itself and its predecessor plus one step."""
    w = Window.partitionBy(*keys).orderBy(ts, order)
    k = (F.row_number().over(w) - 1) * step_us
    run = F.max(micros(F.col(ts)) - k).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return times.withColumn("fixed", from_micros(run + k))


def seasonal(times: DataFrame, start: tuple[int, int], end: tuple[int, int], ts: str = "ts") -> DataFrame:
    """Rows in the yearly window from (month, day) to (month, day), inclusive, over New Year if end is before start."""
    md = F.month(ts) * 100 + F.dayofmonth(ts)
    a, b = start[0] * 100 + start[1], end[0] * 100 + end[1]
    return times.where(md.between(a, b) if a <= b else (md >= a) | (md <= b))


def annual_bounds(times: DataFrame, start: tuple[int, int], end: tuple[int, int], ts: str = "ts") -> DataFrame:
    """``b0, b1`` of each year's window that touches the data."""
    years = times.agg(F.min(F.year(ts)).alias("a"), F.max(F.year(ts)).alias("b")).select(F.explode(F.sequence(F.col("a") - 1, "b")).alias("y"))
    next_ = 1 if end <= start else 0
    return years.select(F.make_date("y", F.lit(start[0]), F.lit(start[1])).alias("b0"), F.make_date(F.col("y") + next_, F.lit(end[0]), F.lit(end[1])).alias("b1"))


def in_bounds(times: DataFrame, bounds: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows with b0 <= ts < b1; bounds (one row a year) are joined on the year."""
    b = bounds.withColumn("_y", F.explode(F.sequence(F.year("b0"), F.year("b1"))))
    t = times.withColumn("_y", F.year(ts))
    return t.join(b, "_y").where((F.col(ts) >= F.col("b0")) & (F.col(ts) < F.col("b1"))).drop("_y")


def date_summary(times: DataFrame, ts: str = "ts") -> DataFrame:
    """Mean, middle and median date and the span in days."""
    from gridloom.operators.stats import percentiles

    m = micros(F.col(ts))
    rest = times.agg(from_micros(F.rint(F.avg(m))).alias("mean_date"), from_micros(F.rint((F.min(m) + F.max(m)) / 2)).alias("mid_date"), ((F.max(m) - F.min(m)) / float(DAY)).alias("span_days"))
    middle = percentiles(times.select(m.alias("v")), (50,)).select(from_micros(F.rint(F.col("p")[0])).alias("median_date"))
    return rest.crossJoin(middle).select("mean_date", "mid_date", "median_date", "span_days")


def first_of_day(times: DataFrame, ts: str = "ts", idx: str = "idx") -> DataFrame:
    return times.groupBy(F.to_date(ts).alias("day")).agg(F.min(idx).alias(idx))


def date_raster(cells: DataFrame, date: Column, reference: Column | None = None) -> DataFrame:
    """Valid cells with their raster's date in place of the value: the ordinal, or days since ``reference``."""
    value = ordinal(date) if reference is None else ordinal(date) - ordinal(reference)
    return cells.withColumn("v", F.when(F.col("v").isNotNull(), value))
