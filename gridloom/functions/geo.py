"""Geotransforms, extents, coordinates and projections as Column expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- geotransform: [x0, dx, rx, y0, ry, dy] -----------------------------------


def apply_gt(gt: list[float] | Column, px: Column, py: Column) -> tuple[Column, Column]:
    g = [gt[i] if isinstance(gt, Column) else F.lit(float(gt[i])) for i in range(6)]
    return g[0] + px * g[1] + py * g[2], g[3] + px * g[4] + py * g[5]


def invert_gt(gt: list[float]) -> list[float] | None:
    det = gt[1] * gt[5] - gt[2] * gt[4]
    if abs(det) < 1e-15:
        return None
    a, b, d, e = gt[5] / det, -gt[2] / det, -gt[4] / det, gt[1] / det
    return [-(gt[0] * a + gt[3] * b), a, b, -(gt[0] * d + gt[3] * e), d, e]


def pixel_to_map(gt: list[float] | Column, px: Column, py: Column) -> tuple[Column, Column]:
    """Centre of a cell."""
    return apply_gt(gt, px + 0.5, py + 0.5)


def map_to_pixel(gt: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """Fractional cell; whole numbers are centres."""
    inv = invert_gt(gt)
    if inv is None:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    px, py = apply_gt(inv, x, y)
    return px - 0.5, py - 0.5


def gt_extent(gt: Column, nrows: Column, ncols: Column) -> Column:
    """Struct xmin, ymin, xmax, ymax of a grid (corner to corner)."""
    xs = [apply_gt(gt, px, py)[0] for px in (F.lit(0.0), ncols) for py in (F.lit(0.0), nrows)]
    ys = [apply_gt(gt, px, py)[1] for px in (F.lit(0.0), ncols) for py in (F.lit(0.0), nrows)]
    return F.struct(F.least(*xs).alias("xmin"), F.least(*ys).alias("ymin"), F.greatest(*xs).alias("xmax"), F.greatest(*ys).alias("ymax"))


def resolution(gt: Column) -> tuple[Column, Column]:
    return F.sqrt(gt[1] ** 2 + gt[4] ** 2), F.sqrt(gt[2] ** 2 + gt[5] ** 2)


# --- extents ------------------------------------------------------------------

_BOX = ("xmin", "ymin", "xmax", "ymax")


def union_extent(boxes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def intersection_extent(boxes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The common box; all NULL where there is none."""
    b = boxes.groupBy(*keys).agg(F.max("xmin").alias("xmin"), F.max("ymin").alias("ymin"), F.min("xmax").alias("xmax"), F.min("ymax").alias("ymax"))
    ok = (F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax"))
    return b.select(*keys, *[F.when(ok, F.col(n)).alias(n) for n in _BOX])


def pad_extent(boxes: DataFrame, share: float | None = 0.1, width: float | None = None, uniform: bool = False) -> DataFrame:
    """Grown by a share of each span (of the larger if ``uniform``), or by a width."""
    dx, dy = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    if width is not None:
        px = py = F.lit(float(width))
    elif uniform:
        px = py = F.greatest(dx, dy) * share
    else:
        px, py = dx * share, dy * share
    return boxes.withColumns({"xmin": F.col("xmin") - px, "ymin": F.col("ymin") - py, "xmax": F.col("xmax") + px, "ymax": F.col("ymax") + py})


def round_nearest(x: Column, step: float = 1e-3) -> Column:
    """Nearest multiple, halves to even."""
    return F.rint(x / step) * step


def round_extent(boxes: DataFrame, step: float = 1e-3) -> DataFrame:
    return boxes.withColumns({n: round_nearest(F.col(n), step) for n in _BOX})


def same(a: Column, b: Column, step: float = 1e-3) -> Column:
    return F.rint(a / step) == F.rint(b / step)


def in_extent(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def bbox_to_extent(bbox: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """(xmin, xmax, ymin, ymax) to (xmin, ymin, xmax, ymax)."""
    return bbox[0], bbox[2], bbox[1], bbox[3]


def center(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"x": (F.col("xmin") + F.col("xmax")) / 2, "y": (F.col("ymin") + F.col("ymax")) / 2})


# --- angles -------------------------------------------------------------------


def lon_180(lon: Column) -> Column:
    """-180 (inclusive) to 180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def lon_360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def dd_to_dms(dd: Column) -> Column:
    """Struct sign, d, m, s."""
    a = F.abs(dd)
    d = F.floor(a)
    m = F.floor((a - d) * 60.0)
    return F.struct(F.when(dd < 0, -1).otherwise(1).alias("sign"), d.cast("long").alias("d"), m.cast("long").alias("m"), ((a - d) * 3600.0 - m * 60.0).alias("s"))


def dms_to_dd(sign: Column, d: Column, m: Column, s: Column) -> Column:
    return sign * (d + m / 60.0 + s / 3600.0)


def dms_text_to_dd(text: Column) -> Column:
    """From text like ``47 30 15.5 N``; S, W or a leading minus is negative."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    n = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).cast("double"), F.lit(0.0))
    sign = F.when(F.upper(text).rlike("[SW]|^\\s*-"), -1.0).otherwise(1.0)
    return sign * (n(1) + n(2) / 60.0 + n(3) / 3600.0)


def dd_to_dm(dd: Column) -> Column:
    a = F.abs(dd)
    return F.struct(F.when(dd < 0, -1).otherwise(1).alias("sign"), F.floor(a).cast("long").alias("d"), ((a - F.floor(a)) * 60.0).alias("m"))


def dm_to_dd(sign: Column, d: Column, m: Column) -> Column:
    return sign * (d + m / 60.0)


# --- projections (WGS84) --------------------------------------------------------

A, INV_F = 6378137.0, 298.257223563
FLAT = 1 / INV_F
E2 = FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)


def utm_zone(lon: Column, lat: Column) -> Column:
    """1 to 60, with the exceptions for south-west Norway and Svalbard."""
    lon = lon_180(lon)
    z = (F.floor((lon + 180.0) / 6.0) + 1).cast("int")
    sval = F.when(lon.between(0, 8.999999999), 31).when((lon >= 9) & (lon < 21), 33).when((lon >= 21) & (lon < 33), 35).when((lon >= 33) & (lon < 42), 37)
    return F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lat < 84) & sval.isNotNull(), sval).otherwise(z)


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon, lat)


def preferred_epsg(lon: Column, lat: Column) -> Column:
    """Polar stereographic beyond 60 degrees (3413 north, 3031 south), else the UTM zone."""
    return F.when(lat >= 60, 3413).when(lat <= -60, 3031).otherwise(utm_epsg(lon, lat))


def _tmerc(lon: Column, lat: Column, lon0: Column, k0: float, x0: float, y0: Column) -> tuple[Column, Column]:
    """Transverse Mercator by a series that is good to a millimetre within a zone."""
    n = FLAT / (2 - FLAT)
    a1 = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    phi, lam = F.radians(lat), F.radians(lon_180(lon - lon0))
    e = math.sqrt(E2)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, al in enumerate(alpha, 1):
        east = east + al * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + al * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return x0 + k0 * a1 * east, y0 + k0 * a1 * north


def _tmerc_inverse(x: Column, y: Column, lon0: Column, k0: float, x0: float, y0: Column) -> tuple[Column, Column]:
    n = FLAT / (2 - FLAT)
    a1 = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    xi, eta = (y - y0) / (k0 * a1), (x - x0) / (k0 * a1)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return lon_180(lon0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))), F.degrees(phi)


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    return _tmerc(lon, lat, zone * 6.0 - 183.0, 0.9996, 500000.0, F.when(lat >= 0, 0.0).otherwise(1e7))


def from_utm(x: Column, y: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    return _tmerc_inverse(x, y, zone * 6.0 - 183.0, 0.9996, 500000.0, F.when(north, 0.0).otherwise(1e7))


def local_tmerc(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Transverse Mercator about a point."""
    x, y = _tmerc(lon, lat, F.lit(float(lon0)), 1.0, 0.0, F.lit(0.0))
    _, y0 = _tmerc(F.lit(float(lon0)), F.lit(float(lat0)), F.lit(float(lon0)), 1.0, 0.0, F.lit(0.0))
    return x, y - y0


def local_ortho(lon: Column, lat: Column, lon0: float, lat0: float, radius: float = A) -> tuple[Column, Column]:
    """Orthographic about a point, on the sphere."""
    p, d, p0 = F.radians(lat), F.radians(lon_180(lon - lon0)), math.radians(lat0)
    return radius * F.cos(p) * F.sin(d), radius * (math.cos(p0) * F.sin(p) - math.sin(p0) * F.cos(p) * F.cos(d))


def to_ecef(lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    p, d = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(p) ** 2)
    return (n + h) * F.cos(p) * F.cos(d), (n + h) * F.cos(p) * F.sin(d), (n * (1 - E2) + h) * F.sin(p)


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude, latitude, height, by Bowring's formula with one refinement."""
    b = A * (1 - FLAT)
    p = F.sqrt(x * x + y * y)

    def latitude(u: Column) -> Column:
        return F.atan2(z + EP2 * b * F.sin(u) ** 3, p - E2 * A * F.cos(u) ** 3)

    u0 = F.atan2(z * A, p * b)
    lat = _let(_let(u0, lambda u: _let(latitude(u), lambda q: F.atan2((1 - FLAT) * F.sin(q), F.cos(q)))), latitude)
    h = _let(lat, lambda q: p * F.cos(q) + z * F.sin(q) - A * F.sqrt(1 - E2 * F.sin(q) ** 2))
    return F.degrees(F.atan2(y, x)), F.degrees(lat), h


def polar_stereographic(lon: Column, lat: Column, lon0: float = -45.0, lat_ts: float = 70.0, south: bool = False) -> tuple[Column, Column]:
    sign = -1.0 if south else 1.0
    e = math.sqrt(E2)

    def t(p):
        s = F.sin(p)
        return F.tan(math.pi / 4 - p / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))

    pc = math.radians(lat_ts)
    sc = math.sin(pc)
    tc = math.tan(math.pi / 4 - pc / 2) / ((1 - e * sc) / (1 + e * sc)) ** (e / 2)
    mc = math.cos(pc) / math.sqrt(1 - E2 * sc * sc)
    p, d = F.radians(lat * sign), F.radians(lon_180(lon - lon0))
    rho = A * mc * t(p) / tc
    return rho * F.sin(d), -sign * rho * F.cos(d)


def from_polar_stereographic(x: Column, y: Column, lon0: float = -45.0, lat_ts: float = 70.0, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude; the inverse of :func:`polar_stereographic`."""
    sign = -1.0 if south else 1.0
    e = math.sqrt(E2)
    sc = math.sin(math.radians(lat_ts))
    tc = math.tan(math.pi / 4 - math.radians(lat_ts) / 2) / ((1 - e * sc) / (1 + e * sc)) ** (e / 2)
    mc = math.cos(math.radians(lat_ts)) / math.sqrt(1 - E2 * sc * sc)
    chi = math.pi / 2 - 2 * F.atan(F.sqrt(x * x + y * y) * tc / (A * mc))
    k = [E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360, 7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520, 7 * E2**3 / 120 + 81 * E2**4 / 1120, 4279 * E2**4 / 161280]
    phi = chi
    for j, a in enumerate(k, 1):
        phi = phi + a * F.sin(2 * j * chi)
    return lon_180(lon0 + F.degrees(F.atan2(x, -sign * y))), sign * F.degrees(phi)


Move = Callable[[Column, Column], tuple[Column, Column]]


def _of_system(srs: str) -> tuple[Move, Move]:
    """(to, from) longitude and latitude for EPSG codes of WGS84: lon/lat, UTM zones and the two polar grids."""
    code = srs.upper().removeprefix("EPSG:")
    if code == "4326":
        return (lambda x, y: (x, y)), (lambda x, y: (x, y))
    if code in ("3413", "3031"):
        own = {"lon0": -45.0, "lat_ts": 70.0} if code == "3413" else {"lon0": 0.0, "lat_ts": 71.0, "south": True}
        return (lambda x, y: from_polar_stereographic(x, y, **own)), (lambda x, y: polar_stereographic(x, y, **own))
    if re.fullmatch(r"32[67]\d\d", code) and 1 <= int(code[3:]) <= 60:
        zone, y0 = F.lit(int(code[3:])), F.lit(0.0 if code[2] == "6" else 1e7)
        return (lambda x, y: _tmerc_inverse(x, y, zone * 6.0 - 183.0, 0.9996, 500000.0, y0)), (lambda x, y: _tmerc(x, y, zone * 6.0 - 183.0, 0.9996, 500000.0, y0))
    raise ValueError(f"no transformation is known for {srs!r}")


def transform(source: str, target: str) -> Move:
    """Maps coordinates of one reference system to another; raises for systems it does not know."""
    if source == target:
        return lambda x, y: (x, y)
    (to_lonlat, _), (_, from_lonlat) = _of_system(source), _of_system(target)
    return lambda x, y: from_lonlat(*to_lonlat(x, y))


def polar_scale(lat: Column) -> Column:
    """Area scale of the polar stereographic grids with true scale at 70 N or 71 S."""
    e2 = 0.006694379990141
    e = math.sqrt(e2)
    p = F.radians(F.abs(lat))
    s = F.sin(p)
    t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))
    m = F.cos(p) / F.sqrt(1 - e2 * s * s)

    def at(true_deg: float) -> float:
        q = math.radians(true_deg)
        sq = math.sin(q)
        tq = math.tan(math.pi / 4 - q / 2) / ((1 - e * sq) / (1 + e * sq)) ** (e / 2)
        return math.cos(q) / math.sqrt(1 - e2 * sq * sq) / tq

    k = F.when(lat >= 0, at(70.0)).otherwise(at(71.0)) * t / F.nullif(m, F.lit(0.0))
    return 1 / (k * k)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 12) -> Column:
    """Ellipsoidal distance by Vincenty's inverse with a fixed number of rounds; NULL where it does not settle (antipodes)."""
    b = A * (1 - FLAT)
    u1, u2 = F.atan((1 - FLAT) * F.tan(F.radians(lat1))), F.atan((1 - FLAT) * F.tan(F.radians(lat2)))
    fixed = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon_180(lon2 - lon1)).alias("big"))

    def parts(k: Column, lam: Column, body: Callable[[Column], Column]) -> Column:
        """The body of a struct ss, cs, sg (arc), sa, ca (azimuth), cm (midpoint)."""
        ss = F.sqrt((k["c2"] * F.sin(lam)) ** 2 + (k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(lam)) ** 2)
        one = F.struct(ss.alias("ss"), (k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(lam)).alias("cs"), (k["c1"] * k["c2"] * F.sin(lam)).alias("cc"))
        two = lambda q: F.struct(q["ss"].alias("ss"), q["cs"].alias("cs"), F.coalesce(q["cc"] / F.nullif(q["ss"], F.lit(0.0)), F.lit(0.0)).alias("sa"))
        three = lambda q: F.struct(q["ss"].alias("ss"), q["cs"].alias("cs"), F.atan2(q["ss"], q["cs"]).alias("sg"), q["sa"].alias("sa"), (1 - q["sa"] * q["sa"]).alias("ca"), F.coalesce(q["cs"] - 2 * k["s1"] * k["s2"] / F.nullif(1 - q["sa"] * q["sa"], F.lit(0.0)), F.lit(0.0)).alias("cm"))
        return _let(one, lambda q: _let(two(q), lambda q2: _let(three(q2), body)))

    def again(k: Column, lam: Column) -> Column:
        def step(q: Column) -> Column:
            c = FLAT / 16 * q["ca"] * (4 + FLAT * (4 - 3 * q["ca"]))
            return k["big"] + (1 - c) * FLAT * q["sa"] * (q["sg"] + c * q["ss"] * (q["cm"] + c * q["cs"] * (2 * q["cm"] ** 2 - 1)))

        return parts(k, lam, step)

    def length(q: Column) -> Column:
        us = q["ca"] * ((A * A - b * b) / (b * b))
        aa = 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us)))
        bb = us / 1024 * (256 + us * (-128 + us * (74 - 47 * us)))
        ds = bb * q["ss"] * (q["cm"] + bb / 4 * (q["cs"] * (2 * q["cm"] ** 2 - 1) - bb / 6 * q["cm"] * (4 * q["ss"] ** 2 - 3) * (4 * q["cm"] ** 2 - 3)))
        return b * aa * (q["sg"] - ds) / 1000.0

    def whole(k: Column) -> Column:
        lam = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k["big"], lambda x, _: again(k, x))
        return _let(lam, lambda x: F.when(F.abs(x) <= math.pi, parts(k, x, length)))

    return _let(fixed, whole)
