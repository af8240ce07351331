"""Projections as column arithmetic: lon/lat, spherical mercator, WGS84 UTM, spherical sinusoidal.

A CRS is text: ``EPSG:4326``, ``EPSG:3857``, ``EPSG:326zz``/``EPSG:327zz`` or a spherical
``+proj=sinu`` string. It may be a literal (one branch is laid out) or a column. Points outside
a projection's domain come out NULL.

UTM uses the sixth-order Krueger series in the third flattening (Karney 2011), whose error
is far below a nanometre inside a zone.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import RADIUS, col

MERCATOR_MAX_LAT = 85.051129

# WGS84 ellipsoid and the UTM scale and offsets.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING = 10000000.0

WGS84 = "EPSG:4326"
WEB_MERCATOR = "EPSG:3857"

_N = WGS84_F / (2 - WGS84_F)
ECCENTRICITY = sqrt(WGS84_F * (2 - WGS84_F))
RECTIFYING_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def _series(*rows: tuple) -> list[float]:
    """Row j holds the coefficients of n^j, n^(j+1), ... of term j."""
    return [sum(c * _N ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(rows, start=1)]


# Published series coefficients (forward, inverse, conformal to geodetic latitude).
ALPHA = _series(
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
BETA = _series(
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
DELTA = _series(
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (4279 / 630, -332 / 35, -399572 / 14175),
    (4174 / 315, -144838 / 6237),
    (601676 / 22275,),
)


def text_col(value) -> Column:
    """A text column: plain strings are literals here, since CRS names are values."""
    return value if isinstance(value, Column) else F.lit(value)


def crs_epsg(crs) -> Column:
    """The EPSG number of a CRS text, NULL for proj strings."""
    crs = text_col(crs)
    return F.when(crs.rlike(r"^EPSG:\d{1,6}$"), F.substring(crs, 6, 6).cast("int"))


def utm_zone(epsg) -> Column:
    """The UTM zone of an EPSG number, NULL outside 32601-32660 and 32701-32760."""
    epsg = col(epsg)
    zone = epsg % 100
    return F.when((epsg.between(32601, 32660)) | (epsg.between(32701, 32760)), zone)


def crs_to_proj(epsg) -> Column:
    """EPSG number to its proj definition; unknown numbers are NULL."""
    epsg = col(epsg)
    zone = utm_zone(epsg).cast("string")
    south = F.when(epsg >= 32700, " +south").otherwise("")
    return (
        F.when(epsg == 4326, "+proj=longlat +datum=WGS84 +no_defs")
        .when(
            epsg == 3857,
            "+proj=merc +a=6378137 +b=6378137 +lat_ts=0 +lon_0=0 +x_0=0 +y_0=0 +k=1 +units=m"
            " +nadgrids=@null +no_defs",
        )
        .when(zone.isNotNull(), F.concat(F.lit("+proj=utm +zone="), zone, south, F.lit(" +datum=WGS84 +units=m +no_defs")))
    )


# Parameters a spherical sinusoidal definition may carry.
SINU_PARAMETERS = "proj|R|a|b|lon_0|x_0|y_0|units|no_defs|wktext|type|nadgrids"


SINU_VALUES = ("proj", "R", "a", "b", "lon_0", "x_0", "y_0", "units", "nadgrids")

# Long expressions are given as SQL text: one call to the JVM instead of one per operator.
_SINU_SQL = r"""CASE WHEN {text} RLIKE '^\\s*(\\+({known})(=\\S*)?(\\s+|$))+$' AND {proj} = 'sinu'
  AND coalesce({units} = 'm', true) AND coalesce({nadgrids} = '@null', true)
  AND ({lon_0} IS NULL OR try_cast({lon_0} AS double) IS NOT NULL)
  AND ({x_0} IS NULL OR try_cast({x_0} AS double) IS NOT NULL)
  AND ({y_0} IS NULL OR try_cast({y_0} AS double) IS NOT NULL)
  AND {radius} > 0 AND {radius} < double('infinity')
  THEN named_struct('radius', {radius}, 'lon_0', coalesce(try_cast({lon_0} AS double), 0D),
    'x_0', coalesce(try_cast({x_0} AS double), 0D), 'y_0', coalesce(try_cast({y_0} AS double), 0D)) END"""

_RADIUS_SQL = """(CASE WHEN try_cast({R} AS double) IS NOT NULL AND {a} IS NULL AND {b} IS NULL THEN try_cast({R} AS double)
  WHEN {R} IS NULL AND try_cast({a} AS double) = try_cast({b} AS double) THEN try_cast({a} AS double) END)"""


def _parameter_sql(text: str, name: str) -> str:
    """One proj parameter; the last one counts when it is repeated."""
    return rf"nullif(regexp_extract({text}, '^(?:|.*\\s)\\+{name}=(\\S*)', 1), '')"


def _sinu_sql(text: str, raw: dict[str, str]) -> str:
    return _SINU_SQL.format(text=text, known=SINU_PARAMETERS, radius=_RADIUS_SQL.format(**raw), **raw)


def with_sinu(df: DataFrame, proj, out: str) -> DataFrame:
    """Add ``out``: a spherical sinusoidal definition as ``struct<radius,lon_0,x_0,y_0>`` (lon_0 in degrees).

    Ellipsoids, other projections, other units and unknown parameters give NULL.
    """
    text = f"{out}_def"
    raw = {n: f"{out}_raw_{n}" for n in SINU_VALUES}
    proj = text_col(proj)
    df = df.withColumn(text, F.when(proj.startswith("+proj=sinu"), proj))
    df = df.withColumns({c: F.expr(_parameter_sql(text, n)) for n, c in raw.items()})
    return df.withColumn(out, F.expr(_sinu_sql(text, raw))).drop(text, *raw.values())


# Points are ``struct<x,y>`` whose fields are NULL outside the domain. The domain is applied to the
# inputs, not around the result: a heavy expression inside a conditional branch would keep the code
# generator from computing shared parts (the series terms) once.


def _inside(x, y, ok: Column) -> tuple[Column, Column]:
    """Both coordinates as double, NULL unless finite and ``ok``."""
    x, y = col(x).cast("double"), col(y).cast("double")
    fine = ok & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    return F.when(fine, x), F.when(fine, y)


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


# --- spherical mercator ---


def lonlat_to_mercator(lon, lat) -> Column:
    lon, lat = _inside(lon, lat, F.abs(col(lat)) <= MERCATOR_MAX_LAT)
    return _point(F.radians(lon) * F.lit(RADIUS), F.lit(RADIUS) * F.asinh(F.tan(F.radians(lat))))


def mercator_to_lonlat(x, y) -> Column:
    x, y = _inside(x, y, F.lit(True))
    return _point(F.degrees(x / F.lit(RADIUS)), F.degrees(F.atan(F.sinh(y / F.lit(RADIUS)))))


# --- UTM ---


def _is_south(south) -> Column:
    return south if isinstance(south, Column) else F.lit(bool(south))


def _num(value: float) -> str:
    return f"{value!r}D"


def _terms(sign: str, coefficients: list[float], first: str, second: str | None = None) -> str:
    """Series text: sum of c_j * first(2j * a) * second(2j * b) with ``first`` like ``sin(_xi``."""
    parts = []
    for j, c in enumerate(coefficients, start=1):
        factors = [_num(c), f"{first} * {2 * j}D)"] + ([f"{second} * {2 * j}D)"] if second else [])
        parts.append(f"{sign} " + " * ".join(factors))
    return " ".join(parts)


_SHIFT = f"(CASE WHEN _south THEN {_num(UTM_FALSE_NORTHING)} ELSE 0D END)"
_UTM_SCALE = _num(UTM_K0 * RECTIFYING_RADIUS)
_E = _num(ECCENTRICITY)


def _steps(df: DataFrame, *steps: dict[str, str]) -> DataFrame:
    """Projection steps given as SQL text."""
    for step in steps:
        df = df.withColumns({name: F.expr(text) for name, text in step.items()})
    return df


def add_utm(df: DataFrame, lon, lat, zone, south, out: str) -> DataFrame:
    """Add ``{out}_x, {out}_y`` in one UTM zone; ``zone`` and ``south`` may be columns.

    The series is laid out in projection steps, so every intermediate is computed once per row.
    """
    df = df.withColumns({"_ulon": col(lon), "_ulat": col(lat), "_uzone": col(zone), "_south": _is_south(south)})
    inside = "abs(_ulat) < 90 AND abs(_away) < 85"
    moved = _steps(
        df,
        {"_away": "pmod(_ulon - (_uzone * 6 - 183) + 180, 360D) - 180"},
        {"_lam": f"radians(CASE WHEN {inside} THEN _away END)", "_phi": f"radians(CASE WHEN {inside} THEN _ulat END)"},
        {"_tau": "tan(_phi)", "_sigma": f"sinh({_E} * atanh({_E} * sin(_phi)))", "_sin": "sin(_lam)", "_cos": "cos(_lam)"},
        {"_tau": "_tau * sqrt(1 + _sigma * _sigma) - _sigma * sqrt(1 + _tau * _tau)"},
        {"_xi": "atan2(_tau, _cos)", "_eta": "asinh(try_divide(_sin, sqrt(_tau * _tau + _cos * _cos)))"},
        {
            f"{out}_x": f"{_num(UTM_FALSE_EASTING)} + {_UTM_SCALE} * (_eta {_terms('+', ALPHA, 'cos(_xi', 'sinh(_eta')})",
            f"{out}_y": f"{_UTM_SCALE} * (_xi {_terms('+', ALPHA, 'sin(_xi', 'cosh(_eta')}) + {_SHIFT}",
        },
    )
    return moved.drop("_ulon", "_ulat", "_uzone", "_south", "_away", "_lam", "_phi", "_tau", "_sigma", "_sin", "_cos", "_xi", "_eta")


def add_lonlat_of_utm(df: DataFrame, x, y, zone, south, out: str) -> DataFrame:
    """Add ``{out}_x, {out}_y`` holding lon, lat of a UTM point, in projection steps."""
    df = df.withColumns({"_ux": col(x), "_uy": col(y), "_uzone": col(zone), "_south": _is_south(south)})
    inside = "abs(_eta) < 3 AND abs(_xi) <= 1.5708"
    moved = _steps(
        df,
        {"_eta": f"(_ux - {_num(UTM_FALSE_EASTING)}) / {_UTM_SCALE}", "_xi": f"(_uy - {_SHIFT}) / {_UTM_SCALE}"},
        {"_xi": f"CASE WHEN {inside} THEN _xi END", "_eta": f"CASE WHEN {inside} THEN _eta END"},
        {
            "_xi": f"_xi {_terms('-', BETA, 'sin(_xi', 'cosh(_eta')}",
            "_eta": f"_eta {_terms('-', BETA, 'cos(_xi', 'sinh(_eta')}",
        },
        {"_chi": "asin(sin(_xi) / cosh(_eta))", "_lam": "atan2(sinh(_eta), cos(_xi))"},
        {
            f"{out}_x": "pmod(degrees(_lam) + (_uzone * 6 - 183) + 180, 360D) - 180",
            f"{out}_y": f"degrees(_chi {_terms('+', DELTA, 'sin(_chi')})",
        },
    )
    return moved.drop("_ux", "_uy", "_uzone", "_south", "_xi", "_eta", "_chi", "_lam")


# --- spherical sinusoidal ---


def lonlat_to_sinu(lon, lat, radius=6371007.181, lon_0=0.0, x_0=0.0, y_0=0.0) -> Column:
    radius, lon_0, x_0, y_0 = map(col, (radius, lon_0, x_0, y_0))
    lon, lat = _inside(lon, lat, F.abs(col(lat)) <= 90)
    phi = F.radians(lat)
    return _point(radius * F.radians(lon - lon_0) * F.cos(phi) + x_0, radius * phi + y_0)


def sinu_to_lonlat(x, y, radius=6371007.181, lon_0=0.0, x_0=0.0, y_0=0.0) -> Column:
    """Inverse; at the poles the longitude is the central meridian, elsewhere it wraps to +-180."""
    radius, lon_0, x_0, y_0 = map(col, (radius, lon_0, x_0, y_0))
    x, phi = _inside(x, (col(y) - y_0) / radius, F.abs((col(y) - y_0) / radius) <= F.pi() / 2)
    lam = F.radians(lon_0) + F.coalesce(F.try_divide(x - x_0, radius * F.cos(phi)), x - x)
    two_pi = F.lit(2.0) * F.pi()
    lam = F.when(F.abs(lam) > F.pi(), lam - two_pi * F.floor((lam + F.pi()) / two_pi)).otherwise(lam)
    return _point(F.degrees(lam), F.degrees(phi))


# --- any pair, through lon/lat ---


def _lonlat_identity(lon, lat) -> Column:
    return _point(*_inside(lon, lat, F.abs(col(lat)) <= 90))


def _zone_of(crs: str) -> tuple[int, bool] | None:
    """UTM zone and hemisphere of a CRS literal."""
    epsg = int(crs[5:]) if crs.startswith("EPSG:") and crs[5:].isdigit() else 0
    return (epsg % 100, epsg // 100 == 327) if epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60 else None


@dataclass(frozen=True)
class ParsedCrs:
    """A CRS column parsed ahead of time by ``with_crs``: parse once per raster, use per pixel."""

    name: str

    def __getitem__(self, part: str) -> Column:
        return F.col(f"{self.name}_{part}")

    @property
    def columns(self) -> list[str]:
        return [f"{self.name}_{p}" for p in ("epsg", "zone", "sinu")]


def with_crs(df: DataFrame, crs, name: str) -> DataFrame:
    """Add the parsed form of a CRS text as ``{name}_epsg, {name}_zone, {name}_sinu``.

    Flat columns on purpose: the optimizer repeats a struct's expression at every field access.
    """
    df = df.withColumn(f"{name}_text", text_col(crs))
    df = df.withColumn(f"{name}_epsg", crs_epsg(F.col(f"{name}_text"))).withColumn(f"{name}_zone", utm_zone(f"{name}_epsg"))
    return with_sinu(df, F.col(f"{name}_text"), f"{name}_sinu").drop(f"{name}_text")


def _split(df: DataFrame, point: Column, out: str) -> DataFrame:
    return df.withColumns({f"{out}_x": point["x"], f"{out}_y": point["y"]})


def _add(df: DataFrame, x: Column, y: Column, crs, out: str, mercator, utm, sinu) -> DataFrame:
    if isinstance(crs, str):  # one branch, chosen now
        if crs == WGS84:
            return _split(df, _lonlat_identity(x, y), out)
        if crs == WEB_MERCATOR:
            return _split(df, mercator(x, y), out)
        if _zone_of(crs):
            return utm(df, x, y, *_zone_of(crs), out)
        if crs.startswith("+proj=sinu"):
            p = lambda k: F.col(f"_sinu.{k}")
            df = with_sinu(df, crs, "_sinu")
            return _split(df, sinu(x, y, p("radius"), p("lon_0"), p("x_0"), p("y_0")), out).drop("_sinu")
        raise ValueError(f"unsupported CRS {crs!r}")
    # All branches; each sees NULL inputs unless it applies, so exactly one result is not NULL and
    # ``greatest``, which skips NULLs, picks it without a conditional around the heavy arithmetic.
    made = []
    if not isinstance(crs, ParsedCrs):
        df, crs = with_crs(df, crs, "_crs"), ParsedCrs("_crs")
        made = crs.columns
    df = df.withColumns({"_px": x, "_py": y})
    epsg, zone, p = crs["epsg"], crs["zone"], crs["sinu"]
    only = lambda test: (F.when(test, F.col("_px")), F.when(test, F.col("_py")))
    df = utm(df, *only(zone.isNotNull()), zone, epsg >= 32700, "_in_utm")
    points = [
        _lonlat_identity(*only(epsg == 4326)),
        mercator(*only(epsg == 3857)),
        sinu(*only(p.isNotNull()), p["radius"], p["lon_0"], p["x_0"], p["y_0"]),
    ]
    best = lambda k: F.greatest(F.col(f"_in_utm_{k}"), *[q[k] for q in points])
    return df.withColumns({f"{out}_x": best("x"), f"{out}_y": best("y")}).drop(*made, "_px", "_py", "_in_utm_x", "_in_utm_y")


def add_lonlat(df: DataFrame, x, y, crs, out: str) -> DataFrame:
    """Add ``{out}_x, {out}_y``: lon, lat of a point of any supported CRS (literal, column or parsed)."""
    return _add(df, col(x), col(y), crs, out, mercator_to_lonlat, add_lonlat_of_utm, sinu_to_lonlat)


def add_projected(df: DataFrame, lon, lat, crs, out: str) -> DataFrame:
    """Add ``{out}_x, {out}_y``: a lon/lat point in any supported CRS (literal, column or parsed)."""
    return _add(df, col(lon), col(lat), crs, out, lonlat_to_mercator, add_utm, lonlat_to_sinu)
