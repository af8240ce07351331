"""Web-mercator tile maths on the XYZ scheme (y grows southward)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half side of the mercator square, sphere radius, latitude limit, deepest zooms.
EXTENT = 20037508.342789244
RADIUS = 6378137.0
MAX_LAT = 85.0511287798066
MAX_ZOOM = 31
PREVIEW_MAX_ZOOM = 24


def col(value) -> Column:
    """A column from a column, a column name or a number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def matrix_width(z) -> Column:
    """Tiles per axis at zoom ``z``, as bigint so that z = 31 does not overflow."""
    return F.expr("1L") * F.pow(F.lit(2.0), col(z)).cast("long")


def _clamp_index(index: Column, z) -> Column:
    return F.least(F.greatest(index.cast("long"), F.lit(0).cast("long")), matrix_width(z) - 1)


def tile_span(z) -> Column:
    """Side of one tile in metres."""
    return F.lit(2.0 * EXTENT) / F.pow(F.lit(2.0), col(z))


def tile_x_for_x(x, z) -> Column:
    """Tile column holding mercator ``x``; points outside clamp to the edge tile."""
    return _clamp_index(F.floor((col(x) + F.lit(EXTENT)) / tile_span(z)), z)


def tile_y_for_y(y, z) -> Column:
    """Tile row holding mercator ``y``."""
    return _clamp_index(F.floor((F.lit(EXTENT) - col(y)) / tile_span(z)), z)


def lon_fraction(lon) -> Column:
    """Longitude as a fraction 0..1 of the mercator square, clamped to the domain."""
    lon = F.least(F.greatest(col(lon), F.lit(-180.0)), F.lit(180.0))
    return (lon + F.lit(180.0)) / F.lit(360.0)


def lat_fraction(lat) -> Column:
    """Latitude as a fraction 0..1 from the north edge, clamped to the domain."""
    lat = F.least(F.greatest(col(lat), F.lit(-MAX_LAT)), F.lit(MAX_LAT))
    y = (F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / F.pi()) / F.lit(2.0)
    return F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))


def tile_x_for_lon(lon, z) -> Column:
    """Tile column holding longitude ``lon``."""
    return _clamp_index(F.floor(lon_fraction(lon) * F.pow(F.lit(2.0), col(z))), z)


def tile_y_for_lat(lat, z) -> Column:
    """Tile row holding latitude ``lat``."""
    return _clamp_index(F.floor(lat_fraction(lat) * F.pow(F.lit(2.0), col(z))), z)


def tile_bounds_xy(z, x, y) -> Column:
    """Mercator bounds of a tile as ``struct<min_x,min_y,max_x,max_y>``."""
    span = tile_span(z)
    min_x = span * col(x) - F.lit(EXTENT)
    max_y = F.lit(EXTENT) - span * col(y)
    return F.struct(
        min_x.alias("min_x"), (max_y - span).alias("min_y"), (min_x + span).alias("max_x"), max_y.alias("max_y")
    )


def lon_of_x(x) -> Column:
    return col(x) / F.lit(EXTENT) * F.lit(180.0)


def lat_of_y(y) -> Column:
    return F.degrees(F.atan(F.sinh(col(y) / F.lit(RADIUS))))


def tile_bounds_lonlat(z, x, y) -> Column:
    """Geographic bounds of a tile as ``struct<west,south,east,north>``."""
    span = tile_span(z)
    min_x = span * col(x) - F.lit(EXTENT)
    max_y = F.lit(EXTENT) - span * col(y)
    return F.struct(
        lon_of_x(min_x).alias("west"),
        lat_of_y(max_y - span).alias("south"),
        lon_of_x(min_x + span).alias("east"),
        lat_of_y(max_y).alias("north"),
    )


def tile_valid(z, x, y) -> Column:
    """Whether the address exists: 0 <= z <= 31 and both indices inside the matrix."""
    z, x, y = col(z), col(x), col(y)
    zoom_ok = z.between(0, MAX_ZOOM)
    width = matrix_width(F.when(zoom_ok, z).otherwise(0))
    return F.coalesce(zoom_ok & (x >= 0) & (y >= 0) & (x < width) & (y < width), F.lit(False))


def _tile(z: Column, x: Column, y: Column) -> Column:
    return F.struct(z.cast("int").alias("z"), x.cast("long").alias("x"), y.cast("long").alias("y"))


def tile_parent(z, x, y) -> Column:
    """The parent tile, NULL at the root."""
    z, x, y = col(z), col(x), col(y)
    return F.when(z > 0, _tile(z - 1, F.shiftright(x, 1), F.shiftright(y, 1)))


def tile_children(z, x, y) -> Column:
    """The four children in NW, NE, SW, SE order; NULL at the deepest zoom."""
    z, x, y = col(z), col(x), col(y)
    quads = [_tile(z + 1, x * 2 + dx, y * 2 + dy) for dy in (0, 1) for dx in (0, 1)]
    return F.when(z < MAX_ZOOM, F.array(*quads))


def tile_key(z, x, y) -> Column:
    """The ``z/x/y`` text of a tile."""
    return F.concat_ws("/", col(z).cast("string"), col(x).cast("string"), col(y).cast("string"))


def parse_tile_key(text) -> Column:
    """``z/x/y`` text to a tile struct; NULL when it is not a tile of the matrix."""
    text = col(text)
    part = lambda i: F.split(text, "/").getItem(i)
    shape = text.rlike(r"^\d{1,2}/\d{1,10}/\d{1,10}$")
    z, x, y = (F.when(shape, part(i).cast("long")) for i in range(3))
    return F.when(shape & tile_valid(z, x, y), _tile(z, x, y))


def parse_ogc_tile_key(text) -> Column:
    """``z/row/col`` text (row before column) to a tile struct."""
    text = col(text)
    swapped = F.regexp_replace(text, r"^(\d+)/(\d+)/(\d+)$", "$1/$3/$2")
    return parse_tile_key(swapped)
