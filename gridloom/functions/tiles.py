"""The fixed 2,560 m tile grid as Column expressions.

A tile id names two grid indices. Ids are accepted in any spelling (case,
blanks, number of leading zeros) and come out canonical: at least four digits,
a sign only if negative. Text that is no tile id gives NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE_METRES = 2560.0
EARTH_RADIUS = 6378137.0
METRES_PER_DEGREE = math.pi / 180.0 * EARTH_RADIUS
ID_PATTERN = r"^\s*[xX]([+-]?\d{1,9})_[yY]([+-]?\d{1,9})\s*$"
ALREADY = r"^x(?!-0000)-?\d{4}_y(?!-0000)-?\d{4}$"
#: The same inside a longer text such as a path.
ID_INSIDE = r"(?i)(?:^|[/\\=])x([+-]?\d{1,9})_y([+-]?\d{1,9})(?=$|[/\\])"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tile_x(tile_id: Column | str, pattern: str = ID_PATTERN) -> Column:
    return F.regexp_extract(_c(tile_id), pattern, 1).try_cast("int")


def tile_y(tile_id: Column | str, pattern: str = ID_PATTERN) -> Column:
    return F.regexp_extract(_c(tile_id), pattern, 2).try_cast("int")


def index_text(i: Column) -> Column:
    digits = F.abs(i).cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.when(i < 0, F.concat(F.lit("-"), padded)).otherwise(padded)


def tile_text(x: Column, y: Column) -> Column:
    return F.concat(F.lit("x"), index_text(x), F.lit("_y"), index_text(y))


def canonical(tile_id: Column | str, pattern: str = ID_PATTERN) -> Column:
    """Canonical spelling; NULL if the text is no tile id. Text that is canonical already costs one match."""
    full = tile_text(tile_x(tile_id, pattern), tile_y(tile_id, pattern))
    return F.when(_c(tile_id).rlike(ALREADY), _c(tile_id)).otherwise(full) if pattern == ID_PATTERN else full


def canonical_or_self(tile_id: Column | str) -> Column:
    """Canonical spelling; text that is no tile id stays as it is, so that its rows still group."""
    return F.coalesce(canonical(tile_id), _c(tile_id))


def tile_of_point(lon: Column, lat: Column, size: float = TILE_METRES) -> Column:
    """Id of the tile that holds a point: x shrinks with the cosine of the latitude."""
    x = F.floor(lon * METRES_PER_DEGREE * F.cos(F.radians(lat)) / size).cast("int")
    y = F.floor(lat * METRES_PER_DEGREE / size).cast("int")
    return tile_text(x, y)


def tile_bounds(x: Column, y: Column, size: float = TILE_METRES) -> Column:
    """struct(minx, miny, maxx, maxy) in degrees; longitudes use the latitude of the tile's middle, 0 at a pole."""
    miny, maxy = y * size / METRES_PER_DEGREE, (y + 1) * size / METRES_PER_DEGREE
    shrink = F.cos(F.radians((miny + maxy) / 2)) * METRES_PER_DEGREE
    at_pole = F.abs(shrink) < 1e-6
    west = F.when(at_pole, F.lit(0.0)).otherwise(F.try_divide(x * size, shrink))
    east = F.when(at_pole, F.lit(0.0)).otherwise(F.try_divide((x + 1) * size, shrink))
    return F.struct(west.alias("minx"), miny.alias("miny"), east.alias("maxx"), maxy.alias("maxy"))


def pixels_across(resolution: Column | str, size: float = TILE_METRES) -> Column:
    """Pixels on a tile's side, rounded up; NULL for a resolution that is not positive."""
    r = _c(resolution)
    return F.when(r > 0, F.ceil(F.lit(size) / r)).cast("int")
