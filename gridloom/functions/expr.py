"""Scalar band maths as Columns. Missing pixels are NULL; a division by zero gives what IEEE gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def divide(n: Column, d: Column, null_on_zero: bool = False) -> Column:
    """n / d as doubles: infinite or NaN for d = 0, or NULL if ``null_on_zero``."""
    n, d = n.cast("double"), d.cast("double")
    if null_on_zero:
        return F.try_divide(n, d)
    at_zero = F.when(n > 0, F.lit(INF)).when(n < 0, F.lit(-INF)).when(n == 0, F.lit(NAN)).when(F.isnan(n), F.lit(NAN))
    return F.when(d == 0, at_zero).otherwise(F.try_divide(n, d))


def normalized_difference(a: Column, b: Column, smooth: float = 0.0) -> Column:
    """(a - b) / (a + b + smooth), in doubles, so that unsigned digital numbers never wrap."""
    a, b = a.cast("double"), b.cast("double")
    return divide(a - b, a + b + smooth if smooth else a + b)


def ndvi(nir: Column, red: Column, smooth: float = 0.0) -> Column:
    return normalized_difference(nir, red, smooth)


def evi(nir: Column, red: Column, blue: Column, gain: float = 2.5, c1: float = 6.0, c2: float = 7.5, soil: float = 1.0) -> Column:
    """Enhanced vegetation index."""
    nir, red, blue = (c.cast("double") for c in (nir, red, blue))
    return gain * divide(nir - red, nir + c1 * red - c2 * blue + soil)


def reflectance(dn: Column, scale: Column, offset: Column, nodata: Column | None = None) -> Column:
    """dn * scale + offset; NULL where dn is the nodata value."""
    value = dn.cast("double") * scale + offset
    return value if nodata is None else F.when(~dn.eqNullSafe(nodata), value)


def year_month(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")


def months_between(start: Column, end: Column) -> Column:
    """Array of the months (YYYY-MM) that a closed time range touches; empty if the range is."""
    months = F.sequence(F.trunc(start.cast("date"), "month"), F.trunc(end.cast("date"), "month"), F.expr("INTERVAL 1 MONTH"))
    return F.when(start <= end, F.transform(months, lambda d: F.date_format(d, "yyyy-MM"))).otherwise(F.array().cast("array<string>"))


def date_in_name(name: Column, own_pattern: str | None = None) -> Column:
    """Date in a file name: the caller's own pattern first (its first group, if any), then YYYY-MM-DD, YYYYMMDD,
    YYYY_MM_DD. A match that is no date is passed over; NULL if nothing is found."""
    tries = []
    if own_pattern:
        group = 1 if "(" in own_pattern.replace(r"\(", "").replace("(?:", "") else 0
        found = F.regexp_extract(name, own_pattern, group)
        tries += [F.try_to_timestamp(F.when(found != "", found), F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "yyyyMMdd", "yyyy_MM_dd", "yyyy/MM/dd")]
    for pattern, fmt in ((r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"), (r"(\d{8})", "yyyyMMdd"), (r"(\d{4}_\d{2}_\d{2})", "yyyy_MM_dd")):
        found = F.regexp_extract(name, pattern, 1)
        tries.append(F.try_to_timestamp(F.when(found != "", found), F.lit(fmt)).cast("date"))
    return F.coalesce(*tries)


def product_of_path(path: Column) -> Column:
    """Name of the folder that holds a file, "default" at the root."""
    parts = F.split(F.regexp_replace(path, r"[/\\]+", "/"), "/")
    parent = F.try_element_at(parts, F.lit(-2))
    return F.when(F.coalesce(parent, F.lit("")) == "", F.lit("default")).otherwise(parent)
