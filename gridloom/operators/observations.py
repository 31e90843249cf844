"""Operators on observations: one row per tile, band and instant with its pixels as an array.

Per-pixel maths that ends in one number per observation stays in array functions;
pixels are exploded only where they are grouped across time.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.expr import divide
from gridloom.functions.tiles import tile_bounds, tile_x, tile_y


def in_tiles(df: DataFrame, tiles: list[str]) -> DataFrame:
    return df.where(F.col("tile_id").isin(tiles))


def in_bands(df: DataFrame, bands: list[str], strict: bool = True) -> DataFrame:
    """Rows of the bands. Unknown bands raise ValueError; with ``strict=False`` they are ignored, and all rows come if
    none is known."""
    known = {r[0] for r in df.select("band").distinct().collect()}  # bands of a product family, a few dozen
    unknown = sorted(set(bands) - known)
    if unknown and strict:
        raise ValueError(f"unknown bands {unknown}; there are {sorted(known)}")
    wanted = [b for b in bands if b in known]
    return df.where(F.col("band").isin(wanted)) if wanted else df


def in_months(df: DataFrame, start: str, end: str) -> DataFrame:
    """Catalogue granularity: rows whose year_month lies between two months, both included."""
    return df.where(F.col("year_month").between(start, end))


def between_times(df: DataFrame, start: datetime, end: datetime, prune: bool = False) -> DataFrame:
    """Data granularity: start <= time <= end; naive datetimes are UTC. ``prune`` adds the months' bounds on year_month,
    for stores that are partitioned by it and in which it can be trusted."""
    start, end = (t if t.tzinfo else t.replace(tzinfo=UTC) for t in (start, end))
    exact = df.where((F.col("time") >= F.lit(start)) & (F.col("time") <= F.lit(end)))
    return in_months(exact, f"{start:%Y-%m}", f"{end:%Y-%m}") if prune else exact


def time_range(label: str | datetime | slice) -> tuple[datetime | None, datetime | None]:
    """Start and end of a time label. A month covers itself up to the first instant of the next one, a day likewise; in
    a slice a month stands for its first instant. An instant covers itself; an open end is None."""

    def point(x: str | datetime | None) -> datetime | None:
        if x is None or isinstance(x, datetime):
            return x if x is None or x.tzinfo else x.replace(tzinfo=UTC)
        if len(x) == 7:
            x += "-01"
        t = datetime.fromisoformat(x)
        return t if t.tzinfo else t.replace(tzinfo=UTC)

    if isinstance(label, slice):
        return point(label.start), point(label.stop)
    start = point(label)
    if isinstance(label, str) and len(label) == 7:
        return start, (start.replace(day=28) + timedelta(days=4)).replace(day=1)
    if isinstance(label, str) and len(label) == 10:
        return start, start + timedelta(days=1)
    return start, start


def select_time(df: DataFrame, label: str | datetime | slice) -> DataFrame:
    start, end = time_range(label)
    out = df if start is None else df.where(F.col("time") >= F.lit(start))
    return out if end is None else out.where(F.col("time") <= F.lit(end))


def at_instant(df: DataFrame, tile_id: str, band: str, time: datetime) -> DataFrame:
    """The observation at an exact instant; of several the smallest obs_id."""
    return between_times(in_tiles(df, [tile_id]).where(F.col("band") == band), time, time).orderBy("obs_id").limit(1)


def nearest_in_time(df: DataFrame, time: datetime, keys: list[str]) -> DataFrame:
    """Per group the rows of the instant nearest to ``time``, the earlier of two as near."""
    us = int(time.replace(tzinfo=time.tzinfo or UTC).timestamp() * 1_000_000)
    at = F.unix_micros("time")
    best = df.where(F.col("time").isNotNull()).groupBy(*keys).agg(F.min(F.struct(F.abs(at - us), at.alias("at"))).alias("best")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("best.at").alias("_at"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.unix_micros("time") == F.col("_at")]
    return df.join(best, on).drop("_at", *[f"_{k}" for k in keys])


def at_position(df: DataFrame, keys: list[str], position: int | slice, order: list[str]) -> DataFrame:
    """Per group the rows at a position in ``order``; negative positions count from the end."""
    forward = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_i", F.row_number().over(forward) - 1)
    needs_end = isinstance(position, int) and position < 0 or isinstance(position, slice) and any((v or 0) < 0 for v in (position.start, position.stop))
    if needs_end:
        ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    place = lambda v: F.lit(v) if v >= 0 else F.col("_n") + v
    if isinstance(position, int):
        keep = F.col("_i") == place(position)
    else:
        start = F.lit(0) if position.start is None else place(position.start)
        keep = F.col("_i") >= start
        if position.stop is not None:
            keep &= F.col("_i") < place(position.stop)
        if position.step and position.step != 1:
            keep &= (F.col("_i") - start) % position.step == 0
    return ranked.where(keep).drop("_i", "_n")


def width_of(num_pixels: Column) -> Column:
    """Side of a square pixel array, NULL if the number of pixels is no square."""
    side = F.rint(F.sqrt(num_pixels.cast("double"))).cast("int")
    return F.when(side * side == num_pixels, side)


def explode_pixels(df: DataFrame, keys: list[str], width: Column | None = None) -> DataFrame:
    """keys, y, x, value, valid: one row per pixel, row by row from the north-west. Arrays of no square size and no
    given width have y = 0. A missing mask counts as valid."""
    w = F.coalesce(width if width is not None else width_of(F.size("pixels")), F.size("pixels"))
    rows = df.select(*keys, w.alias("_w"), F.posexplode(F.arrays_zip("pixels", "mask")).alias("_pos", "_p"))
    return rows.select(*keys, F.floor(F.col("_pos") / F.col("_w")).cast("int").alias("y"), (F.col("_pos") % F.col("_w")).cast("int").alias("x"), F.col("_p.pixels").alias("value"), F.coalesce("_p.mask", F.lit(True)).alias("valid"))


def pixel_places(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pixel with the longitude and latitude of its place: coordinates run straight between the tile's edges,
    both ends included, from north to south. Rows whose tile id cannot be read, or of one pixel a side, have no place and
    are left out."""
    side = width_of(F.size("pixels"))
    named = df.withColumns({"_tx": tile_x("tile_id"), "_ty": tile_y("tile_id"), "_last": side - 1}).where(F.col("_tx").isNotNull() & (F.col("_last") > 0))
    placed = named.withColumn("_b", tile_bounds(F.col("_tx"), F.col("_ty"))).drop("_tx", "_ty")
    px = explode_pixels(placed, [*keys, "_b", "_last"])
    lon = F.col("_b.minx") + F.col("x") * (F.col("_b.maxx") - F.col("_b.minx")) / F.col("_last")
    lat = F.col("_b.maxy") + F.col("y") * (F.col("_b.miny") - F.col("_b.maxy")) / F.col("_last")
    return px.withColumns({"lon": lon, "lat": lat}).drop("_b", "_last")


def valid_pixels(pixels: Column, mask: Column) -> Column:
    """Pixels whose mask says valid, all of them if none is; NULL pixels are dropped."""
    pairs = F.arrays_zip(pixels.alias("p"), mask.alias("m"))
    kept = F.transform(F.filter(pairs, lambda s: s["m"] & s["p"].isNotNull()), lambda s: s["p"])
    return F.when(F.size(kept) > 0, kept).otherwise(F.filter(pixels, lambda p: p.isNotNull()))


def pixel_stats(pixels: Column, mask: Column) -> dict[str, Column]:
    """min, max and mean of an observation's valid pixels as its statistics define them."""
    return stats_of(valid_pixels(pixels, mask))


def stats_of(v: Column) -> dict[str, Column]:
    """The same of pixels that are chosen already."""
    total = F.aggregate(v, F.lit(0).cast("long"), lambda a, p: a + p)
    return {"min_value": F.array_min(v).cast("float"), "max_value": F.array_max(v).cast("float"), "mean_value": F.when(F.size(v) > 0, F.try_divide(total.cast("double"), F.size(v).cast("double"))).cast("float")}


def mask_nodata(pixels: Column, nodata: Column) -> Column:
    """True where a pixel holds data; all true if there is no nodata value."""
    return F.transform(pixels, lambda p: F.coalesce(p != nodata, p.isNotNull()))


def keep_clear(pixels: Column, quality: Column, clear_values: list[int]) -> Column:
    """Pixels with NULL where the quality band does not hold one of the clear values."""
    return F.zip_with(pixels, quality, lambda p, q: F.when(q.isin(clear_values), p))


def latest_delivery(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of several deliveries of a reading the last one: the largest (ingestion_time, obs_id); NULL times come first."""
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(F.coalesce(F.col("ingestion_time"), F.lit("1900-01-01").cast("timestamp")), F.col("obs_id")))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def band_arrays(df: DataFrame, bands: list[str], keys: list[str]) -> DataFrame:
    """One row per group with the pixel array of each band in a column of its name: bands are aligned by one grouped
    pass, not by joining. A band delivered twice is taken from its largest obs_id; a missing band is NULL."""
    pick = [F.max_by(F.when(F.col("band") == b, F.col("pixels")), F.when(F.col("band") == b, F.col("obs_id"))).alias(b) for b in bands]
    return df.where(F.col("band").isin(bands)).groupBy(*keys).agg(*pick)


def tile_month_rollup(df: DataFrame) -> DataFrame:
    """Catalogue rows per tile, month and band: number of observations, extremes, mean of means (unweighted, as
    catalogues define it), mean cloud cover, smallest product and resolution, and the first bounds by time. NULL and NaN are
    skipped; 0 if nothing is left."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy("tile_id", "year_month", "band").agg(
        F.count(F.lit(1)).alias("num_observations"),
        zero(F.min(clean("min_value"))).alias("min_value"),
        zero(F.max(clean("max_value"))).alias("max_value"),
        zero(F.avg(clean("mean_value"))).alias("mean_value"),
        zero(F.avg(clean("cloud_cover"))).alias("cloud_cover"),
        F.min("product_id").alias("product_id"),
        F.min("resolution").cast("double").alias("resolution"),
        *([_first("bounds_wkb", [c for c in ("time", "obs_id") if c in df.columns])] if "bounds_wkb" in df.columns else []),
    )


def _first(name: str, order: list[str]) -> Column:
    """The first value that is none of NULL."""
    some = F.col(name).isNotNull()
    return F.min_by(F.when(some, F.col(name)), F.when(some, F.struct(*order))).alias(name)


def tile_band_statistics(rollup: DataFrame) -> DataFrame:
    """Second level: statistics of a tile and band over its months."""
    return rollup.groupBy("tile_id", "band").agg(
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.avg("mean_value").alias("mean_value"),
        F.avg("cloud_cover").alias("cloud_cover"),
        F.sum("num_observations").alias("num_observations"),
    )


def weighted_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over all valid pixels, next to the catalogue's mean of means."""
    v = valid_pixels(F.col("pixels"), F.col("mask"))
    rows = df.select(*keys, F.size(v).cast("long").alias("n"), F.aggregate(v, F.lit(0).cast("long"), lambda a, p: a + p).alias("s"))
    return rows.where(F.col("n") > 0).groupBy(*keys).agg(F.sum("n").alias("n_pixels"), F.sum("s").alias("pixel_sum"))
