"""The engine's entry points: open, list, query by place and time, indices.

Everything returned is lazy: a DataFrame of observations, or a Cube of pixels.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import QueryError
from gridloom.functions.raster import bilinear_column, nearest_column
from gridloom.functions.tiles import canonical_or_self, tile_bounds, tile_x, tile_y
from gridloom.operators import observations as ops
from gridloom.operators import spatial
from gridloom.operators.cube import Cube
from gridloom.products import ProductRegistry
from gridloom.schema import SCENES
from gridloom.warehouse import Warehouse

TimeRange = str | datetime | slice | tuple[datetime, datetime] | None
Box = tuple[float, float, float, float]
DIMS = ["tile_id", "band", "time", "y", "x"]


def _when(df: DataFrame, time: TimeRange) -> DataFrame:
    if time is None:
        return df
    if isinstance(time, tuple):
        # year_month is a partition level of the store, derived from time on write: its bounds prune folders.
        return ops.between_times(df, *time, prune=True)
    return ops.select_time(df, time)


def observations(spark: SparkSession, warehouse: str, tiles: list[str] | None = None, time: TimeRange = None, bands: list[str] | None = None, product_id: str | None = None, as_of: int | None = None) -> DataFrame:
    """Stored observations by tile, time, band and product, now or as of a snapshot. Unknown bands raise ValueError."""
    df = Warehouse(spark, warehouse).read(as_of)
    if tiles is not None:
        df = ops.in_tiles(df, tiles)
    if product_id is not None:
        df = df.where(F.col("product_id") == product_id)
    df = _when(df, time)
    return df if bands is None else ops.in_bands(df, bands)


def cube(df: DataFrame, masked: bool = True) -> Cube:
    """Pixels of observations as a cube (tile_id, band, time, y, x); masked pixels are missing cells."""
    px = ops.explode_pixels(df, ["tile_id", "band", "time"])
    return Cube.of(px.where("valid") if masked else px, DIMS)


def open_dataset(spark: SparkSession, warehouse: str, tile_id: str, time: TimeRange = None, bands: list[str] | None = None, as_of: int | None = None) -> Cube:
    return cube(observations(spark, warehouse, [tile_id], time, bands, as_of=as_of))


def open_mosaic(spark: SparkSession, warehouse: str, tile_ids: list[str], time: TimeRange = None, bands: list[str] | None = None) -> Cube:
    """Several tiles on one raster: y and x run from the north-western tile, all tiles having square arrays of one size."""
    df = observations(spark, warehouse, tile_ids, time, bands)
    side = F.rint(F.sqrt(F.size("pixels").cast("double"))).cast("int")
    px = ops.explode_pixels(df.select("*", tile_x("tile_id").alias("tx"), tile_y("tile_id").alias("ty"), side.alias("side")), ["band", "time", "tx", "ty", "side"]).where("valid")
    corner = df.agg(F.min(tile_x("tile_id")).alias("x0"), F.max(tile_y("tile_id")).alias("y1"))  # one row
    both = px.join(F.broadcast(corner))
    placed = both.select("band", "time", ((F.col("y1") - F.col("ty")) * F.col("side") + F.col("y")).alias("y"), ((F.col("tx") - F.col("x0")) * F.col("side") + F.col("x")).alias("x"), "value")
    return Cube.of(placed, ["band", "time", "y", "x"])


def timeseries(spark: SparkSession, warehouse: str, lon: float, lat: float, bands: list[str] | None = None, time: TimeRange = None, product_id: str | None = None, as_of: int | None = None) -> DataFrame:
    """time, band, product_id, value, valid of the pixel that holds a point, in order of time."""
    near = spatial.SpatialQuery().from_point(lon, lat)
    tiles = [r[0] for r in near.tiles(spark).select("tile_id").collect()]  # the few tiles that hold one point
    df = observations(spark, warehouse, tiles, time, bands, product_id, as_of)
    b = tile_bounds(tile_x("tile_id"), tile_y("tile_id"))
    side = ops.width_of(F.size("pixels"))
    clip = lambda c: F.greatest(F.lit(0), F.least(side - 1, F.floor(c * side).cast("int")))
    col = clip((F.lit(lon) - b["minx"]) / (b["maxx"] - b["minx"]))
    row = clip((b["maxy"] - F.lit(lat)) / (b["maxy"] - b["miny"]))
    at = row * side + col
    return df.select("time", "band", "product_id", F.get("pixels", at).alias("value"), F.get("mask", at).alias("valid")).orderBy("time", "band")


def query_by_bounds(spark: SparkSession, warehouse: str, box: Box, time: TimeRange = None, bands: list[str] | None = None, side: int | None = None) -> DataFrame:
    """Observations of the tiles that meet a box. ``side`` brings every product to arrays of one size: pixels bilinear,
    masks by nearest, so that products of different resolution can be compared cell by cell."""
    tiles = spatial.tiles_in_box(spark, box).select("tile_id")
    df = observations(spark, warehouse, None, time, bands)
    found = df.join(tiles, "tile_id", "left_semi")
    return fused(found, side) if side else found


def fused(df: DataFrame, side: int) -> DataFrame:
    """Pixels and masks of square arrays resampled to ``side`` x ``side``."""
    return df.withColumns({"pixels": bilinear_column(F.col("pixels"), side, side), "mask": nearest_column(F.col("mask"), side, side)})


def query_by_geometry(spark: SparkSession, warehouse: str, geojson, time: TimeRange = None, bands: list[str] | None = None) -> DataFrame:
    tiles = spatial.SpatialQuery().from_geojson(geojson).tiles(spark).select("tile_id")
    return observations(spark, warehouse, None, time, bands).join(tiles, "tile_id", "left_semi")


def list_tiles(spark: SparkSession, warehouse: str, box: Box | None = None, months: tuple[str, str] | None = None, product_id: str | None = None, as_of: int | None = None) -> list[str]:
    df = Warehouse(spark, warehouse).read(as_of)
    if months:
        df = ops.in_months(df, *months)
    if product_id is not None:
        df = df.where(F.col("product_id") == product_id)
    out = df.select(canonical_or_self("tile_id").alias("tile_id")).distinct()
    if box:
        out = out.join(spatial.tiles_in_box(spark, box).select("tile_id"), "tile_id", "left_semi")
    return [r[0] for r in out.orderBy("tile_id").collect()]


def list_bands(spark: SparkSession, warehouse: str, tile_id: str | None = None, product_id: str | None = None, as_of: int | None = None) -> list[str]:
    df = Warehouse(spark, warehouse).read(as_of)
    if tile_id is not None:
        df = ops.in_tiles(df, [tile_id])
    if product_id is not None:
        df = df.where(F.col("product_id") == product_id)
    return [r[0] for r in df.select("band").distinct().orderBy("band").collect()]


def statistics(spark: SparkSession, warehouse: str, tile_id: str, band: str, months: tuple[str, str] | None = None) -> dict:
    """Statistics of a tile and band over its months; an empty dict if it has none."""
    df = ops.in_tiles(Warehouse(spark, warehouse).read(), [tile_id]).where(F.col("band") == band)
    df = ops.in_months(df, *months) if months else df
    row = ops.tile_band_statistics(ops.tile_month_rollup(df)).first()
    return row.asDict() if row else {}


def chunk_paths(spark: SparkSession, warehouse: str, tile_id: str | None = None, band: str | None = None, months: tuple[str, str] | None = None, as_of: int | None = None) -> DataFrame:
    """(path, commit, tile_id, band, year_month) of the files that hold a tile, band or span of months."""
    df = Warehouse(spark, warehouse).holders("tile_id", "band", "year_month", as_of=as_of)
    df = ops.in_tiles(df, [tile_id]) if tile_id is not None else df
    df = df.where(F.col("band") == band) if band is not None else df
    return ops.in_months(df, *months) if months else df


def metadata(spark: SparkSession, warehouse: str, tiles: list[str] | None = None, bands: list[str] | None = None, months: tuple[str, str] | None = None, as_of: int | None = None) -> DataFrame:
    """Catalogue rows (see tile_month_rollup) with ``bounds`` of the tile and the ``chunk_paths`` that hold them."""
    df = Warehouse(spark, warehouse).read(as_of)
    df = ops.in_tiles(df, tiles) if tiles is not None else df
    df = df.where(F.col("band").isin(bands)) if bands is not None else df
    rows = ops.tile_month_rollup(ops.in_months(df, *months) if months else df)
    key = ["tile_id", "band", "year_month"]
    paths = chunk_paths(spark, warehouse, months=months, as_of=as_of).groupBy(*key).agg(F.sort_array(F.collect_list("path")).alias("chunk_paths"))
    return rows.join(paths, key, "left").withColumn("bounds", tile_bounds(tile_x("tile_id"), tile_y("tile_id")))


def export_geotiff(df: DataFrame, folder: str, dtype: str = "uint16") -> int:
    """Write observations as one GeoTIFF per tile and time, its bands in order of name, LZW in blocks of 256 or, of
    a smaller raster, of its own side, degrees by the
    tile's bounds; the number of rasters. Bands of one tile and time of different size, or tiles whose id cannot be read,
    raise."""
    from gridloom.sources import cog

    cog.register(df.sparkSession)
    bounds = tile_bounds(tile_x("tile_id"), tile_y("tile_id"))
    per = df.groupBy("tile_id", "time").agg(F.sort_array(F.collect_list(F.struct("band", "pixels"))).alias("b"))  # a few bands
    side = ops.width_of(F.size(F.col("b")[0]["pixels"]))
    rows = per.select(
        F.concat_ws("_", "tile_id", F.date_format("time", "yyyyMMdd'T'HHmmss")).alias("name"),
        (F.size(F.col("b")[0]["pixels"]) / side).cast("int").alias("height"),
        side.cast("int").alias("width"),
        F.transform("b", lambda s: s["pixels"].cast("array<double>")).alias("pixels"),
        *[bounds[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")],
    )
    counted = Observation()
    rows.observe(counted, F.count(F.lit(1)).alias("n")).write.format("cog").option("dtype", dtype).mode("append").save(folder)
    return counted.get["n"]


def scenes(spark: SparkSession, warehouse: str, time: tuple[datetime, datetime] | None = None, box: Box | None = None, product_id: str | None = None, as_of: int | None = None) -> DataFrame:
    """Registered scenes in order of time. A scene without bounds passes every box, one without time no time range."""
    return filter_scenes(Warehouse(spark, warehouse, SCENES, []).read(as_of), time, box, product_id)


def filter_scenes(df: DataFrame, time: tuple[datetime, datetime] | None = None, box: Box | None = None, product_id: str | None = None) -> DataFrame:
    """Scenes (acquisition_time, bounds, product_id) by time, box and product, in order of time."""
    if time:
        df = df.where(F.col("acquisition_time").between(*map(F.lit, time)))
    if box:
        hit = spatial.intersects_box(*[F.col(f"bounds.{c}") for c in ("minx", "miny", "maxx", "maxy")], box)
        df = df.where(F.col("bounds").isNull() | F.col("bounds.minx").isNull() | hit)
    if product_id is not None:
        df = df.where(F.col("product_id") == product_id)
    return df.orderBy(F.col("acquisition_time").asc_nulls_first())


def all_bands() -> Column:
    """Aggregate: the bands of all scenes, each once, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set("band_names"))))


def product_summary(scenes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per product the number of scenes, first and last time and all bands, with what its profile says; NULL without one."""
    per = scenes.groupBy("product_id").agg(F.count(F.lit(1)).alias("scenes"), F.min("acquisition_time").alias("first"), F.max("acquisition_time").alias("last"), all_bands().alias("bands"))
    return per.join(profiles, "product_id", "left")


def _cells(blocks: DataFrame, *keep: str, coordinates: bool = False) -> DataFrame:
    """One row per cell, by its position in the raster or by the coordinates of its centre in the raster's system."""
    px = blocks.select(*keep, "transform", "row", "col", "width", F.posexplode("pixels").alias("i", "value"))
    y, x = (F.col("row") + F.floor(F.col("i") / F.col("width"))).cast("int"), (F.col("col") + F.col("i") % F.col("width")).cast("int")
    if coordinates:
        t = lambda k: F.get("transform", F.lit(k))
        # Rounded, so that rasters of one grid whose corners are written with less than full precision meet.
        y, x = F.round(t(5) + (y + 0.5) * t(4), 7), F.round(t(2) + (x + 0.5) * t(0), 7)
    return px.select(*keep, y.alias("y"), x.alias("x"), "value")


def open_scenes(spark: SparkSession, warehouse: str, bands: list[str] | None = None, cloud_mask: ProductRegistry | None = None, coordinates: bool = False, **filters) -> Cube:
    """Cube (band, time, y, x) of registered scenes, read from their files by their full names. No scene raises QueryError.
    y and x are pixel positions of each scene's own raster or, with ``coordinates``, those of the cells' centres, on which
    scenes of different extent are aligned; missing cells are rows that are not there.

    ``cloud_mask``: profiles that say which band and values of a product's mask files mean clear. Cells that are not
    clear are NULL. Scenes without a mask file, or of a product without such a rule, stay as they are."""
    from gridloom.sources import cog

    found = scenes(spark, warehouse, **filters)
    if found.isEmpty():
        raise QueryError("no scene meets the query")
    facts = found.select(F.col("source_file").alias("path"), F.col("acquisition_time").alias("time"), "band_names", "product_id", "mask_source_file")
    named = cog.band_names_of(cog.blocks_of(facts).join(facts, "path"), F.col("band_names"))
    if bands is not None:
        named = named.where(F.col("band_name").isin(bands))
    cells = _cells(named.withColumn("band", F.col("band_name")), "band", "time", "product_id", "mask_source_file", coordinates=coordinates)
    if cloud_mask is not None:
        rules = cloud_mask.to_df(spark).where("cloud_mask IS NOT NULL").select("product_id", "cloud_mask.band_index", "cloud_mask.clear_values")
        masked = facts.where("mask_source_file IS NOT NULL").select(F.col("mask_source_file").alias("path"), "product_id").distinct().join(rules, "product_id")
        quality = cog.blocks_of(masked).join(masked, "path").where(F.col("band") == F.col("band_index"))
        seen = _cells(quality, "path", "clear_values", coordinates=coordinates)
        seen = seen.select(F.col("path").alias("mask_source_file"), "y", "x", F.array_contains("clear_values", F.col("value").cast("int")).alias("clear"))
        # A mask serves all bands of its scene: the join is on the pixel, not on the band.
        joined = cells.join(seen, ["mask_source_file", "y", "x"], "left")
        cells = joined.withColumn("value", F.when(F.coalesce("clear", F.lit(True)), F.col("value")))
    return Cube.of(cells, ["band", "time", "y", "x"])


def ndvi(c: Cube) -> Cube:
    return c.bandmath("(nir - red) / (nir + red)", ["nir", "red"])


def evi(c: Cube, gain: float = 2.5, c1: float = 6.0, c2: float = 7.5, soil: float = 1.0) -> Cube:
    return c.bandmath(f"{gain} * ((nir - red) / (nir + {c1} * red - {c2} * blue + {soil}))", ["nir", "red", "blue"])


def history(spark: SparkSession, warehouse: str) -> DataFrame:
    return Warehouse(spark, warehouse).history()
