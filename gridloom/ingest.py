"""Taking rasters in: registering scenes without copying pixels, and cutting rasters into tiles."""

from __future__ import annotations

import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import IngestionError
from gridloom.functions.crs import degrees_to_utm
from gridloom.functions.expr import date_in_name, product_of_path
from gridloom.functions.raster import bilinear, nearest
from gridloom.functions.tiles import METRES_PER_DEGREE, TILE_METRES
from gridloom.operators.observations import pixel_stats
from gridloom.schema import OBSERVATIONS, SCENES
from gridloom.sources import cog, tiff
from gridloom.sources.files import opened
from gridloom.warehouse import Warehouse


@dataclass
class IngestResult:
    scene_count: int
    snapshot_id: int
    warehouse_path: str
    elapsed: float
    errors: list[str] = field(default_factory=list)


def with_first_mask(files: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """Files with mask_source_file, the first (by ``path``) of the masks equal in the keys; NULL meets nothing."""
    first = masks.where(F.col("path").isNotNull()).groupBy(*keys).agg(F.min("path").alias("mask_source_file"))
    return files.join(first, keys, "left")


def scene_table(spark: SparkSession, source: str, product_id: str | None = None, band_names: list[str] | None = None, date_pattern: str | None = None, pattern: str = "*.tif*", mask_path: str | None = None) -> DataFrame:
    """Scenes of all rasters below a folder, from their headers alone: date from the name, else the file's own time;
    product from the folder; band names from the header; the first mask file (by name) of the same date."""
    facts = cog.headers(spark, source, pattern, times=True).where("error IS NULL")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    day = date_in_name(name, date_pattern)
    rows = facts.withColumn("day", day)
    if mask_path:
        masks = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(mask_path).select("path")
        masks = masks.select(date_in_name(F.regexp_extract("path", r"([^/]+)$", 1), date_pattern).alias("day"), "path")
        rows = with_first_mask(rows, masks, ["day"])
    else:
        rows = rows.withColumn("mask_source_file", F.lit(None).cast("string"))
    at = F.coalesce(F.col("day").cast("timestamp"), F.col("modification_time"))
    names = F.array(*map(F.lit, band_names)) if band_names else F.col("band_names")
    # The id follows from the file, so that a repeated try registers the same scene.
    scene_id = F.concat(F.lit("scene_"), F.date_format(at, "yyyyMMdd"), F.lit("_"), F.substring(F.md5("path"), 1, 8))
    return rows.select(
        scene_id.alias("scene_id"),
        at.alias("acquisition_time"),
        (F.lit(product_id) if product_id else product_of_path(F.col("path"))).alias("product_id"),
        names.alias("band_names"),
        F.col("path").alias("source_file"),
        "crs",
        F.lit(None).cast("double").alias("cloud_cover"),
        "mask_source_file",
        F.struct("minx", "miny", "maxx", "maxy").alias("bounds"),
        F.array("band_count", "height", "width").alias("shape"),
    )


def ingest(spark: SparkSession, source: str, warehouse: str, **options) -> IngestResult:
    """Register all rasters below ``source`` in one commit. Files that are no rasters are listed under errors; scenes
    whose file is registered already are left out."""
    began = time.time()
    store = Warehouse(spark, warehouse, SCENES, [])
    pattern = options.get("pattern", "*.tif*")
    fresh = scene_table(spark, source, **options).join(store.read().select("source_file"), "source_file", "left_anti")
    snapshot, count = store.append_counted(fresh, f"ingest {source}")
    errors = [f"{r['path']}: {r['error']}" for r in cog.headers(spark, source, pattern).where("error IS NOT NULL").select("path", "error").collect()]
    return IngestResult(count, snapshot, warehouse, time.time() - began, errors)


def _window(h: tiff.Header, box: tuple[float, float, float, float]) -> tuple[int, int, int, int] | None:
    """Rows and columns (row, col, rows, cols) of a raster that a box in degrees covers; None if they are apart."""
    x0, y0, x1, y1 = box
    if h.epsg and h.epsg != 4326:
        lon, lat = np.array([x0, x1, x0, x1]), np.array([y0, y0, y1, y1])
        if h.epsg == 3857:
            xs, ys = np.radians(lon) * 6378137.0, np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * 6378137.0
        else:
            xs, ys = degrees_to_utm(lon, lat, np.full(4, h.epsg % 100), np.full(4, h.epsg > 32700))
        x0, x1, y0, y1 = xs.min(), xs.max(), ys.min(), ys.max()
    a, _, c, _, e, f = h.affine
    col0, col1 = sorted(((x0 - c) / a, (x1 - c) / a))
    row0, row1 = sorted(((y1 - f) / e, (y0 - f) / e))
    r0, r1, c0, c1 = int(np.floor(row0)), int(np.ceil(row1)), int(np.floor(col0)), int(np.ceil(col1))
    if r1 <= 0 or c1 <= 0 or r0 >= h.height or c0 >= h.width or r1 <= r0 or c1 <= c0:
        return None
    return max(r0, 0), max(c0, 0), min(r1, h.height) - max(r0, 0), min(c1, h.width) - max(c0, 0)


def tile_rows(spark: SparkSession, source: str, band_mapping: dict[int, str], pixels_per_tile: int | None = None, product_id: str = "default", acquired=None) -> DataFrame:
    """Observations cut from the rasters below a folder: for every tile that a raster touches and every mapped band the
    window is read, resampled (bilinear, the validity mask by nearest) and given its statistics. Tiles without a valid
    pixel are left out. The work is spread by raster and row of tiles, and a task reads only the blocks it needs."""
    scenes = scene_table(spark, source, product_id)
    spread = "tile_id string, band string, pixels array<int>, mask array<boolean>, source_file string, acquisition_time timestamp, resolution double, crs string, affine array<double>, bounds_wkb binary"

    def rows_of_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, at in zip(pdf["source_file"], pdf["acquisition_time"], strict=True):
                with opened(path) as raw:
                    h = tiff.read_header(raw)
                if h.bounds is None:
                    raise IngestionError(f"{path} has no place")
                box = cog.bounds_in_degrees(h.epsg, h.bounds)
                rows += [(path, at, y) for y in range(int(np.floor(box[1] * METRES_PER_DEGREE / TILE_METRES)), int(np.floor(box[3] * METRES_PER_DEGREE / TILE_METRES)) + 1)]
            yield pd.DataFrame(rows, columns=["source_file", "acquisition_time", "y"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, at, y in zip(pdf["source_file"], pdf["acquisition_time"], pdf["y"], strict=True):
                with opened(path) as raw:
                    h = tiff.read_header(raw)
                    box = cog.bounds_in_degrees(h.epsg, h.bounds)
                    metres = cog.metres_per_pixel(h.affine, h.epsg, h.bounds)
                    side = pixels_per_tile or int(np.ceil(TILE_METRES / metres))
                    rows = []
                    s, n = y * TILE_METRES / METRES_PER_DEGREE, (y + 1) * TILE_METRES / METRES_PER_DEGREE
                    shrink = METRES_PER_DEGREE * np.cos(np.radians((s + n) / 2))
                    for x in range(int(np.floor(box[0] * shrink / TILE_METRES)), int(np.floor(box[2] * shrink / TILE_METRES)) + 1):
                        tile = (x * TILE_METRES / shrink, s, (x + 1) * TILE_METRES / shrink, n)
                        win = _window(h, tile)
                        if win is None:
                            continue
                        for number, band in band_mapping.items():
                            a = tiff.read_window(raw, h, number, *win)
                            ok = np.ones(a.shape, bool) if h.nodata is None else a != h.nodata
                            mask = nearest(ok, side, side)
                            if mask.any():
                                px = bilinear(a.astype(float), side, side)
                                rows.append((_tile_name(x, y), band, px.ravel().tolist(), mask.ravel().tolist(), path, at, metres, f"EPSG:{h.epsg}" if h.epsg else None, list(h.affine), _box_wkb(*tile)))
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in spread.split(", ")])

    planned = scenes.select("source_file", "acquisition_time").mapInPandas(rows_of_tiles, "source_file string, acquisition_time timestamp, y int")
    raw = planned.repartition("source_file", "y").mapInPandas(cut, spread)
    stats = pixel_stats(F.col("pixels"), F.col("mask"))
    return raw.select(
        "tile_id",
        "band",
        F.date_format("acquisition_time", "yyyy-MM").alias("year_month"),
        F.col("acquisition_time").alias("time"),
        "pixels",
        "mask",
        F.lit(product_id).alias("product_id"),
        F.col("resolution").cast("float").alias("resolution"),
        F.size("pixels").alias("num_pixels"),
        *[c.alias(n) for n, c in stats.items()],
        "bounds_wkb",
        F.lit("EPSG:4326").alias("crs"),  # of the bounds, which are the tile's
        F.to_json("affine").alias("transform"),
        "source_file",
        F.current_timestamp().alias("ingestion_time"),
    )


def _box_wkb(x0: float, y0: float, x1: float, y1: float) -> bytes:
    """A box as a WKB polygon."""
    return struct.pack("<BIII10d", 1, 3, 1, 5, x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)


def _tile_name(x: int, y: int) -> str:
    part = lambda i: f"-{-i:04d}" if i < 0 else f"{i:04d}"
    return f"x{part(x)}_y{part(y)}"


def ingest_tiles(spark: SparkSession, source: str, warehouse: str, band_mapping: dict[int, str], **options) -> int:
    """Cut and store; the id of the one new snapshot."""
    return Warehouse(spark, warehouse, OBSERVATIONS).append(tile_rows(spark, source, band_mapping, **options), f"tiles of {source}", batch=options.get("batch") or uuid.uuid4().hex)


class Pending:
    """Metadata that is committed later, in one go."""

    def __init__(self, store: Warehouse):
        self.store, self.parts = store, []

    def add(self, rows: DataFrame) -> None:
        self.parts.append(rows)

    def flush(self, message: str = "deferred") -> int:
        if not self.parts:
            return self.store.current_snapshot_id()
        rows, self.parts = self.parts, []
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return self.store.append(out, message)
