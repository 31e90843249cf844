"""Rasters as a Spark source: spark.read.format("cog").load(path).

One input partition is a file and a stretch of its blocks; a block of a band is one
row. The options ``band``, ``rows`` and ``cols`` (``low:high``) leave all other blocks unread.
Files are read by ranges, on local disks and on stores named by a URI. Header facts of many files come from
``headers`` without reading more than the headers; ``blocks_of`` reads rasters named in a
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridloom.functions.crs import to_degrees
from gridloom.sources import tiff
from gridloom.sources.files import listed, opened, store_of

SCHEMA = "path string, band int, row int, col int, height int, width int, pixels array<double>"
HEADER = "path string, crs string, minx double, miny double, maxx double, maxy double, width int, height int, band_count int, dtype string, resolution double, nodata double, driver string, band_names array<string>, transform array<double>, error string"
BLOCKS = f"{SCHEMA}, transform array<double>"
#: Bytes of a raster that are work for one task.
PART_BYTES = 16 << 20
#: Rows or pixels of blocks that go on as one batch.
BATCH_ROWS, BATCH_PIXELS = 2000, 1 << 17


class _Part(InputPartition):
    """The ``index``-th of ``count`` equal stretches of a file's blocks."""

    def __init__(self, path: str, index: int, count: int):
        self.path, self.index, self.count = path, index, count


def _span(text: str | None) -> tuple[int, float]:
    """``low:high`` as numbers, either left out for no bound; high is exclusive."""
    low, _, high = (text or ":").partition(":")
    return int(low or 0), int(high) if high else math.inf


class CogReader(DataSourceReader):
    """Plans by the names and sizes of files; headers and blocks are read by ranges where the work is done.

    What is not wanted is named by options, not by filters pushed down: this version of Spark keeps the filters of a
    query for every later one over the same DataFrame."""

    def __init__(self, path: str, options: dict):
        self.path, self.band = path, int(options["band"]) if "band" in options else None
        self.part_bytes = int(options.get("bytes", PART_BYTES))
        self.pattern = options.get("glob", "**/*.tif*")
        self.rows, self.cols = _span(options.get("rows")), _span(options.get("cols"))

    def partitions(self):
        out = []
        for f, size in listed(self.path, self.pattern):
            n = max(1, -(-size // self.part_bytes))
            out += [_Part(f, k, n) for k in range(n)]
        return out or [_Part("", 0, 0)]

    def _wanted(self, row: int, col: int, height: int, width: int) -> bool:
        return row < self.rows[1] and row + height > self.rows[0] and col < self.cols[1] and col + width > self.cols[0]

    def read(self, part: _Part):
        if part.path:
            with opened(part.path) as raw:
                h = tiff.read_header(raw)
                n = len(tiff.blocks(h))
                yield from _block_rows(part.path, raw, h, n * part.index // part.count, n * (part.index + 1) // part.count, self.band, self._wanted)


def _block_rows(path: str, raw, h: tiff.Header, first: int, end: int, only: int | None = None, wanted=lambda *block: True) -> Iterator[tuple]:
    """Rows of the source for a stretch of a raster's blocks; blocks that are not wanted are not read."""
    for number, plane, row, col in tiff.blocks(h)[first:end]:
        if (plane >= 0 and only not in (None, plane + 1)) or not wanted(row, col, *h.block):
            continue
        a = tiff.read_block(raw, h, number)
        for k in range(a.shape[2]):
            band = plane + 1 if plane >= 0 else k + 1
            if only in (None, band):
                yield path, band, row, col, a.shape[0], a.shape[1], a[:, :, k].astype(float).ravel().tolist()


def blocks_of(files: DataFrame, path: str = "path", bytes_per_part: int = PART_BYTES) -> DataFrame:
    """Blocks of the rasters that a column names, with the raster's affine transform; paths come out as they are given.
    Headers are read first, and stretches of blocks are then spread over tasks, so that one large raster is work for many."""
    from gridloom.session import ship_package

    ship_package(files.sparkSession)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name in pdf["path"]:
                with opened(name) as raw:
                    n, parts = len(tiff.blocks(tiff.read_header(raw))), max(1, -(-len(raw) // bytes_per_part))
                rows += [(name, n * k // parts, n * (k + 1) // parts) for k in range(parts)]
            yield pd.DataFrame(rows, columns=["path", "first", "end"])

    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def joined(held: list[tuple]) -> pa.RecordBatch:
        """Images of blocks (bands, rows, columns) with what goes before and after them, one row a band."""
        ends = np.cumsum([0, *[a.shape[1] * a.shape[2] for *_, a in held for _ in range(len(a))]], dtype=np.int64)
        px = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([a.astype(float).ravel() for *_, a in held])))
        per = [(name, band + k, row, col, *a.shape[1:], affine) for name, band, row, col, affine, a in held for k in range(len(a))]
        columns = [pa.array(c, t) for c, t in zip(zip(*per, strict=True), (pa.string(), *[pa.int32()] * 5, pa.list_(pa.float64())), strict=True)]
        return pa.RecordBatch.from_arrays([*columns[:6], px, columns[6]], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0  # small blocks go on together
        for batch in batches:
            for name, first, end in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "end")), strict=True):
                with opened(name) as raw:
                    h = tiff.read_header(raw)
                    affine = list(h.affine) if h.affine else None
                    for number, plane, row, col in tiff.blocks(h)[first:end]:
                        a = np.moveaxis(tiff.read_block(raw, h, number), 2, 0)
                        held.append((name, max(plane, 0) + 1, row, col, affine, a))
                        rows, size = rows + len(a), size + a.size
                        if rows >= BATCH_ROWS or size >= BATCH_PIXELS:
                            yield joined(held)
                            held, rows, size = [], 0, 0
        if held:
            yield joined(held)

    stretches = files.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct().mapInPandas(plan, "path string, first int, end int")
    return stretches.repartition("path", "first").mapInArrow(read, BLOCKS)


def _block(height: int, width: int) -> int:
    """Side of a raster's blocks: 256 or, of a smaller one, its own, in steps of 16 as the format wants them."""
    return min(256, -(-max(height, width, 1) // 16) * 16)


class CogWriter(DataSourceWriter):
    """Writes rows (name, height, width, pixels array<array<double>> by band) as one GeoTIFF each."""

    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.dtype = options.get("dtype", "uint16")
        self.epsg = int(options.get("epsg", 4326))

    def write(self, rows):
        store, folder = store_of(self.folder)
        store.create_dir(folder, recursive=True)
        n = 0
        for r in rows:
            a = np.array(r["pixels"], float).reshape(len(r["pixels"]), r["height"], r["width"]).astype(self.dtype)
            bounds = (r["minx"], r["miny"], r["maxx"], r["maxy"])
            if any(v is None for v in bounds):
                raise ValueError("a raster without bounds")
            target = f"{folder}/{r['name']}.tif"
            with store.open_output_stream(target + ".part") as out:
                out.write(tiff.write(a, bounds, self.epsg, tile=_block(*a.shape[1:])))
            store.move(target + ".part", target)  # whole or not at all, however often a task runs
            n += 1
        message = WriterCommitMessage()
        message.count = n
        return message


class CogSource(DataSource):
    @classmethod
    def name(cls):
        return "cog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CogReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite):
        return CogWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    from gridloom.session import ship_package

    ship_package(spark)
    spark.dataSource.register(CogSource)


def metres_per_pixel(affine, code: int | None, bounds) -> float | None:
    """Mean size of a pixel in metres: as it is for projected systems, by 111,320 m a degree for degrees, the x side by
    the cosine of the middle latitude."""
    if affine is None:
        return None
    a, e = abs(affine[0]), abs(affine[4])
    if code != 4326:
        return (a + e) / 2
    mid = math.radians((bounds[1] + bounds[3]) / 2)
    return (a * 111320 * math.cos(mid) + e * 111320) / 2


def header_row(path: str, raw: bytes) -> tuple:
    try:
        h = tiff.read_header(raw)
    except tiff.TiffError as e:
        return (path, *[None] * 14, str(e))
    names = h.descriptions or [f"band_{i + 1}" for i in range(h.bands)]
    b = h.bounds or (None,) * 4
    crs = f"EPSG:{h.epsg}" if h.epsg else None
    return path, crs, *b, h.width, h.height, h.bands, h.dtype, metres_per_pixel(h.affine, h.epsg, b), h.nodata, "GTiff", names, list(h.affine) if h.affine else None, None


def headers(spark: SparkSession, path: str, pattern: str = "*.tif*", times: bool = False) -> DataFrame:
    """One row per raster file below a folder, with ``times`` its ``modification_time`` too. A file that is none has its
    reason in ``error`` and NULL elsewhere."""
    from gridloom.session import ship_package

    ship_package(spark)
    # Without a wish for the content only names are listed.
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    # Spark makes a task of every few files: together they are as many as there are cores to read headers.
    files = files.coalesce(4 * spark.sparkContext.defaultParallelism)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in HEADER.split(", ")]
        for pdf in batches:
            rows = []
            for name in pdf["path"]:
                with opened(name) as raw:
                    rows.append(header_row(name, raw))
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(modification_time=pdf["modificationTime"]) if times else out

    return files.mapInPandas(parse, HEADER + ", modification_time timestamp" * times)


def bounds_in_degrees(code: int | None, bounds: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """Bounds in degrees; without a system they stay as they are."""
    if code is None or code == 4326:
        return bounds
    xs, ys = np.array([bounds[0], bounds[2], bounds[0], bounds[2]]), np.array([bounds[1], bounds[1], bounds[3], bounds[3]])
    lon, lat = to_degrees(np.full(4, code), xs, ys)
    return float(lon.min()), float(lat.min()), float(lon.max()), float(lat.max())


def band_names_of(blocks: DataFrame, names: Column) -> DataFrame:
    """Blocks with ``band_name`` from an array of names in band order, the number's own name where there is none."""
    return blocks.withColumn("band_name", F.coalesce(F.get(names, F.col("band") - 1), F.concat(F.lit("band_"), F.col("band").cast("string"))))
