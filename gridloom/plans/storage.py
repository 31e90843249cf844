"""Queries of the storage side: the observations go out into rasters, chunk files or a warehouse in the shared folder and come
back through the library's readers, so each has SQL over the table they came from."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import api, maintenance
from gridloom.functions import expr
from gridloom.ingest import ingest
from gridloom.operators import observations as ops
from gridloom.plans.reference import HOT, canonical_sql, obs
from gridloom.session import shared_folder
from gridloom.sources import chunks, cog
from gridloom.sources.files import store_of
from gridloom.warehouse import Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = canonical_sql(sql)
        return f

    return add


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


# rasters: the newest image of every tile, one GeoTIFF each
def _newest(df: DataFrame) -> DataFrame:
    last = df.groupBy("tile_id").agg(F.max("time").alias("time"))
    return df.join(last, ["tile_id", "time"]).groupBy("tile_id", "time", "band").agg(F.max_by("pixels", "obs_id").alias("pixels"))


def _rasters(spark: SparkSession, sf: str) -> str:
    folder = _folder(spark, "rasters/newest")
    api.export_geotiff(_newest(obs(spark, sf)), folder, dtype="uint32")
    return folder


_NEWEST = """WITH last AS (SELECT tile_id, max(time) AS time FROM observations GROUP BY 1),
newest AS (SELECT tile_id, time, band, arg_max(pixels, obs_id) AS pixels FROM observations JOIN last USING (tile_id, time) GROUP BY 1, 2, 3),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY tile_id ORDER BY band) AS INT) AS k FROM newest) """
_TILE = r"(x-?\d+_y-?\d+)_\d{8}T"


@query(_NEWEST + "SELECT tile_id, k AS band, CAST(list_sum(pixels) AS DOUBLE) AS total, CAST(pixels[6] AS DOUBLE) AS sixth FROM numbered")
def raster_blocks(spark, sf):
    """Written as GeoTIFFs and read as blocks by the ``cog`` source."""
    folder = _rasters(spark, sf)
    cog.register(spark)
    blocks = spark.read.format("cog").load(folder)
    return blocks.select(F.regexp_extract("path", _TILE, 1).alias("tile_id"), "band", F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("total"), F.get("pixels", F.lit(5)).alias("sixth"))


@query(_NEWEST + """, t AS (SELECT tile_id, count(*) AS n, CAST(regexp_extract(tile_id, '^x(-?[0-9]+)_', 1) AS INT) AS x, CAST(regexp_extract(tile_id, '_y(-?[0-9]+)$', 1) AS INT) AS y FROM numbered GROUP BY 1),
b AS (SELECT *, cos(radians((y + 0.5) * 2560.0 / 111319.49079327358)) * 111319.49079327358 AS s FROM t)
SELECT tile_id, 4 AS width, 4 AS height, CAST(n AS INT) AS band_count, round(x * 2560.0 / s, 6) AS minx, round((y + 1) * 2560.0 / 111319.49079327358, 6) AS maxy, 'EPSG:4326' AS crs FROM b""")
def raster_headers(spark, sf):
    heads = cog.headers(spark, _rasters(spark, sf))
    return heads.select(F.regexp_extract("path", _TILE, 1).alias("tile_id"), "width", "height", "band_count", F.round("minx", 6).alias("minx"), F.round("maxy", 6).alias("maxy"), "crs")


@query(_NEWEST + "SELECT tile_id, strftime(time AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, CAST(count(*) AS INT) AS bands FROM numbered GROUP BY 1, 2")
def scenes_ingested(spark, sf):
    """Rasters registered as scenes, date from the name, and listed."""
    store = _folder(spark, "stores")
    ingest(spark, _rasters(spark, sf), store)
    return api.scenes(spark, store).select(F.regexp_extract("source_file", _TILE, 1).alias("tile_id"), F.date_format("acquisition_time", "yyyy-MM-dd").alias("day"), F.size("band_names").alias("bands"))


@query(_NEWEST + """, p AS (SELECT k, date_trunc('day', time AT TIME ZONE 'UTC') AS day, unnest(pixels) AS v FROM numbered)
SELECT 'band_' || k AS band, strftime(day, '%Y-%m-%d') AS day, CAST(sum(v) AS DOUBLE) / count(v) AS value FROM p GROUP BY 1, 2""")
def scenes_opened(spark, sf):
    """The registered rasters opened as one cube and reduced."""
    store = _folder(spark, "stores")
    ingest(spark, _rasters(spark, sf), store)
    return api.open_scenes(spark, store).reduce("mean", ["y", "x"]).df.select("band", F.date_format("time", "yyyy-MM-dd").alias("day"), "value")


# chunk files: one per tile, first month of a quarter and band
def _chunks(spark: SparkSession, sf: str) -> str:
    """Chunk files hold 16-bit pixels: greater ones are cut to the greatest."""
    folder = _folder(spark, "chunks")
    df = obs(spark, sf).select("tile_id", "band", expr.year_month(F.date_trunc("quarter", "time")).alias("month"), "time", F.transform("pixels", lambda p: F.least(p, F.lit(65535))).alias("pixels"), "mask")

    root, key = store_of(folder)[1], ["tile_id", "month", "band"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """Rows of each chunk: a run of the sorted rows, which may go on in the next batch."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            codes = [rows[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in key]
            starts = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1)]
            yield from cut(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1])
        if held is not None:
            yield from cut(held, [0])

    def cut(rows: pa.Table, starts: list[int]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        if not starts:
            return
        names = zip(*(rows[c].take(pa.array(starts)).to_pylist() for c in key), strict=True)
        whole = rows.select(chunks.SCHEMA.names).cast(chunks.SCHEMA, safe=False).combine_chunks()
        data = whole.to_batches()[0]
        for name, a, b in zip(names, starts, [*starts[1:], rows.num_rows], strict=True):
            yield name, data.slice(a, b - a)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, n = None, 0
        for (tile, month, band), rows in runs(batches):
            if there != (there := f"{root}/{tile}/{month}"):
                os.makedirs(there, exist_ok=True)
            chunks.write_rows(f"{there}/{band}.arrow", rows, "p", 10.0)
            n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    df.repartition(*key).sortWithinPartitions(*key).mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()
    return folder


_CHUNKS = """WITH c AS (SELECT tile_id, band, strftime(date_trunc('quarter', time AT TIME ZONE 'UTC'), '%Y-%m') AS year_month, list_transform(pixels, lambda p: least(p, 65535)) AS pixels, mask FROM observations),
m AS (SELECT *, list_filter(list_zip(pixels, mask), lambda s: s[2]) AS ok FROM c), v AS (SELECT *, CASE WHEN len(ok) > 0 THEN list_transform(ok, lambda s: s[1]) ELSE pixels END AS v FROM m) """


@query(_CHUNKS + "SELECT tile_id || '/' || year_month || '/' || band AS chunk, count(*) AS n, CAST(sum(list_sum(pixels)) AS BIGINT) AS total, CAST(sum(len(list_filter(mask, lambda b: b))) AS BIGINT) AS valid FROM c GROUP BY 1")
def chunks_loaded(spark, sf):
    rows = chunks.load_chunks(spark, _chunks(spark, sf))
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p)
    return rows.groupBy(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)\.arrow$", 1).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"), F.sum(F.size(F.filter("mask", lambda b: b))).alias("valid"))


@query(_CHUNKS + "SELECT tile_id, band, year_month, count(*) AS num_observations, CAST(min(list_min(v)) AS DOUBLE) AS min_value, CAST(max(list_max(v)) AS DOUBLE) AS max_value, true AS listed FROM v GROUP BY 1, 2, 3")
def chunks_migrated(spark, sf):
    """Chunk files taken into a warehouse, and its catalogue rows with the files that hold them."""
    store = _folder(spark, "stores")
    maintenance.migrate(spark, _chunks(spark, sf), store)
    return api.metadata(spark, store).select("tile_id", "band", "year_month", "num_observations", "min_value", "max_value", (F.size("chunk_paths") > 0).alias("listed"))


# a warehouse of all observations
def _stored(spark: SparkSession, sf: str) -> str:
    path = _folder(spark, "stores")
    df = obs(spark, sf).withColumns({"year_month": expr.year_month(F.col("time")), "resolution": F.coalesce("resolution", F.lit(0.0))})
    Warehouse(spark, path, partition_by=["band", "year_month"]).append(df, "all")
    return path


@query(f"SELECT epoch_us(time) AS time_us, band, product_id, pixels[2 * 4 + 2 + 1] AS value, mask[2 * 4 + 2 + 1] AS valid FROM observations WHERE tile_id = '{HOT}'")
def timeseries_of_point(spark, sf):
    """The series at the middle of a tile, by position."""
    b = (148.82289385609283, 52.24889153330055, 148.8604659070537, 52.271888404574014)
    t = api.timeseries(spark, _stored(spark, sf), (b[0] + b[2]) / 2 + 1e-6, (b[1] + b[3]) / 2 - 1e-6)
    return t.select(F.unix_micros("time").alias("time_us"), "band", "product_id", "value", "valid")


@query("SELECT DISTINCT tile_id FROM observations WHERE strftime(time AT TIME ZONE 'UTC', '%Y-%m') BETWEEN '2024-01' AND '2024-03' AND product_id = 'meridian_sr'")
def tiles_listed(spark, sf):
    found = api.list_tiles(spark, _stored(spark, sf), months=("2024-01", "2024-03"), product_id="meridian_sr")
    return spark.createDataFrame([(t,) for t in found], "tile_id string")


@query(f"SELECT tile_id, band, epoch_us(time) AS time_us, CAST(i // 4 AS INT) AS y, CAST(i % 4 AS INT) AS x, CAST(value AS DOUBLE) AS value FROM (SELECT *, unnest(range(16)) AS i, unnest(pixels) AS value, unnest(mask) AS valid FROM observations WHERE tile_id = '{HOT}' AND band IN ('red', 'nir') AND strftime(time AT TIME ZONE 'UTC', '%Y-%m') = '2024-05') WHERE valid")
def dataset_opened(spark, sf):
    """A tile's cube by months and bands."""
    store = _stored(spark, sf)
    df = ops.in_months(api.observations(spark, store, [HOT]), "2024-05", "2024-05").where(F.col("band").isin("red", "nir"))
    return api.cube(df).df.select("tile_id", "band", F.unix_micros("time").alias("time_us"), "y", "x", "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
