"""Moving chunk files into a warehouse, and checking the move."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.tiles import canonical_or_self
from gridloom.operators.compaction import with_path_key
from gridloom.operators.observations import stats_of, valid_pixels
from gridloom.sources.chunks import count_rows, list_chunks, load_files
from gridloom.sources.files import store_of
from gridloom.warehouse import Warehouse


NAMED = "tile_id IS NOT NULL AND band IS NOT NULL AND year_month IS NOT NULL"
#: Folder levels of a store that chunk files are the first to fill: a folder a chunk would make a file of each again.
LEVELS = ["band", "year_month"]


@dataclass
class MigrationResult:
    chunks: int
    observations: int
    snapshot_id: int | None
    dry_run: bool


def chunk_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of all chunk files below a folder, with tile, month and band from the path. Files whose path names
    none of them are left out."""
    # The names are read before the files, once a file; the valid pixels are a step of their own, so that they are found once a row.
    rows = load_files(_keyed(list_chunks(spark, folder))).withColumn("_v", valid_pixels(F.col("pixels"), F.col("mask")))
    stats = stats_of(F.col("_v"))
    out = rows.select(
        "tile_id",
        "year_month",
        "band",
        "time",
        "pixels",
        "mask",
        F.coalesce(F.try_element_at("metadata", F.lit("product_id")), F.lit("default")).alias("product_id"),
        F.coalesce(F.try_element_at("metadata", F.lit("resolution")).try_cast("float"), F.lit(10.0)).cast("float").alias("resolution"),
        F.size("pixels").alias("num_pixels"),
        *[c.alias(n) for n, c in stats.items()],
        F.col("path").alias("source_file"),
        F.current_timestamp().alias("ingestion_time"),
    )
    return out.where(NAMED)


def _keyed(files: DataFrame) -> DataFrame:
    """With tile, month and band of each path, NULL where it does not name them."""
    hashed = F.concat(F.lit("/"), F.regexp_replace("path", r"([^/]+)\.arrow$", "$1-0000.arrow"))
    return with_path_key(files.withColumn("_hashed", hashed), "_hashed").drop("_hashed")


def with_catalogue(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Observations with product, resolution and cloud cover of their chunk's entry in a catalogue, where it has one; of
    several entries of a chunk the one that comes last by chunk_path stands."""
    key = ["tile_id", "year_month", "band"]
    facts = ["product_id", "resolution", "cloud_cover"]
    last = catalogue.withColumn("tile_id", canonical_or_self("tile_id")).groupBy(*key).agg(F.max_by(F.struct(*facts), "chunk_path").alias("_c"))
    joined = rows.join(last, key, "left")
    kinds = dict(rows.dtypes)
    known = {c: F.coalesce(F.col(f"_c.{c}").cast(kinds[c]), F.col(c)) if c in kinds else F.col(f"_c.{c}").cast("float") for c in facts}
    return joined.withColumns(known).drop("_c")


def migrate(spark: SparkSession, folder: str, warehouse: str, dry_run: bool = False, backup: str | None = None, progress: Callable[[str], None] = lambda _: None, batches: int = 1, catalogue: DataFrame | None = None) -> MigrationResult:
    """Take over everything below ``folder``, in one commit or in ``batches`` of chunk files; with ``dry_run`` only tell what
    it would be. ``backup``: copy the files first. ``catalogue``: what it says of a chunk goes with its rows. A batch that
    fails takes back those before it, and the error is raised. A migration tried again commits nothing twice."""
    rows = chunk_observations(spark, folder)
    rows = rows if catalogue is None else with_catalogue(rows, catalogue)
    found = count_rows(_keyed(list_chunks(spark, folder))).where(NAMED).where("rows > 0")
    counts = found.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()
    progress(f"{counts['c']} chunks, {counts['n']} observations")
    if dry_run:
        return MigrationResult(counts["c"], counts["n"], None, True)
    if backup:
        _copy(folder, backup)
        progress(f"copied to {backup}")
    store = Warehouse(spark, warehouse, partition_by=LEVELS)
    start, snapshot = store.current_snapshot_id(), None
    try:
        for k in range(batches):
            part = rows if batches == 1 else rows.where(F.pmod(F.xxhash64("source_file"), F.lit(batches)) == k)
            snapshot = store.append(part, f"migration of {folder}", batch=f"migration {folder} {k} of {batches}")
            progress(f"snapshot {snapshot}")
    except Exception:
        if store.current_snapshot_id() != start:
            store.rollback(start, f"migration of {folder} failed")
        raise
    return MigrationResult(counts["c"], counts["n"], snapshot, False)


def _copy(folder: str, target: str) -> None:
    """A copy of a folder on any store."""
    from pyarrow import fs

    (a, source), (b, there) = store_of(folder), store_of(target)
    fs.copy_files(source, there, source_filesystem=a, destination_filesystem=b)


def write_metadata(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Keep catalogue rows as Parquet: added to those there, or in their place. Another mode, or no row, raises ValueError."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode is append or overwrite, not {mode}")
    if rows.isEmpty():
        raise ValueError("no metadata to write")
    rows.write.mode(mode).option("compression", "zstd").parquet(path)


def verify(spark: SparkSession, folder: str, warehouse: str) -> DataFrame:
    """Chunks (tile, band, month) whose number of observations differs between files and warehouse; empty if all is there."""
    return chunk_counts_differ(chunk_observations(spark, folder), Warehouse(spark, warehouse).read())


def chunk_counts_differ(in_files: DataFrame, stored: DataFrame) -> DataFrame:
    """(tile_id, band, year_month, in_files, stored) of the chunks whose number of rows differs; 0 where one side has none."""
    key = ["tile_id", "band", "year_month"]
    sides = in_files.select(*key, F.lit(1).alias("f"), F.lit(0).alias("s")).unionByName(stored.select(*key, F.lit(0).alias("f"), F.lit(1).alias("s")))
    per = sides.groupBy(*key).agg(F.sum("f").alias("in_files"), F.sum("s").alias("stored"))
    return per.where(F.col("in_files") != F.col("stored"))
