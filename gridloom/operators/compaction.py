"""Consolidation of many small chunk files into few well-sized ones.

Method: sorted-run consolidation, an external merge in two passes. In the first, where
the records lie, a task puts the small files it holds together to sorted runs of up to
``RUN_ROWS`` records; copies that meet in a run are marked there. The runs are then
distributed by key range (tile, month, band, time, content), and in the second pass
every range merges its runs k ways: all records of a range come out in key order, copies
side by side, the smallest row_id first. Nothing is dropped by a merge: copies are marked
as surplus and told apart from the kept records afterwards. Outputs roll over by the
bytes written, and the range metadata of every output file are written anew.

A hot chunk is cut by time and content, as both belong to the range key. Of a record
with very many copies one per run reaches its range; the others are marked already and
are spread by row_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.joins import null_safe_join
from gridloom.functions.tiles import canonical

KEY = ["tile_id", "year_month", "band"]
#: Records of a run at most; about 20 MB of them are held at once.
RUN_ROWS = 100_000
#: Records of a batch that is written; the size of a file is looked at between batches.
WRITE_ROWS = 4_096


def with_path_key(df: DataFrame, path: str = "chunk_path") -> DataFrame:
    """Adds tile_id, year_month and band that a chunk path names, whatever the layout: ``tiles/x.._y../YYYY-MM/band-hash.arrow``,
    ``tile_id=../band=../year_month=../part-..``, other prefixes, separators, case, short months or a ``.tmp`` end.
    A part that the path does not name is NULL. Columns of these names are replaced.

    Done in steps, so that every pattern is matched once a row: Spark keeps projections apart whose merging would repeat
    costly expressions."""
    p = F.col("_p")
    pick = lambda pattern: F.regexp_extract(p, pattern, 1)
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    month = F.substring_index("_m", "-", -1)
    return (
        df.withColumn("_p", F.lower(F.regexp_replace(path, r"[/\\]+", "/")))
        .withColumns(
            {
                "_t": pick(r"(?:^|[/=])(x[+-]?\d{1,9}_y[+-]?\d{1,9})(?=$|/)"),
                "_m": pick(r"(?:^|[/=])(\d{4}-\d{1,2})(?=/)"),
                "_b": F.when(p.contains("/band="), pick(r"/band=([^/]+)")).otherwise(pick(r"/([a-z][a-z0-9]*(?:_[0-9]{1,2})?)[-_.][0-9a-f]{4,}\.arrow(?:\.tmp)?$")),
            }
        )
        .withColumns({"tile_id": canonical("_t"), "year_month": F.when(F.col("_m") != "", F.concat(F.substring("_m", 1, 5), F.lpad(month, 2, "0"))), "band": full("_b")})
        .drop("_p", "_t", "_m", "_b")
    )


#: The order of records in a run. ``row_id`` breaks ties of copies.
ORDER = [*KEY, "stray", "time", "d1", "d2", "row_id"]


def _digests() -> list[Column]:
    """128 bits for the content of a record; equal contents only have equal digests. NULLs leave no trace in a hash, so
    arrays with holes are hashed as text too."""
    holes = F.coalesce(*[F.when(F.exists(c, lambda v: v.isNull()), F.to_json(F.array("pixels", F.transform("mask", lambda m: m.cast("int"))))) for c in ("pixels", "mask")], F.lit(""))
    size = lambda c: F.coalesce(F.size(c), F.lit(-1))
    return [F.xxhash64(F.lit(k), size("pixels"), "pixels", size("mask"), "mask", holes).alias(f"d{k}") for k in (1, 2)]


def keyed_records(chunk_rows: DataFrame) -> DataFrame:
    """The records with what their paths name and a digest of their content. ``stray`` is NULL where the path names
    tile, month and band, and the path itself where it does not."""
    named = with_path_key(chunk_rows.select("chunk_path", "row_id", "time", "pixels", "mask"))
    complete = F.col("tile_id").isNotNull() & F.col("year_month").isNotNull() & F.col("band").isNotNull()
    stray = F.when(~complete, F.coalesce("chunk_path", F.lit("")))
    return named.select(*KEY, stray.alias("stray"), "chunk_path", "row_id", "time", "pixels", "mask", *_digests())


def _ranks(tab: pa.Table) -> np.ndarray:
    """The order columns as numbers that compare alike, NULL first; one row per record."""
    out = []
    for c in ORDER:
        column = tab.column(c)
        if pa.types.is_string(column.type):
            coded = column.combine_chunks().dictionary_encode()
            words = coded.dictionary.to_pylist()
            rank = np.empty(len(words) + 1, np.int64)
            rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            rank[-1] = -1
            out.append(rank[coded.indices.fill_null(len(words)).to_numpy()])
        else:
            least = np.iinfo(np.int64).min
            ints = column.cast(pa.int64()) if not pa.types.is_int64(column.type) else column
            out.append(ints.fill_null(least).to_numpy())
    return np.stack(out, axis=1) if tab.num_rows else np.empty((0, len(ORDER)), np.int64)


def _copies(ranks: np.ndarray) -> np.ndarray:
    """Of records in order those that equal the one before in all but row_id."""
    copy = np.zeros(len(ranks), bool)
    copy[1:] = (ranks[1:, :-1] == ranks[:-1, :-1]).all(axis=1)
    return copy


def _form_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the records of a task, numbered, with the copies within a run marked."""
    part, number, held = TaskContext.get().partitionId(), 0, []

    def run() -> Iterator[pa.RecordBatch]:
        tab = pa.Table.from_batches(held)
        ranks = _ranks(tab)
        order = np.lexsort(ranks.T[::-1])
        sorted_tab = tab.take(pa.array(order)).append_column("surplus", pa.array(_copies(ranks[order])))
        yield from sorted_tab.append_column("run", pa.array(np.full(len(order), (part << 24) + number, np.int64))).combine_chunks().to_batches(WRITE_ROWS)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= RUN_ROWS:
            yield from run()
            number, held = number + 1, []
    if held:
        yield from run()


def merge_order(ranks: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Positions of records in merged order: the runs, each in order, are merged k ways. A run that turns out not to be
    in order is sorted first."""
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.empty(0, int)
    rows = list(map(tuple, ranks.tolist()))
    runs = []
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(run)], strict=True):
        own = [(rows[k], k) for k in range(lo, hi)]
        if any(x > y for x, y in zip(own, own[1:])):
            own.sort()
        runs.append(own)
    return np.fromiter((k for _, k in heapq.merge(*runs)), np.int64, len(run))


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k-way merge of one key range; records marked before pass through. A range is held in memory while its runs
    are merged; its size is that of a shuffle partition."""
    held = []
    for batch in batches:
        marked = batch.column("surplus").to_numpy(zero_copy_only=False)
        if marked.any():
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(marked)).columns[:-1], names=batch.schema.names[:-1])
        if not marked.all():
            held.append(batch.filter(pa.array(~marked)))
    if held:
        tab = pa.Table.from_batches(held)
        ranks = _ranks(tab)
        order = merge_order(ranks, tab.column("run").to_numpy())
        out = tab.drop_columns(["run", "surplus"]).take(pa.array(order))
        for b in out.append_column("surplus", pa.array(_copies(ranks[order]))).combine_chunks().to_batches(WRITE_ROWS):
            yield pa.RecordBatch.from_arrays(b.columns, names=b.schema.names)


def merged_runs(chunk_rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Records of all files, in key order within each range, with ``surplus``: true for every record equal to one with a
    smaller row_id (of rows repeated with their row_id, for all but one).

    Two records are equal if their paths name the same tile, month and band and time, pixels and mask are equal, NULL
    being equal to NULL; contents are compared by 128 bits of digest. Where a path names no tile, month or band, the path
    itself stands for what is missing, so that records of unreadable paths never merge with those of other files.
    Columns: tile_id, year_month, band, stray, chunk_path, row_id, time, pixels, mask, d1, d2, surplus."""
    keyed = keyed_records(chunk_rows)
    marked = T.StructType([*keyed.schema.fields, T.StructField("surplus", T.BooleanType())])
    runs = keyed.mapInArrow(_form_runs, T.StructType([*marked.fields, T.StructField("run", T.LongType())]))
    kept = lambda c: F.when(~F.col("surplus"), F.col(c)).asc_nulls_first()
    # What is marked has no range of its own: it is spread by a hash of its row_id.
    content = F.when(F.col("surplus"), F.xxhash64("row_id")).otherwise(F.col("d1"))
    ranges = [*[kept(c) for c in (*KEY, "stray", "time")], content.asc()]
    return runs.repartitionByRange(*([partitions] if partitions else []), *ranges).mapInArrow(_merge_runs, marked)


def consolidated(chunk_rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """The records that are kept, in key order within each range."""
    return merged_runs(chunk_rows, partitions).where(~F.col("surplus")).drop("surplus", "d1", "d2", "stray")


def range_metadata(kept: DataFrame, *by: str) -> DataFrame:
    """One row per chunk (and ``by``): records, first and last time, source files, and the least, greatest and mean valid
    pixel; of a record without valid pixels all count, as in the statistics of observations."""
    px = F.coalesce("pixels", F.array().cast("array<int>"))
    valid = F.filter(F.transform(F.arrays_zip(px.alias("p"), F.coalesce("mask", F.array().cast("array<boolean>")).alias("m")), lambda s: F.when(s["m"], s["p"])), lambda p: p.isNotNull())
    values = F.when(F.size(valid) > 0, valid).otherwise(F.filter(px, lambda p: p.isNotNull()))
    measured = kept.withColumn("_v", values)
    return measured.groupBy(*by, *KEY).agg(
        F.count(F.lit(1)).alias("num_observations"),
        F.min("time").alias("min_time"),
        F.max("time").alias("max_time"),
        F.countDistinct("chunk_path").alias("source_files"),
        F.min(F.array_min("_v")).cast("double").alias("min_value"),
        F.max(F.array_max("_v")).cast("double").alias("max_value"),
        F.try_divide(F.sum(F.aggregate("_v", F.lit(0).cast("long"), lambda a, p: a + p)).cast("double"), F.sum(F.size("_v")).cast("double")).alias("mean_value"),
    )


WRITTEN = "out_file string, records bigint, file_bytes bigint"


def _writer(folder: str, target_bytes: int):
    """Writes the records of a task into files that are closed once ``target_bytes`` are written. A file is visible by
    its final name only when it is whole; what an attempt that failed has left is listed nowhere."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(f"{root}/data", recursive=True)
        name = lambda n: f"data/range-{context.partitionId():05d}-{n:05d}-{context.taskAttemptId()}.arrow"
        number, sink, out, records, done = 0, None, None, 0, []

        def close() -> None:
            nonlocal sink, out, records, number
            out.close()
            size = sink.tell()
            sink.close()
            store.move(f"{root}/{name(number)}.tmp", f"{root}/{name(number)}")
            done.append({"out_file": name(number), "records": records, "file_bytes": size})
            number, sink, out, records = number + 1, None, None, 0

        for batch in batches:
            for lo in range(0, batch.num_rows, WRITE_ROWS):
                piece = batch.slice(lo, WRITE_ROWS)
                if sink is None:
                    sink = store.open_output_stream(f"{root}/{name(number)}.tmp")
                    out = pa.ipc.new_file(sink, piece.schema)
                out.write_batch(piece)
                records += piece.num_rows
                if sink.tell() >= target_bytes:
                    close()
        if sink is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("out_file", pa.string()), ("records", pa.int64()), ("file_bytes", pa.int64())]))

    return write


def _read_files(folder: str, schema: T.StructType):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for name in batch.column("out_file").to_pylist():
                with store.open_input_file(f"{root}/{name}") as source:
                    reader = pa.ipc.open_file(source)
                    for k in range(reader.num_record_batches):
                        b = reader.get_batch(k)
                        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([name] * b.num_rows, pa.string())], names=[*b.schema.names, "out_file"])

    return read


RECORD = "tile_id string, year_month string, band string, chunk_path string, row_id bigint, time timestamp, pixels array<int>, mask array<boolean>"


def read_consolidated(spark, folder: str) -> DataFrame:
    """The records of the files that ``folder``/files lists, with out_file."""
    listed = spark.read.parquet(f"{folder}/files").select("out_file")
    return listed.repartition("out_file").mapInArrow(_read_files(folder, None), f"{RECORD}, out_file string")


def write_consolidated(chunk_rows: DataFrame, folder: str, target_bytes: int = 128 << 20, partitions: int | None = None, catalogue: DataFrame | None = None) -> DataFrame:
    """Write the consolidated files under ``folder``/data, the list of them under ``folder``/files and their range metadata
    under ``folder``/metadata; returns the metadata read back. ``folder`` is one that all executors share. With a
    ``catalogue`` the metadata have its columns too (see renewed_catalogue)."""
    spark = chunk_rows.sparkSession
    consolidated(chunk_rows, partitions).mapInArrow(_writer(folder, target_bytes), WRITTEN).write.mode("overwrite").parquet(f"{folder}/files")
    files = spark.read.parquet(f"{folder}/files")
    per = range_metadata(read_consolidated(spark, folder), "out_file").join(files.select("out_file", "file_bytes"), "out_file")
    (per if catalogue is None else renewed_catalogue(per, catalogue)).write.mode("overwrite").parquet(f"{folder}/metadata")
    return spark.read.parquet(f"{folder}/metadata")


def renewed_catalogue(metadata: DataFrame, tile_metadata: DataFrame) -> DataFrame:
    """Range metadata with what only the old catalogue knows of a chunk: bounds, cloud_cover (mean of its entries),
    product_id and resolution (least of its entries). Chunks are matched by canonical tile, month and band as their paths
    name them, so that other spellings and stale entries do not matter; NULL where the catalogue has no entry."""
    old = with_path_key(tile_metadata.select("chunk_path", "bounds", "cloud_cover", "product_id", F.col("resolution").cast("double")))
    known = old.groupBy(*KEY).agg(F.min("bounds").alias("bounds"), F.avg("cloud_cover").alias("cloud_cover"), F.min("product_id").alias("product_id"), F.min("resolution").alias("resolution"))
    return null_safe_join(metadata, known, KEY, "left")


def catalogue_drift(tile_metadata: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """Listed files against those that hold records: chunk_path, listed, held, state (stale, empty, unlisted, repeated,
    right). Paths are compared as written. ``listed`` is the number of records the catalogue gives, its smallest if a
    path is listed more than once."""
    held = chunk_rows.where(F.col("chunk_path").isNotNull()).groupBy("chunk_path").agg(F.count(F.lit(1)).alias("held"))
    listed = (
        tile_metadata.where(F.col("chunk_path").isNotNull())
        .groupBy("chunk_path")
        .agg(F.min("num_observations").alias("listed"), F.count(F.lit(1)).alias("entries"))
    )
    state = (
        F.when(F.col("entries").isNull(), "unlisted")
        .when(F.col("held").isNull(), "empty")
        .when(F.col("entries") > 1, "repeated")
        .when(F.col("listed").eqNullSafe(F.col("held")), "right")
        .otherwise("stale")
    )
    return listed.join(held, "chunk_path", "full").select("chunk_path", "listed", F.coalesce("held", F.lit(0)).alias("held"), state.alias("state"))


def surplus_records(chunk_rows: DataFrame) -> DataFrame:
    """row_id of every record that equals another with a smaller row_id."""
    return merged_runs(chunk_rows).where("surplus").select("row_id")
