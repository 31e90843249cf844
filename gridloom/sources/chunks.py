"""Chunk files: Arrow IPC files of one tile, month and band with string metadata."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.errors import ValidationError
from gridloom.sources.files import files_in, store_of, stretches

SCHEMA = pa.schema([("time", pa.timestamp("ms", "UTC")), ("pixels", pa.list_(pa.uint16())), ("mask", pa.list_(pa.bool_()))])
ROWS = "path string, time timestamp, pixels array<int>, mask array<boolean>, metadata map<string,string>"
READ = pa.schema([("time", pa.timestamp("us", "UTC")), ("pixels", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))])
#: Folders that a listing is divided into at least, parts that are work for one task, and rows of a batch.
LEAST_FOLDERS, PART, BATCH = 64, 500, 10_000


def write_chunk(path: str, data: dict, product_id: str, resolution: float, metadata: dict[str, str] | None = None) -> None:
    """Write time, pixels and mask, lists of equal length; the file appears whole or not at all."""
    if set(data) != {"time", "pixels", "mask"}:
        raise ValidationError(f"a chunk has time, pixels and mask, not {sorted(data)}")
    if len({len(v) for v in data.values()}) != 1:
        raise ValidationError("time, pixels and mask of different length")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    write_rows(path, pa.record_batch([pa.array(data[f.name], f.type) for f in SCHEMA], schema=SCHEMA), product_id, resolution, metadata)


def write_rows(path: str, rows: pa.RecordBatch, product_id: str, resolution: float, metadata: dict[str, str] | None = None) -> None:
    """The same of rows in SCHEMA, into a folder that is there."""
    meta = {"product_id": product_id, "resolution": str(resolution), "num_observations": str(rows.num_rows)} | (metadata or {})
    with pa.OSFile(path + ".tmp", "wb") as f, pa.ipc.new_file(f, SCHEMA.with_metadata(meta)) as w:
        w.write_batch(rows)
    os.replace(path + ".tmp", path)


def read_chunk(path: str) -> tuple[dict, dict[str, str]]:
    """(data, metadata) of a chunk file."""
    with pa.memory_map(path) as f:
        t = pa.ipc.open_file(f).read_all()
    return t.to_pydict(), read_metadata(path)


def read_metadata(path: str) -> dict[str, str]:
    """Metadata alone, from the schema message."""
    with pa.memory_map(path) as f:
        return {k.decode(): v.decode() for k, v in (pa.ipc.open_file(f).schema.metadata or {}).items()}


def append_chunk(path: str, data: dict, product_id: str, resolution: float, metadata: dict[str, str] | None = None) -> None:
    """Append to a chunk file, or write it if there is none. Metadata merges, newer values winning."""
    old: dict = {k: [] for k in SCHEMA.names}
    meta: dict[str, str] = {}
    if os.path.exists(path):
        old, meta = read_chunk(path)
    both = {k: [*old[k], *data[k]] for k in SCHEMA.names}
    meta = meta | (metadata or {}) | {"num_observations": str(len(both["time"])), "last_updated": datetime.now(UTC).isoformat()}
    write_chunk(path, both, product_id, resolution, meta)


def list_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of all chunk files below a folder. Tasks list stretches of it, so that each has many small files."""
    from gridloom.session import ship_package

    ship_package(spark)
    head, names = stretches(folder, LEAST_FOLDERS)
    tasks = max(4 * spark.sparkContext.defaultParallelism, len(names) // PART)
    parts = spark.createDataFrame([(n,) for n in names], "name string").repartition(min(tasks, max(len(names), 1)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(folder)[0]
        for batch in batches:
            for part in batch.column(0).to_pylist():
                names = files_in(store, part, "*.arrow")
                for k in range(0, len(names), BATCH):
                    yield pa.record_batch([pa.array([head + n for n in names[k : k + BATCH]], pa.string())], names=["path"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in found(batches):
            held.append(batch)
            if sum(map(len, held)) >= BATCH // 10:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return parts.mapInArrow(joined, "path string")


def _read(path: str) -> pa.Table | None:
    store, name = store_of(path)
    with store.open_input_file(name) as f:
        raw = f.read_buffer()
    try:
        return pa.ipc.open_file(raw).read_all()
    except pa.ArrowInvalid:
        return None


def load_files(files: DataFrame) -> DataFrame:
    """Rows of the chunk files that ``path`` names, with the other columns (strings); files that cannot be read give no rows."""
    others = [c for c in files.columns if c != "path"]

    def rows_of(tables: list[pa.Table], at: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        usual = all(t.schema.equals(SCHEMA) for t in tables)
        rows = pa.concat_tables(tables).cast(READ) if usual else pa.concat_tables([t.select(READ.names).replace_schema_metadata().cast(READ) for t in tables])
        k = pa.array(np.repeat(np.arange(len(tables)), [t.num_rows for t in tables]))
        meta = pa.array([[(a.decode(), b.decode()) for a, b in (t.schema.metadata or {}).items()] for t in tables], pa.map_(pa.string(), pa.string()))
        columns = [at.column("path").take(k), *rows.columns, meta.take(k), *[at.column(c).take(k) for c in others]]
        yield from pa.table(columns, names=["path", *READ.names, "metadata", *others]).combine_chunks().to_batches(BATCH)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, places, n = [], [], 0
            for k, path in enumerate(batch.column("path").to_pylist()):
                t = _read(path)
                if t is not None and t.num_rows:
                    tables.append(t)
                    places.append(k)
                    n += t.num_rows
                if n >= BATCH:
                    yield from rows_of(tables, batch.take(pa.array(places)))
                    tables, places, n = [], [], 0
            if n:
                yield from rows_of(tables, batch.take(pa.array(places)))

    return files.mapInArrow(parse, ROWS + "".join(f", {c} string" for c in others))


def load_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all chunk files below a folder; files that cannot be read give no rows."""
    return load_files(list_chunks(spark, folder))


def count_rows(files: DataFrame) -> DataFrame:
    """The rows of every chunk file that ``path`` names, as ``rows``, with the other columns (strings); 0 if it cannot be read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = map(_read, batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([0 if t is None else t.num_rows for t in tables], pa.int64())], names=[*batch.schema.names, "rows"])

    return files.mapInArrow(count, "".join(f"{c} string, " for c in files.columns) + "rows bigint")
