"""Warehouse, rasters, chunk files, ingestion and streaming."""

import os
from datetime import UTC, datetime

import numpy as np
import pytest
from conftest import OBS, utc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom import cli, ingest
from gridloom.errors import QueryError, TransactionError, ValidationError
from gridloom.schema import OBSERVATIONS, SCENES
from gridloom.sources import chunks, cog, files, sample, tiff
from gridloom.streaming import scenes as streams
from gridloom.warehouse import Warehouse


def batch(observations, n, **more):
    rows = [{"year_month": "2024-01", "resolution": 10.0, "num_pixels": 2, "pixels": [k, k + 1], **more} for k in range(n)]
    return observations(rows, extra=False)


def test_snapshots(spark, observations, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    assert w.current_snapshot_id() == 0 and w.read().count() == 0 and w.append(batch(observations, 0)) == 0
    a = w.append(batch(observations, 3), "first")
    b = w.append(batch(observations, 2, band="nir"), "second")
    assert a > 0 and a != b and w.current_snapshot_id() == b
    assert (w.read(a).count(), w.read().count()) == (3, 5)
    assert [r["message"] for r in w.history().collect()] == ["second", "first"]
    c = w.overwrite(batch(observations, 4, tile_id="x0009_y0009"))
    assert w.read().count() == 4 and w.read(b).count() == 5 and w.read(c).schema.names == OBSERVATIONS.names
    with pytest.raises(QueryError):
        w.read(12345)
    assert w.summary()["records"] == 4 and w.summary()["snapshots"] == 3


def test_partitions_are_pruned(spark, observations, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.append(batch(observations, 3).unionByName(batch(observations, 3, band="nir")))
    plan = w.read().where("band = 'nir' AND tile_id = 'x0001_y0001'").select("min_value")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" in plan and "ReadSchema: struct<min_value:float>" in plan


def test_overwrite_of_a_part(spark, observations, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.append(batch(observations, 3).unionByName(batch(observations, 3, band="nir")))
    w.overwrite(batch(observations, 1, band="nir"), F.col("band") == "nir")
    assert {(r["band"], r["count"]) for r in w.read().groupBy("band").count().collect()} == {("red", 3), ("nir", 1)}


def test_commits_do_not_lose_each_other(spark, observations, tmp_path):
    w, v = (Warehouse(spark, str(tmp_path / "w")) for _ in range(2))
    start = w.append(batch(observations, 1))
    files, rows = v._stage(batch(observations, 2))
    w.append(batch(observations, 1))
    v.commit("append", files, [], rows, "")  # an append finds the next number
    assert w.read().count() == 4
    with pytest.raises(TransactionError):
        v.commit("overwrite", [], files, 0, "", expected=start)
    once = w.append(batch(observations, 1), batch="b1")
    assert w.append(batch(observations, 1), batch="b1") == once and w.read().count() == 5


def test_upkeep(spark, observations, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    ids = [w.append(batch(observations, 1)) for _ in range(4)]
    w._stage(batch(observations, 2))  # never committed
    found = w.diagnose()
    assert len(found["orphans"]) >= 1 and not found["missing"]
    assert w.repair(dry_run=True) == found["orphans"] == w.repair() and w.diagnose()["orphans"] == []
    w.overwrite(batch(observations, 1))
    assert w.expire(retain_last=2, older_than_ms=-1000) == 3
    assert w.read().count() == 1 and w.read(ids[3]).count() == 4
    with pytest.raises(QueryError):
        w.read(ids[0])
    assert {r["suffix"] for r in w.stored_files().where("path LIKE 'data/%.parquet'").collect()} == {".parquet"}


def test_rules_on_write(spark, observations, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    with pytest.raises(ValidationError):
        w.append(spark.range(1))
    with pytest.raises(PySparkException):
        w.append(batch(observations, 1, mask=[True]))
    with pytest.raises(PySparkException):
        w.append(batch(observations, 1, product_id=None))
    assert OBS.count(",") > 10 and w.read().count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000) | st.integers(1, 9000).map(lambda n: b"ab" * n) | st.integers(0, 2**32).map(lambda s: np.random.default_rng(s).integers(0, 4, 9000).astype(np.uint8).tobytes()))
def test_lzw_round_trip(raw):
    assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "uint32", "float32"])
@pytest.mark.parametrize(("compression", "tile"), [(tiff.NONE, None), (tiff.DEFLATE, 16), (tiff.LZW, 32)])
def test_raster_round_trip(dtype, compression, tile):
    a = np.random.default_rng(1).integers(0, 200, (3, 37, 50)).astype(dtype)
    raw = tiff.write(a, (10.0, 20.0, 15.0, 23.7), 32652, nodata=0, names=["r", "g", "b"], compression=compression, tile=tile)
    h = tiff.read_header(raw)
    assert (h.width, h.height, h.bands, h.epsg, h.nodata, h.descriptions) == (50, 37, 3, 32652, 0.0, ["r", "g", "b"])
    assert np.allclose(h.bounds, (10.0, 20.0, 15.0, 23.7))
    for k in range(3):
        assert (tiff.read_window(raw, h, k + 1) == a[k]).all()
    assert (tiff.read_window(raw, h, 2, 10, 20, 9, 100) == a[1, 10:19, 20:]).all()
    with pytest.raises(IndexError):
        tiff.read_window(raw, h, 4)


def test_no_raster():
    for raw in (b"", b"II*\0", b"nothing at all", b"II*\0\x08\0\0\0\x05\0"):
        with pytest.raises(tiff.TiffError):
            tiff.read_header(raw)


def test_sample_and_source(spark, tmp_path):
    made = sample.create_sample_data(str(tmp_path / "a/prod"))
    assert [open(f, "rb").read() for f in made] == [open(f, "rb").read() for f in sample.create_sample_data(str(tmp_path / "b"))]
    cog.register(spark)
    df = spark.read.format("cog").option("bytes", os.path.getsize(made[0]) // 2 + 1).load(made[0])
    assert df.rdd.getNumPartitions() == 2
    whole = {(r["band"], r["row"], r["col"]): r["pixels"] for r in df.collect()}
    part = spark.read.format("cog").option("rows", "33:40").option("cols", ":32").option("band", 2).load(made[0])
    assert {(r["band"], r["row"], r["col"]): r["pixels"] for r in part.collect()} == {k: v for k, v in whole.items() if k == (2, 32, 0)}
    by_name = cog.blocks_of(spark.createDataFrame([(f,) for f in made], "path string"), bytes_per_part=3000)
    assert {(r["band"], r["row"], r["col"]): r["pixels"] for r in by_name.where(F.col("path") == made[0]).collect()} == whole
    assert df.agg(F.sum(F.size("pixels"))).first()[0] == 4 * 64 * 64
    nir = df.where("band = 4")
    raw = open(made[0], "rb").read()
    assert nir.agg(F.sum(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v))).first()[0] == float(tiff.read_window(raw, tiff.read_header(raw), 4).sum())
    (tmp_path / "a/broken.tif").write_bytes(b"x")
    heads = {os.path.basename(r["path"]): r for r in cog.headers(spark, str(tmp_path / "a")).collect()}
    assert heads["broken.tif"]["error"] and heads["sample_20240115.tif"]["band_names"] == list(sample.BANDS) and heads["sample_20240115.tif"]["resolution"] == 10.0


def test_rasters_are_read_by_ranges(tmp_path, monkeypatch):
    """A header or one block of a large raster costs a few ranges, not the file."""
    a = np.arange(3 * 1024 * 1024, dtype=np.uint16).reshape(3, 1024, 1024)
    path = tmp_path / "big.tif"
    path.write_bytes(tiff.write(a, (0.0, 0.0, 1.0, 1.0), 4326, compression=tiff.NONE))
    with files.opened(f"file:{path}") as raw:
        read = []
        handle = raw.handle

        class Counting:
            def seek(self, at):
                handle.seek(at)

            def read(self, n):
                read.append(n)
                return handle.read(n)

        raw.handle = Counting()
        h = tiff.read_header(raw)
        assert (tiff.read_window(raw, h, 2, 512, 512, 10, 10) == a[1, 512:522, 512:522]).all()
        assert sum(read) < len(raw) / 4


def test_a_half_written_or_left_over_entry_is_not_read(spark, observations, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    for k in range(4):
        w.append(batch(observations, 1), f"c{k}")
    log = tmp_path / "w/_log"
    (log / "abc.draft").write_text('{"number":')  # a writer that died
    old = (log / f"{1:020d}.json").read_text()
    assert w.read().count() == 4 and len(w.log()) == 4
    assert not w._put(str(log / f"{4:020d}.json"), {"number": 4})  # taken
    assert w.expire(retain_last=2, older_than_ms=-1) == 2 and w.read().count() == 4
    (log / f"{1:020d}.json").write_text(old)  # as if the deletion had not got so far
    assert w.read().count() == 4 and [s.message for s in w.log()] == ["c2", "c3"]
    w.append(batch(observations, 1), "c4")
    assert w.read().count() == 5 and w.expire(retain_last=1, older_than_ms=-1) == 2 and w.read().count() == 5
    assert len(list(log.glob("*.json"))) == 1


def test_many_commits_are_one_scan(spark, observations, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    for k in range(3):
        w.append(batch(observations, 2))
    plan = w.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan


def test_raster_writer(spark, tmp_path):
    cog.register(spark)
    df = spark.createDataFrame([("a", 2, 2, [[1.0, 2.0, 3.0, 4.0]], 0.0, 0.0, 1.0, 1.0)], "name string, height int, width int, pixels array<array<double>>, minx double, miny double, maxx double, maxy double")
    df.write.format("cog").mode("append").save(str(tmp_path / "out"))
    raw = (tmp_path / "out/a.tif").read_bytes()
    assert tiff.read_window(raw, tiff.read_header(raw), 1).tolist() == [[1, 2], [3, 4]]


def test_many_small_rasters(spark, tmp_path):
    """Small rasters have small blocks, their headers are read by a few tasks, and their blocks go on together."""
    cog.register(spark)
    rows = [(f"a{k:03d}", 2, 2, [[1.0 + k, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]], 0.0, 0.0, 1.0, 1.0) for k in range(90)] + [("big", 300, 20, [[float(i) for i in range(6000)]], 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "name string, height int, width int, pixels array<array<double>>, minx double, miny double, maxx double, maxy double")
    df.write.format("cog").mode("append").save(str(tmp_path / "out"))
    side = {f: tiff.read_header((tmp_path / f"out/{f}.tif").read_bytes()).block for f in ("a007", "big")}
    assert side == {"a007": (16, 16), "big": (256, 256)} and os.path.getsize(tmp_path / "out/a007.tif") < 600
    heads = cog.headers(spark, str(tmp_path / "out"), times=True)
    assert heads.rdd.getNumPartitions() <= 16 and heads.where("error IS NULL AND modification_time IS NOT NULL").count() == 91
    got = {(os.path.basename(r["path"]), r["band"], r["row"]): r for r in cog.blocks_of(heads.select("path")).collect()}
    assert len(got) == 182 and all(r["width"] == (20 if "big" in f else 2) for (f, _, _), r in got.items())
    assert got["a007.tif", 1, 0]["pixels"] == [8.0, 2.0, 3.0, 4.0] and got["a007.tif", 2, 0]["pixels"] == [5.0, 6.0, 7.0, 8.0]
    assert got["big.tif", 1, 256]["pixels"] == [float(i) for i in range(256 * 20, 6000)] and got["big.tif", 1, 256]["height"] == 44
    assert len(got["a007.tif", 1, 0]["transform"]) == 6


def test_scene_ingest(spark, tmp_path):
    sample.create_sample_data(str(tmp_path / "in/prod"))
    sample.create_sample_data(str(tmp_path / "masks"))
    (tmp_path / "in/prod/bad.tif").write_bytes(b"no")
    store = str(tmp_path / "w")
    r = ingest.ingest(spark, str(tmp_path / "in"), store, mask_path=str(tmp_path / "masks"))
    assert r.scene_count == 3 and len(r.errors) == 1
    rows = Warehouse(spark, store, SCENES, []).read().orderBy("acquisition_time").collect()
    assert [str(x["acquisition_time"])[:10] for x in rows] == list(sample.DATES) and {x["product_id"] for x in rows} == {"prod"}
    assert all(x["mask_source_file"].endswith(os.path.basename(x["source_file"])) for x in rows)
    assert ingest.ingest(spark, str(tmp_path / "in"), store).scene_count == 0  # known files are left out


def test_tile_ingest(spark, tmp_path):
    sample.create_sample_data(str(tmp_path / "in"))
    rows = ingest.tile_rows(spark, str(tmp_path / "in"), {1: "blue", 4: "nir"}, pixels_per_tile=16)
    got = rows.collect()
    assert {r["band"] for r in got} == {"blue", "nir"} and {r["year_month"] for r in got} == {"2024-01", "2024-02", "2024-03"}
    assert all(len(r["pixels"]) == 256 and r["min_value"] <= r["mean_value"] <= r["max_value"] for r in got)
    ingest.ingest_tiles(spark, str(tmp_path / "in"), str(tmp_path / "w"), {4: "nir"}, pixels_per_tile=16)
    assert Warehouse(spark, str(tmp_path / "w")).read().where("band = 'nir'").count() == len([r for r in got if r["band"] == "nir"])


def test_chunk_files(spark, tmp_path):
    path = str(tmp_path / "t/x0001_y0001/2024-01/red.arrow")
    at = datetime(2024, 1, 5, tzinfo=UTC)
    chunks.write_chunk(path, {"time": [at], "pixels": [[1, 2]], "mask": [[True, False]]}, "p", 10.0, {"k": "v"})
    chunks.append_chunk(path, {"time": [at], "pixels": [[3, 4]], "mask": [[True, True]]}, "p", 10.0)
    data, meta = chunks.read_chunk(path)
    assert data["pixels"] == [[1, 2], [3, 4]] and meta["num_observations"] == "2" and meta["k"] == "v"
    (tmp_path / "t/bad.arrow").write_bytes(b"x")
    rows = chunks.load_chunks(spark, str(tmp_path / "t")).collect()
    assert len(rows) == 2 and rows[0]["metadata"]["product_id"] == "p"
    for bad in ({"time": [at], "pixels": [[1]]}, {"time": [at], "pixels": [], "mask": [[True]]}):
        with pytest.raises(ValidationError):
            chunks.write_chunk(path, bad, "p", 10.0)


def test_stream_into_warehouse(spark, observations, tmp_path):
    src, w = str(tmp_path / "src"), Warehouse(spark, str(tmp_path / "w"))
    df = batch(observations, 3)
    df.coalesce(1).write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        streams.into_warehouse(streams.follow(spark, src, df.schema), w, str(tmp_path / "cp")).awaitTermination()
    assert w.read().count() == 3


def test_monthly_composites(spark, observations, tmp_path):
    src = str(tmp_path / "src")
    df = observations([{"time": t, "mean_value": v, "min_value": v, "max_value": v} for t, v in (("2024-01-10", 1.0), ("2024-01-10", 3.0), ("2024-01-25", 4.0), ("2024-02-01", 5.0), ("2024-02-02", float("nan")))], extra=False)
    df.coalesce(1).write.parquet(src)
    out = streams.monthly_composites(streams.follow(spark, src, df.schema))
    q = out.writeStream.outputMode("update").format("memory").queryName("composites").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((str(r["month"])[:7], r["n"], r["mean_sum"]) for r in spark.table("composites").collect())
    assert got == [("2024-01", 3, 8.0), ("2024-02", 1, 5.0)]


def test_cli(spark, observations, tmp_path, capsys):
    Warehouse(spark, str(tmp_path / "w")).append(batch(observations, 2))
    assert cli.main(["info", str(tmp_path / "w")]) == 0 and '"records": 2' in capsys.readouterr().out
    assert cli.main(["recovery", "verify", str(tmp_path / "w")]) == 0
    assert cli.main(["consolidate", "/root/testdata/sf0.001/chunk_rows.parquet", str(tmp_path / "c"), "--catalogue", "/root/testdata/sf0.001/tile_metadata.parquet"]) == 0
    told = capsys.readouterr().out.strip().splitlines()[-1]
    assert '"files": ' in told and (tmp_path / "c/metadata").exists()
    assert cli.main(["sample"]) == 0 and os.path.isdir(capsys.readouterr().out.strip().splitlines()[-1])
    assert utc("2024-01-01").year == 2024
