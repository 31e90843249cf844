"""Entry points over a stored warehouse."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import utc
from pyspark.sql import functions as F

from gridloom import api, cli, maintenance
from gridloom.errors import QueryError
from gridloom.ingest import ingest
from gridloom.operators.cube import Cube
from gridloom.products import CloudMask, ProductProfile, ProductRegistry
from gridloom.sources import chunks, sample, tiff
from gridloom.warehouse import Warehouse

TILES = ("x0000_y0000", "x0001_y0000")


@pytest.fixture
def store(spark, observations, tmp_path):
    rows = []
    for k, tile in enumerate(TILES):
        for j, band in enumerate(("red", "nir")):
            for month in (1, 2):
                base = 100 * k + 10 * j + month
                rows.append({"tile_id": tile, "band": band, "time": f"2024-0{month}-10", "year_month": f"2024-0{month}", "pixels": [base, base + 1, base + 2, base + 3], "mask": [True, True, True, month == 1],
                             "resolution": 10.0, "num_pixels": 4, "min_value": float(base), "max_value": base + 3.0, "mean_value": base + 1.5, "product_id": "p" if k else "q"})
    path = str(tmp_path / "w")
    Warehouse(spark, path).append(observations(rows, extra=False))
    return path


def test_open_and_reduce(spark, store):
    c = api.open_dataset(spark, store, TILES[0], bands=["red"])
    assert c.reduce("mean", ["y", "x"]).df.count() == 2
    assert c.df.count() == 7  # one masked pixel
    assert api.open_dataset(spark, store, TILES[0], "2024-01").df.count() == 8
    assert api.open_dataset(spark, store, TILES[0], (utc("2024-02-01"), utc("2024-02-20")), ["nir"]).df.count() == 3
    with pytest.raises(ValueError):
        api.open_dataset(spark, store, TILES[0], bands=["blue"])
    v = api.ndvi(api.open_dataset(spark, store, TILES[1], "2024-01")).to_numpy().ravel()
    assert np.allclose(v, [10 / (2 * r + 10) for r in (101, 102, 103, 104)])


def test_mosaic(spark, store):
    a = api.open_mosaic(spark, store, list(TILES), "2024-01", ["red"]).to_numpy()
    assert a.shape == (1, 1, 2, 4) and a[0, 0].tolist() == [[1, 2, 101, 102], [3, 4, 103, 104]]


def test_by_place(spark, store):
    at = [(r["band"], r["value"]) for r in api.timeseries(spark, store, 0.001, 0.001, time="2024-01").collect()]
    assert at == [("nir", 13), ("red", 3)]  # the south-western pixel
    box = (0.0001, 0.0001, 0.0002, 0.0002)
    assert {r["tile_id"] for r in api.query_by_bounds(spark, store, box).collect()} == {TILES[0]}
    assert {len(r["pixels"]) for r in api.query_by_bounds(spark, store, box, side=3).collect()} == {9}
    assert api.list_tiles(spark, store) == list(TILES) and api.list_tiles(spark, store, box) == [TILES[0]] and api.list_tiles(spark, store, product_id="p") == [TILES[1]]
    assert api.list_tiles(spark, store, months=("2025-01", "2025-02")) == [] and api.list_bands(spark, store) == ["nir", "red"]
    ring = {"type": "Polygon", "coordinates": [[[0.03, 0.001], [0.04, 0.001], [0.04, 0.002], [0.03, 0.001]]]}
    assert {r["tile_id"] for r in api.query_by_geometry(spark, store, ring).collect()} == {TILES[1]}
    s = api.statistics(spark, store, TILES[0], "red")
    assert (s["num_observations"], s["min_value"], s["max_value"], s["mean_value"]) == (2, 1.0, 5.0, 3.0) and api.statistics(spark, store, "x9_y9", "red") == {}


def test_scenes(spark, tmp_path):
    sample.create_sample_data(str(tmp_path / "in"))
    w = str(tmp_path / "w")
    ingest(spark, str(tmp_path / "in"), w)
    assert api.scenes(spark, w, time=(utc("2024-02-01"), utc("2024-03-01"))).count() == 1
    assert api.scenes(spark, w, box=(0, 0, 1, 1)).count() == 0 and api.scenes(spark, w, product_id="in").count() == 3
    c = api.open_scenes(spark, w, ["red", "nir"], time=(utc("2024-02-01"), utc("2024-04-01")))
    assert c.shape() == {"band": 2, "time": 2, "y": 64, "x": 64}
    assert 0.4 < api.ndvi(c).reduce("mean").df.first()[0] < 0.8
    with pytest.raises(QueryError):
        api.open_scenes(spark, w, product_id="none")


def test_scenes_of_one_file_name_in_two_folders_and_on_coordinates(spark, tmp_path):
    """Files meet by their full names; scenes of different extent are aligned on coordinates."""
    for k, (folder, west) in enumerate((("a", 0.0), ("b", 1.0))):
        (tmp_path / "in" / folder).mkdir(parents=True)
        px = np.full((1, 2, 2), 10 * (k + 1), np.uint16)
        (tmp_path / "in" / folder / f"scene_2024010{k + 1}.tif").write_bytes(tiff.write(px, (west, 0.0, west + 2.0, 2.0), 4326, names=["red"], compression=tiff.NONE, tile=16))
        (tmp_path / "in" / folder / "scene.tif").write_bytes(tiff.write(px + 5, (west, 0.0, west + 2.0, 2.0), 4326, names=["nir"], compression=tiff.NONE, tile=16))
    (tmp_path / "in/a/not_registered.tif").write_bytes(b"no raster")
    w = str(tmp_path / "w")
    ingest(spark, str(tmp_path / "in"), w)
    plain = api.open_scenes(spark, w).df.groupBy("band").agg(F.sum("value").alias("s"), F.count("value").alias("n")).collect()
    assert {(r["band"], r["s"], r["n"]) for r in plain} == {("red", 4 * 10 + 4 * 20, 8), ("nir", 4 * 15 + 4 * 25, 8)}
    cells = {(r["x"], r["y"]): r["v"] for r in api.open_scenes(spark, w, ["red"], coordinates=True).df.groupBy("x", "y").agg(F.sum("value").alias("v")).collect()}
    assert cells == {(x, y): v for x, v in ((0.5, 10.0), (1.5, 30.0), (2.5, 20.0)) for y in (0.5, 1.5)}


def test_cloud_masks(spark, tmp_path):
    sample.create_sample_data(str(tmp_path / "in"))
    quality = np.zeros((2, 64, 64), np.uint8)
    quality[1, :, :16] = 3
    quality[1, :, 16:32] = 1
    (tmp_path / "m").mkdir()
    (tmp_path / "m/qa_20240115.tif").write_bytes(tiff.write(quality, (0, 0, 1, 1), 32652, compression=tiff.NONE, tile=16))
    w = str(tmp_path / "w")
    ingest(spark, str(tmp_path / "in"), w, mask_path=str(tmp_path / "m"))
    rules = ProductRegistry([ProductProfile("in", {"red": 3}, cloud_mask=CloudMask(2, (0, 1)))])
    cells = {str(r["time"])[:10]: r["n"] for r in api.open_scenes(spark, w, ["red"], rules).df.groupBy("time").agg(F.count("value").alias("n")).collect()}
    assert cells == {"2024-01-15": 64 * 48, "2024-02-15": 64 * 64, "2024-03-15": 64 * 64}
    assert api.open_scenes(spark, w, ["red"], ProductRegistry([])).df.where("value IS NULL").count() == 0


def test_migration(spark, tmp_path):
    src, w = str(tmp_path / "tiles"), str(tmp_path / "w")
    for tile in TILES:
        chunks.write_chunk(f"{src}/{tile}/2024-01/red.arrow", {"time": [utc("2024-01-05"), utc("2024-01-06")], "pixels": [[1, 2], [3, 4]], "mask": [[True, True], [True, False]]}, "p", 10.0)
    assert maintenance.migrate(spark, src, w, dry_run=True).observations == 4 and Warehouse(spark, w).read().count() == 0
    said = []
    assert maintenance.migrate(spark, src, w, backup=str(tmp_path / "b"), progress=said.append).snapshot_id > 0 and len(said) == 3
    assert maintenance.verify(spark, src, w).count() == 0 and {r["tile_id"] for r in Warehouse(spark, w).read().collect()} == set(TILES)
    chunks.append_chunk(f"{src}/{TILES[0]}/2024-01/red.arrow", {"time": [utc("2024-01-07")], "pixels": [[1, 2]], "mask": [[True, True]]}, "p", 10.0)
    assert [r["tile_id"] for r in maintenance.verify(spark, src, w).collect()] == [TILES[0]]
    assert cli.main(["migrate", src, w, "--dry-run"]) == 0


def test_migration_in_batches_is_taken_back_when_one_fails(spark, tmp_path):
    src, w = str(tmp_path / "tiles"), str(tmp_path / "w")
    for k in range(6):
        chunks.write_chunk(f"{src}/x000{k}_y0001/2024-01/red.arrow", {"time": [utc("2024-01-05")], "pixels": [[k, 2]], "mask": [[True, True]]}, "p", 10.0)
    entry = [("X0_Y1", "2024-01", "red", "a", "q", 3.0, 50.0), ("x0000_y0001", "2024-01", "red", "b", "r", 30.0, 7.0)]
    catalogue = spark.createDataFrame(entry, "tile_id string, year_month string, band string, chunk_path string, product_id string, resolution double, cloud_cover double")
    store = Warehouse(spark, w)
    first = store.append(maintenance.chunk_observations(spark, src).limit(1))
    calls = []

    def stop(said):
        calls.append(said)
        if len(calls) == 3:
            raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        maintenance.migrate(spark, src, w, progress=stop, batches=3)
    assert store.read().count() == 1 and store.log()[-1].operation == "rollback" and store.current_snapshot_id() != first
    other = str(tmp_path / "v")
    maintenance.migrate(spark, src, other, batches=3, catalogue=catalogue)
    got = {r["tile_id"]: (r["product_id"], r["resolution"], r["cloud_cover"]) for r in Warehouse(spark, other).read().collect()}
    assert len(got) == 6 and got["x0000_y0001"] == ("r", 30.0, 7.0) and got["x0001_y0001"] == ("p", 10.0, None)


def test_migration_of_many_chunks_makes_few_files_and_tasks(spark, observations, tmp_path):
    src, w = str(tmp_path / "tiles"), str(tmp_path / "w+x")
    for k in range(60):
        chunks.write_chunk(f"{src}/x{k:04d}_y0001/2024-01/red.arrow", {"time": [utc("2024-01-05")], "pixels": [[k, 2]], "mask": [[True, True]]}, "p", 10.0)
    (tmp_path / "tiles/_hidden").mkdir()
    (tmp_path / "tiles/_hidden/red.arrow").write_bytes(b"x")
    loaded = chunks.load_chunks(spark, src)
    assert loaded.rdd.getNumPartitions() <= 16 and {r["path"] for r in loaded.collect()} == {f"file:{src}/x{k:04d}_y0001/2024-01/red.arrow" for k in range(60)}
    assert maintenance.migrate(spark, src, w).chunks == 60
    store = Warehouse(spark, w)
    assert store.data_files().count() <= 8 and store.partition_by == maintenance.LEVELS
    paths = {r["tile_id"]: r["chunk_paths"] for r in api.metadata(spark, w).collect()}
    assert len(paths) == 60
    for tile, (path,) in paths.items():
        assert tile in pq.read_table(tmp_path / "w+x" / path, columns=["tile_id"], partitioning=None)["tile_id"].to_pylist()
    # What comes later keeps the folders that are there.
    store.append(observations([{"tile_id": "x0000_y0001", "band": "a+b %:c", "year_month": "2024-02", "resolution": 1.0, "num_pixels": 2}], extra=False))
    (path,) = [r["path"] for r in api.chunk_paths(spark, w, "x0000_y0001", "a+b %:c").collect()]
    assert (tmp_path / "w+x" / path).exists() and store.read().count() == 61


def test_metadata_paths_and_missing_files(spark, tmp_path):
    src, w = str(tmp_path / "tiles"), str(tmp_path / "w")
    for k in range(2):
        chunks.write_chunk(f"{src}/x000{k}_y0001/2024-0{k + 1}/red.arrow", {"time": [utc(f"2024-0{k + 1}-05")], "pixels": [[k, 2, 3, 4]], "mask": [[True] * 4]}, "p", 10.0)
    maintenance.migrate(spark, src, w)
    rows = {r["tile_id"]: r for r in api.metadata(spark, w).collect()}
    assert set(rows) == {"x0000_y0001", "x0001_y0001"} and all(len(r["chunk_paths"]) == 1 and r["bounds"]["miny"] < r["bounds"]["maxy"] for r in rows.values())
    (path,) = [r["path"] for r in api.chunk_paths(spark, w, "x0001_y0001", "red", ("2024-01", "2024-02")).collect()]
    assert path == rows["x0001_y0001"]["chunk_paths"][0] and api.chunk_paths(spark, w, months=("2024-01", "2024-01")).count() == 1
    assert api.export_geotiff(Warehouse(spark, w).read(), str(tmp_path / "out")) == 2
    raw = (tmp_path / "out/x0001_y0001_20240205T000000.tif").read_bytes()
    assert tiff.read_window(raw, tiff.read_header(raw), 1).tolist() == [[1, 2], [3, 4]]
    (tmp_path / "w" / path).unlink()
    assert [r["tile_id"] for r in Warehouse(spark, w).read(skip_missing=True).collect()] == ["x0000_y0001"]
    (tmp_path / "w/data/left.tmp").write_bytes(b"x")
    found = Warehouse(spark, w).diagnose()
    assert found["missing"] == [path] and found["temporary"] == ["data/left.tmp"] and Warehouse(spark, w).repair() == ["data/left.tmp"]
    with pytest.raises(ValueError, match="mode"):
        maintenance.write_metadata(spark.range(1), str(tmp_path / "m"), "merge")
    with pytest.raises(ValueError, match="no metadata"):
        maintenance.write_metadata(spark.range(0), str(tmp_path / "m"))
    for mode, n in (("append", 2), ("append", 4), ("overwrite", 2)):
        maintenance.write_metadata(spark.range(2), str(tmp_path / "m"), mode)
        assert spark.read.parquet(str(tmp_path / "m")).count() == n


def test_profiles_are_kept_beside_a_warehouse(spark, tmp_path):
    built = ProductRegistry.with_built_in()
    assert built.list() == ["landsat8_sr", "landsat9_sr", "planet_sr", "sentinel2_l2a"] and built.get("sentinel2_l2a").band_names[7] == "nir"
    built.save(spark, str(tmp_path / "w"))
    built.register(ProductProfile("own", {"red": 0}, 1.0))
    built.save(spark, str(tmp_path / "w"))
    other = ProductRegistry()
    other.load_from(spark, str(tmp_path / "w"))
    assert other.to_dict() == built.to_dict()


def test_labels_of_slices_are_snapped(spark):
    c = Cube.of(spark.createDataFrame([(float(k), k) for k in (1, 2, 4, 7, 11)], "y double, value int"), ["y"])
    labels = lambda s: sorted(r["y"] for r in c.sel("y", s).df.collect())
    assert labels(slice(1.6, 8.9)) == [2.0, 4.0, 7.0] and labels(slice(None, 3.0)) == [1.0, 2.0] and labels(slice(9.0, None)) == [7.0, 11.0]
    assert labels(slice(None, None, 2)) == [1.0, 4.0, 11.0] and c.sel("y", 5.4).df.first()["value"] == 4
    with pytest.raises(KeyError):
        c.sel("z", 1.0)
    with pytest.raises(KeyError):
        Cube.of(c.df.limit(0), ["y"]).sel("y", slice(1, 2))
