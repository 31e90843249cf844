"""Every row of a table counts in a query, whatever its tile and however that is written."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import raster
from gridloom.operators import observations as ops
from gridloom.plans import reference


@pytest.fixture
def at(observations, tmp_path):
    def write(rows):
        observations(rows, extra=False).write.parquet(f"{tmp_path}/observations.parquet")
        return str(tmp_path)

    return write


PX = {"pixels": list(range(16)), "mask": [True] * 16}


def run(spark, sf, name):
    return reference.QUERIES[name](spark, sf).collect()


def test_resampling_takes_every_observation(spark, at):
    sf = at([{"tile_id": "x0001_y0001"} | PX, {"tile_id": "x0002_y-0001"} | PX])
    for name, n in (("resample_bilinear", 49), ("resample_nearest", 36)):
        got = run(spark, sf, name)
        assert len(got) == 2 * n and {r["obs_id"] for r in got} == {1, 2}


def test_mosaic_takes_its_tiles_from_the_data(spark, at):
    late = PX | {"pixels": list(range(100, 116)), "time": "2024-02-01"}
    sf = at([{"tile_id": "x0001_y0001"} | PX, {"tile_id": " X1_Y1"} | late, {"tile_id": "x0003_y0000"} | PX, {"tile_id": "none"} | PX])
    got = {(r["row"], r["col"]): r["value"] for r in run(spark, sf, "mosaic_tiles")}
    assert got == {(k // 4, k % 4): 100 + k for k in range(16)} | {(4 + k // 4, 8 + k % 4): k for k in range(16)}


def test_bilinear_of_mixed_arrays(spark):
    square, small = list(range(16)), [5, 6, 7, 9]
    rows = [(0, square), (1, None), (2, [1, 2, 3]), (3, small), (4, [1, None, 2, 3]), (5, []), (6, square[::-1])]
    df = spark.createDataFrame(rows, "k int, p array<int>").coalesce(1)
    got = {r["k"]: r["q"] for r in df.select("k", raster.bilinear_column(F.col("p"), 3, 3).alias("q")).collect()}
    one = lambda a, n: raster.bilinear(np.array(a).reshape(n, n), 3, 3).ravel().tolist()
    assert got == {0: one(square, 4), 1: None, 2: None, 3: one(small, 2), 4: None, 5: [0] * 9, 6: one(square[::-1], 4)}


def test_cubes_take_every_tile_and_product(spark, at):
    other = {"tile_id": "X2_y1", "product_id": "q", "pixels": [10] * 16, "mask": [True] * 8 + [False] * 8}
    sf = at([{"tile_id": "x0002_y0001"} | PX, {"tile_id": " x2_y0001"} | PX | {"time": "2024-03-01", "pixels": [k + 2 for k in range(16)]}, other])
    got = {(r["tile_id"], r["product_id"], 4 * r["y"] + r["x"]): r["value"] for r in run(spark, sf, "mean_time")}
    assert got == {("x0002_y0001", "p", k): k + 1.0 for k in range(16)} | {("x0002_y0001", "q", k): 10.0 for k in range(8)}
    assert {(r["product_id"], r["value"]) for r in run(spark, sf, "mean_all")} == {("p", 8.5), ("q", 10.0)}
    assert len(run(spark, sf, "scan_observations")) == 3 and len(run(spark, sf, "explode_pixels")) == 48
    assert sorted(r["n"] for r in run(spark, sf, "count_observations")) == [3]
    assert {r["y"] for r in run(spark, sf, "scene_outer_align") if r["product_id"] == "q"} == {0, 1}
    assert len(run(spark, sf, "scene_outer_align")) == 2 * 16 + 8
    assert sorted(r["start"] for r in run(spark, sf, "resample_1m_mean")) == ["2024-01-01"] * 24 + ["2024-03-01"] * 16


def test_bands_of_one_tile_are_aligned_however_its_id_is_written(spark, at):
    ones = {"mask": [True] * 16}
    sf = at([{"tile_id": "x0002_y-0001", "band": "red", "pixels": [100] * 16} | ones, {"tile_id": " X2_Y-1 ", "band": "nir", "pixels": [300] * 16} | ones])
    assert [tuple(r) for r in run(spark, sf, "ndvi_tile_month")] == [("x0002_y-0001", "2024-01", 16, 0.5)]
    assert len(run(spark, sf, "ndvi_pixels")) == 16
    assert len(run(spark, sf, "pivot_bands")) == 1
    assert {r["tile_id"] for r in run(spark, sf, "latest_per_tile")} == {"x0002_y-0001"}


SCENE = "scene_group string, acquisition_time string, product_id string, bounds array<double>, crs string, band_names array<string>"


def test_scenes_of_every_form_of_time_count(spark, tmp_path):
    times = ["2024-02-01T00:00:00Z", "2024-02-01 00:00:00", "2024-02-01T00:00:00", "2024-01-01T01:00:00+02:00", "2024-04-01T01:00:00+02:00", "soon", None]
    spark.createDataFrame([(str(k), t, "halo2_l2a", None, None, ["red"]) for k, t in enumerate(times)], SCENE).write.parquet(f"{tmp_path}/scenes_index.parquet")
    spark.createDataFrame([("halo2_l2a", "h", 10.0)], "product_id string, provider string, resolution double").write.parquet(f"{tmp_path}/product_profiles.parquet")
    assert {r["scene_group"] for r in run(spark, str(tmp_path), "scenes_filtered")} == {"0", "1", "2", "4"}
    (row,) = run(spark, str(tmp_path), "warehouse_summary")
    assert (row["first_us"], row["last_us"]) == (1704063600000000, 1711926000000000)


def test_rollup_and_trend_leave_no_row_out(spark, at, observations):
    values = [(10.0, 10.0, 10.0), (-32768.0, 5.0, -32768.0), (0.0, 3e6, 2e6), (None, None, None), (float("nan"),) * 3]
    rows = [{"tile_id": t, "year_month": "2024-01", "time": f"2024-01-{k + 1:02}", "min_value": a, "max_value": b, "mean_value": c, "bounds_wkb": bytes([k]) if k > 2 else None} for k, ((a, b, c), t) in enumerate(zip(values, ["x0001_y0001", "X1_Y1"] * 3))]
    (row,) = ops.tile_month_rollup(observations([r | {"tile_id": "t"} for r in rows])).collect()
    means = [10.0, -32768.0, 2e6]
    assert (row["num_observations"], row["min_value"], row["max_value"], bytes(row["bounds_wkb"])) == (5, -32768.0, 3e6, bytes([3])) and np.isclose(row["mean_value"], np.mean(means))
    sf = at([r | {"pixels": [k, k + 4], "mask": [True, k != 2]} for k, r in enumerate(rows)])
    (row,) = run(spark, sf, "tile_month_rollup")
    assert (row["num_observations"], row["min_value"], row["max_value"], row["mean_value"]) == (5, 0.0, 8.0, 3.6)
    (row,) = run(spark, sf, "tile_band_statistics")
    assert row["num_observations"] == 5
    (row,) = run(spark, sf, "series_trend")
    assert row["n"] == 5 and np.isclose(row["slope"], np.polyfit(range(5), [2, 3, 2, 5, 6], 1)[0], atol=0.01)


def test_box_meets_scenes_of_every_system(spark, tmp_path):
    inside = {
        "epsg:4326": [10, 20, 11, 21], "OGC:CRS84": [10, 20, 11, 21], "WGS 84": [11, 21, 10, 20], None: [-61, 0, -59.5, 1], "EPSG:3857": [1e6, 1e6, 1.1e6, 1.1e6],
        "EPSG:32631": [4e5, 2e6, 5e5, 2.1e6], "WGS 84 / UTM zone 33S": [4e5, 9e6, 5e5, 9.1e6], "EPSG:4326": [370, 0, 371, 1], "no such system": [1, 2, 3, 4],
    }
    outside = {"epsg:4326": [70, 20, 71, 21], "OGC:CRS84": [179.9, 0, -179.9, 1], "EPSG:3857": [1e7, 1e6, 1.1e7, 1.1e6], "EPSG:32655": [4e5, 2e6, 5e5, 2.1e6], "WGS 84 / UTM zone 33S": [4e5, 5e6, 5e5, 5.1e6]}
    rows = [(f"{name} {crs}", None, "p", [float(v) for v in b], crs, [], None) for name, d in (("in", inside), ("out", outside)) for crs, b in d.items()]
    # Latitude first, as the tile in the path tells: lon 20 is inside, lat 50 is not.
    rows += [("in none", None, "p", None, "EPSG:32655", [], None), ("out swapped", None, "p", [50.0, 20.0, 50.1, 20.1], None, [], "/a/x0559_y2176/b.tif")]
    spark.createDataFrame(rows, SCENE + ", source_file string").write.parquet(f"{tmp_path}/scenes_index.parquet")
    got = {r["scene_group"] for r in run(spark, str(tmp_path), "bbox_scenes")}
    assert got == {r[0] for r in rows if r[0].startswith("in")}


def test_reflectance_and_places_of_all_bands(spark, at):
    sf = at([{"band": "red", "tile_id": "x0002_y0001"} | PX, {"band": "blue", "tile_id": " X2_Y1"} | PX])
    spark.createDataFrame([("p", 0.5, 1.0, 0)], "product_id string, scale_factor double, value_offset double, nodata int").write.parquet(f"{sf}/product_profiles.parquet")
    assert {(r["obs_id"], r["i"], r["value"]) for r in run(spark, sf, "reflectance")} == {(o, k, k * 0.5 + 1 if k else None) for o in (1, 2) for k in range(16)}
    got = run(spark, sf, "pixel_lonlat")
    assert len(got) == 32 and len({(r["y"], r["x"], r["lon"], r["lat"]) for r in got}) == 16
