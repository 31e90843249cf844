"""The engine's own operators: expressions, cubes, grid, rasters, geometry, products."""

import math

import numpy as np
import pytest
from conftest import rows_of, utc
from pyspark.sql import functions as F

from gridloom import products
from gridloom.errors import GridloomError, IngestionError, QueryError, TransactionError, ValidationError
from gridloom.functions import expr, raster, tiles
from gridloom.functions.bandmath import BandMathError, compile_expression, over_arrays
from gridloom.operators import cube as cubes
from gridloom.operators import observations as ops
from gridloom.operators import spatial


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_division_as_ieee(spark):
    d = lambda a, b, **k: value(spark, expr.divide(F.lit(a), F.lit(b), **k))
    assert d(1.0, 0.0) == math.inf and d(-1.0, 0.0) == -math.inf and math.isnan(d(0.0, 0.0)) and d(6.0, 3.0) == 2.0
    assert d(1.0, 0.0, null_on_zero=True) is None
    assert d(None, 1.0) is None if False else value(spark, expr.divide(F.lit(None).cast("double"), F.lit(0.0))) is None


def test_indices(spark):
    assert abs(value(spark, expr.ndvi(F.lit(3000), F.lit(1000))) - 0.5) < 1e-12
    assert value(spark, expr.ndvi(F.lit(3), F.lit(5))) == -0.25  # no wrap of unsigned numbers
    assert abs(value(spark, expr.evi(F.lit(0.5), F.lit(0.1), F.lit(0.05))) - 2.5 * 0.4 / (0.5 + 0.6 - 0.375 + 1)) < 1e-12


NUMPY = [
    "(b1 - b0) / (b1 + b0)", "nir // 7 + red % 5 - -nir ** 2", "np.where((red > 3) & ~(nir < 2), np.sqrt(nir), np.log(red))", "np.clip(nir, 1, 2) + np.maximum(red, nir) * np.pi",
    "np.round(nir * 0.5) + np.sign(red - nir) + np.floor(red / 2)", "np.log10(nir) + np.log1p(red) + np.exp(red / 10) + np.arctan2(red, nir)", "np.square(red) + np.abs(red - nir) + np.power(nir, 0.5)",
]


@pytest.mark.parametrize("text", NUMPY)
def test_bandmath_is_numpy(spark, text):
    cells = [(3.0, 5.0), (4.0, 1.0), (0.5, 2.5), (7.0, 0.0)]
    df = spark.createDataFrame(cells, "red double, nir double")
    got = [r[0] for r in df.select(compile_expression(text, {"red": F.col("red"), "nir": F.col("nir")}).cast("double")).collect()]
    with np.errstate(all="ignore"):
        want = [float(eval(text, {"np": np, "red": np.float64(r), "nir": np.float64(n), "b0": np.float64(r), "b1": np.float64(n)})) for r, n in cells]  # noqa: S307
    assert np.allclose(got, want, equal_nan=True)


@pytest.mark.parametrize("text", ["__import__('os')", "red.real", "np.load(red)", "red if nir else 1", "other + 1", "red +", "lambda: 1", "np.sqrt(red, nir)", "'a'"])
def test_bandmath_refuses(text):
    with pytest.raises(BandMathError):
        compile_expression(text, {"red": F.lit(1.0), "nir": F.lit(2.0)})


def test_bandmath_over_arrays(spark):
    df = spark.createDataFrame([([1, 2], [3, 4])], "red array<int>, nir array<int>")
    assert list(df.select(over_arrays("nir - b0 * 2", {"red": F.col("red"), "nir": F.col("nir")})).first()[0]) == [1.0, 0.0]


def test_grid_ids(spark):
    ids = ["x0012_y-0345", "X12_Y-345", " x000012_y-00345 ", "x-0000_y0001", "x12345_y1", "nonsense", None, "x1_y2_z"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "t string").select(tiles.canonical("t")).collect()]
    assert got == ["x0012_y-0345"] * 3 + ["x0000_y0001", "x12345_y0001", None, None, None]
    assert value(spark, tiles.tile_of_point(F.lit(126.9780), F.lit(37.5665))) == "x4376_y1633"
    assert value(spark, tiles.tile_of_point(F.lit(-0.001), F.lit(-0.001))) == "x-0001_y-0001"
    assert [value(spark, tiles.pixels_across(F.lit(r))) for r in (10.0, 30.0, 3.0, 0.0)] == [256, 86, 854, None]


def test_grid_bounds_hold_their_points(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x in (-179.0, -3.3, 0.0, 88.8) for y in (-60.0, -0.01, 0.01, 71.3)], "lon double, lat double")
    b = df.select("*", tiles.tile_of_point(F.col("lon"), F.col("lat")).alias("t")).select("*", tiles.tile_bounds(tiles.tile_x("t"), tiles.tile_y("t")).alias("b"))
    for r in b.collect():
        assert r["b"]["miny"] <= r["lat"] <= r["b"]["maxy"]
        assert abs((r["b"]["minx"] + r["b"]["maxx"]) / 2 - r["lon"]) < 0.2


def test_tiles_in_a_box_across_the_equator(spark):
    box = (100.0, -0.5, 100.2, 0.5)
    got = {(r["x"], r["y"]) for r in spatial.tiles_in_box(spark, box).collect()}
    want = set()
    for y in range(-30, 30):
        s, n = y * 2560 / tiles.METRES_PER_DEGREE, (y + 1) * 2560 / tiles.METRES_PER_DEGREE
        k = tiles.METRES_PER_DEGREE * math.cos(math.radians((s + n) / 2))
        want |= {(x, y) for x in range(4300, 4400) if x * 2560 / k <= box[2] and (x + 1) * 2560 / k >= box[0] and s <= box[3] and n >= box[1]}
    assert got == want


def test_time_labels():
    assert ops.time_range("2024-06") == (utc("2024-06-01"), utc("2024-07-01"))
    assert ops.time_range("2024-12-31") == (utc("2024-12-31"), utc("2025-01-01"))
    assert ops.time_range(slice("2024-03", "2024-06")) == (utc("2024-03-01"), utc("2024-06-01"))
    assert ops.time_range(slice(None, "2024-06-05")) == (None, utc("2024-06-05"))
    assert ops.time_range("2024-06-05T10:00:00+00:00") == (utc("2024-06-05 10:00"),) * 2


def test_positions_and_nearest(observations):
    df = observations([{"time": f"2024-01-{d:02d}"} for d in (1, 5, 9, 20)])
    pick = lambda p: [r[0] for r in ops.at_position(df, ["tile_id"], p, ["time"]).orderBy("obs_id").select("obs_id").collect()]
    assert pick(0) == [1] and pick(-1) == [4] and pick(slice(1, 3)) == [2, 3] and pick(slice(-2, None)) == [3, 4] and pick(slice(0, None, 2)) == [1, 3] and pick(9) == []
    assert [r[0] for r in ops.nearest_in_time(df, utc("2024-01-07"), ["tile_id"]).select("obs_id").collect()] == [2]  # the earlier of two as near


def test_statistics(spark):
    df = spark.createDataFrame([([1, 2, 9], [True, True, False]), ([4, 6], [False, False]), ([], []), (None, None), ([None, 3], [True, True])], "pixels array<int>, mask array<boolean>")
    got = [tuple(r) for r in df.select(*ops.pixel_stats(F.col("pixels"), F.col("mask")).values()).collect()]
    assert got == [(1.0, 2.0, 1.5), (4.0, 6.0, 5.0), (None, None, None), (None, None, None), (3.0, 3.0, 3.0)]


def test_unknown_bands(observations):
    df = observations([{"band": "red"}])
    with pytest.raises(ValueError, match="unknown bands"):
        ops.in_bands(df, ["red", "x"])
    assert ops.in_bands(df, ["x"], strict=False).count() == 1


def test_cube(spark):
    cells = [(b, t, y, x, float(k)) for k, (b, t, y, x) in enumerate((b, t, y, x) for b in ("nir", "red") for t in (1, 2) for y in (0, 1) for x in (0, 1))]
    c = cubes.Cube.of(spark.createDataFrame(cells, "band string, time int, y int, x int, v double"), ["band", "time", "y", "x"], "v")
    a = c.to_numpy()
    assert a.shape == (2, 2, 2, 2)
    for how, f in (("mean", np.mean), ("max", np.max), ("min", np.min), ("median", np.median), ("std", np.std)):
        assert np.allclose(c.reduce(how, "time").to_numpy(), f(a, axis=1))
        assert np.allclose(c.reduce(how).to_numpy(), f(a))
    red, nir = c.band("red"), c.band("nir")
    assert np.allclose((nir - red).to_numpy(), a[0] - a[1]) and (nir - red).name == "nir_sub" and (2 - red).name == "red_rsub"
    assert np.allclose((1 / (red + 1)).to_numpy(), 1 / (a[1] + 1)) and np.allclose((red * 2).to_numpy(), a[1] * 2)
    assert np.allclose(c.bandmath("(nir - red) / (nir + b1)", ["red", "nir"]).to_numpy(), (a[0] - a[1]) / (a[0] + a[0]))
    assert np.allclose(c.at("time", -1).to_numpy(), a[:, -1]) and np.allclose(c.at("y", slice(0, 1)).to_numpy(), a[:, :, :1])
    assert np.allclose(c.nearest("x", 0.4).to_numpy(), a[..., 0]) and c.shape() == {"band": 2, "time": 2, "y": 2, "x": 2}
    with pytest.raises(ValueError):
        c.bands(["blue"])
    with pytest.raises(KeyError):
        c.reduce("mean", "z")


def test_resample_periods(spark):
    df = spark.createDataFrame([(utc("2024-01-01"), 1.0), (utc("2024-01-31"), 3.0), (utc("2024-02-01"), 5.0)], "time timestamp, value double")
    got = {str(r["time"])[:10]: r["value"] for r in cubes.Cube.of(df, ["time"]).resample("1M", "mean").df.collect()}
    assert got == {"2024-01-01": 2.0, "2024-02-01": 5.0}


def test_kernels(spark):
    a = np.arange(12.0).reshape(3, 4) * 100
    up = raster.bilinear(a, 5, 7)
    assert up[0, 0] == a[0, 0] and up[-1, -1] == a[-1, -1] and up[2, 3] == 550 and raster.bilinear(a, 3, 4).tolist() == a.tolist()
    assert raster.bilinear(np.empty((0, 0)), 2, 2).tolist() == [[0, 0], [0, 0]] and raster.bilinear(np.array([[7.0]]), 2, 2).tolist() == [[7, 7], [7, 7]]
    assert raster.bilinear(np.array([[-5.0, 1e6]]), 1, 3).tolist() == [[0, 65535, 65535]]
    m = np.array([[True, False], [False, True]])
    assert raster.nearest(m, 4, 4).tolist() == np.kron(m, np.ones((2, 2), bool)).tolist()
    df = spark.createDataFrame([([1, 2, 3, 4],), ([1, 2, 3],), (None,)], "p array<int>")
    assert [r[0] and list(r[0]) for r in df.select(raster.bilinear_column(F.col("p"), 3, 3)).collect()] == [raster.bilinear(np.array([[1.0, 2], [3, 4]]), 3, 3).ravel().tolist(), None, None]
    assert list(df.select(raster.nearest_column(F.col("p"), 4, 4)).first()[0]) == raster.nearest(np.array([[1, 2], [3, 4]]), 4, 4).ravel().tolist()


def test_geometry(spark):
    with pytest.raises(spatial.GeometryError):
        spatial.rings_of({"type": "FeatureCollection", "features": []})
    with pytest.raises(spatial.GeometryError):
        spatial.SpatialQuery().tiles(spark)
    assert spatial.rings_of('{"type": "Point", "coordinates": [1, 2]}') == [[(1.0, 2.0)]]
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert spatial.ring_area(spatial.clip_to_box(square, (1, 1, 5, 5))) == 1.0 and spatial.clip_to_box(square, (3, 3, 4, 4)) == []
    boxes = np.array([[0.5, 0.5, 0.6, 0.6], [-1, -1, 5, 5], [2.0, 2.0, 3, 3], [2.1, 0, 3, 1], [1.9, -1, 2.5, 3], [-3, 1, 3, 1.1]])
    assert spatial.ring_meets_boxes(square, boxes).tolist() == [True, True, True, False, True, True]
    assert spatial.ring_meets_boxes(square, boxes, 0.2).tolist()[3]
    one = spatial.SpatialQuery().from_point(127.0, 37.0).tiles(spark).collect()
    assert len(one) == 1 and one[0]["minx"] <= 127.0 <= one[0]["maxx"] and one[0]["miny"] <= 37.0 <= one[0]["maxy"]
    area = spatial.clipped_area(spatial.tiles_meeting(spark, [[(10.0, 45.0), (10.3, 45.0), (10.3, 45.2)]]), [[(10.0, 45.0), (10.3, 45.0), (10.3, 45.2)]])
    total = sum(r["share"] * (r["maxx"] - r["minx"]) * (r["maxy"] - r["miny"]) for r in area.collect())
    assert abs(total - 0.03) < 0.002


def test_overlapping_rings_count_once(spark):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    tiles = spatial.tiles_in_box(spark, (10.0, 45.0, 10.2, 45.2))
    shares = lambda rings: {r["tile_id"]: r["share"] for r in spatial.clipped_area(tiles, rings).collect()}
    one = shares([box(10.0, 45.0, 10.3, 45.3)])
    two = shares([box(10.0, 45.0, 10.2, 45.3), box(10.1, 45.0, 10.3, 45.3), [(10.05, 45.1), (10.25, 45.1), (10.15, 45.2)]])
    assert set(one) == set(two) and all(abs(one[k] - two[k]) < 1e-9 for k in one) and max(one.values()) > 0.99


def test_boxes_become_tiles(spark):
    assert spatial.boxes_on_tiles(spark.createDataFrame([(1, -30.0, -20.0, 30.0, 20.0)], "k int, minx double, miny double, maxx double, maxy double"), ["k"]).count() > 2_000_000
    df = spark.createDataFrame([(1, 10.0, -0.05, 10.1, 0.05)], "k int, minx double, miny double, maxx double, maxy double")
    got = {r["tile_id"] for r in spatial.boxes_on_tiles(df, ["k"]).collect()}
    want = {r["tile_id"] for r in spatial.tiles_in_box(spark, (10.0, -0.05, 10.1, 0.05)).collect()}
    assert want <= got


def test_names_and_paths(spark):
    names = ["a_2024-03-05.tif", "20240305T10.tif", "x_2024_03_05.tif", "99999999_2024_03_05.tif", "none.tif"]
    got = [str(r[0]) for r in spark.createDataFrame([(n,) for n in names], "n string").select(expr.date_in_name(F.col("n"))).collect()]
    assert got == ["2024-03-05"] * 4 + ["None"]
    assert str(value(spark, expr.date_in_name(F.lit("d05-03/2024/03/05.tif"), r"(\d{4}/\d{2}/\d{2})"))) == "2024-03-05"
    assert value(spark, expr.product_of_path(F.lit("/a/prod/f.tif"))) == "prod" and value(spark, expr.product_of_path(F.lit("f.tif"))) == "default"


def test_products(spark):
    p = products.ProductProfile("p", {"red": 1, "blue": 0}, 10.0, cloud_mask=products.CloudMask(2, (1, 4), "_qa"), extra_fields={"k": 1})
    assert p.band_names == ["blue", "red"] and p.band_count == 2 and products.ProductProfile.from_dict(p.to_dict()) == p
    r = products.ProductRegistry([p])
    again = products.ProductRegistry()
    again.load(r.to_df(spark))
    assert again.get("p") == p and again.list() == ["p"]
    with pytest.raises(KeyError):
        r.get("x")
    bands = spark.createDataFrame([("p", "red", "N1", 10.0), ("q", "red", "N2", 20.0), ("q", "nir", "N3", 10.0)], "product_id string, band string, native_name string, resolution double")
    assert products.band_by_native_name(bands, "q", "N3") == "nir" and rows_of(products.common_bands(bands)) == [("red",)]
    with pytest.raises(KeyError):
        products.band_by_native_name(bands, "p", "N3")
    assert all(issubclass(e, GridloomError) for e in (IngestionError, QueryError, TransactionError, ValidationError))
