import pytest
from conftest import rows_of

from gridloom.operators import units

SCENES = "scene_group string, source_file string, satellite_id string, image_description string, encoding int"
PROFILES = "product_id string, resolution double, scale_factor double, value_offset double, nodata int"
BANDS = "product_id string, band string, resolution double"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, (None, None, None)),
        ("", (None, None, None)),
        ("res:0.003km/px; native DN", (0.003, "km", "profile")),
        ("orbit 612 km, resolution 9,84252ft per pixel", (9.84252, "ft", None)),
        ("antenna 3 ft", (None, None, None)),
        ("terrain model 90 m\ncell 10 m", (10.0, "m", None)),
        ('GSD 0,323392"', (0.323392, "arcsec", None)),
        ("cell 0.0970176 sec of arc; 8-bit stretch", (0.0970176, "arcsec", "byte")),
        ("pixel size=2.69493e-05 deg | integer product", (2.69493e-05, "deg", "profile")),
        ("scale 1e-4 with 1000 added to every DN", (None, None, "e4_plus_1000")),
        ("scale 1e-4", (None, None, "e4")),
        ("native DN, reflectance in ppm", (None, None, "ppm")),
        ("cloud 35 %", (None, None, None)),
        ("factor 0.0001, counts", (None, None, "e4")),
        ("reflectance, 8 bit", (None, None, "byte")),
        ("DN = 10000*refl + 1000", (None, None, "e4_plus_1000")),
        ("refl in parts per million", (None, None, "ppm")),
        ("scale 0.00012", (None, None, None)),
        ("a 255 mm lens", (None, None, None)),
        ("ground sampling distance 30 mm", (30.0, "mm", None)),
    ],
)
def test_headers(text, want):
    assert units.read_header(text) == want


def test_very_long_header():
    assert units.read_header("chain v3.1; " * 20_000 + "GSD 10 m") == (10.0, "m", None)


def dims(spark):
    return (
        spark.createDataFrame([("p", 10.0, 1e-4, 0.0, 0), ("q", 30.0, 2e-5, -0.15, 0)], PROFILES),
        spark.createDataFrame([("p", "red", 10.0), ("p", "swir", 20.0), ("q", "red", 30.0)], BANDS),
    )


def found(spark, obs, scenes):
    u = units.measured_units(obs, spark.createDataFrame(scenes, SCENES), *dims(spark))
    return u, rows_of(units.other_units(u))


def test_sizes_by_text_and_by_number(spark, observations):
    arc = "/arc/p/x0001_y0001/s_20240101_{}.tif"
    values = [10.0, 10000.0, 1000.0, 0.01, 32.8084, 8.98315e-05, 0.323392, 20.0, 30.0, None, 65.6168]
    obs = observations([{"resolution": v, "pixels": [1000], "source_file": arc.format(k)} for k, v in enumerate(values)])
    u, cases = found(spark, obs, [("g", f"s3://b{arc.format(8)}".upper(), "s", "GSD 30 m", 1), ("g", arc.format(8), "s", None, 1)])
    assert [c[0] for c in cases if c[1] == "resolution"] == [11, 2, 3, 4, 5, 6, 7] or sorted(c[0] for c in cases) == [2, 3, 4, 5, 6, 7, 11]
    metres = {r["obs_id"]: r["resolution_m"] for r in units.in_common_units(u).collect()}
    assert metres[10] is None and metres[9] == 30.0
    assert all(abs(metres[k] - 10) < 0.05 for k in (1, 2, 3, 4, 5, 6, 7)) and abs(metres[11] - 20) < 0.05


def test_pixels_by_votes_and_levels(spark, observations):
    rows = []
    for sat, level in (("told", 150), ("dull", 330), ("own", 1500), ("loud", 300_000)):
        rows += [{"satellite_id": sat, "pixels": [level, level + 2, None], "resolution": 10.0, "source_file": f"/arc/p/x0001_y0001/{sat}_{k}.tif"} for k in range(3)]
    rows += [{"satellite_id": None, "pixels": None, "resolution": None, "source_file": None}, {"product_id": "unknown", "satellite_id": "z", "pixels": [5]}]
    rows += [{"product_id": "q", "satellite_id": "e4", "pixels": [1500], "resolution": 30.0, "source_file": "/arc/q/x0001_y0001/e4_1.tif"}]
    scenes = [("g", "/arc/p/x0001_y0001/told_0.tif", "told", "reflectance in per mille", 1), ("g", "/arc/p/x0001_y0001/own_0.tif", "own", "native DN", 1), ("g", "/arc/p/x0001_y0001/own_1.tif", "own", "unit pct", 1),  # impossible, so no vote
        ("g", None, None, None, 1), ("g", "", "x", "unit pct", 1)]
    u, cases = found(spark, observations(rows), scenes)
    encodings = {r["satellite_id"]: r["encoding"] for r in u.collect()}
    assert encodings["told"] == "permille" and encodings["dull"] == "permille" and encodings["own"] == "profile" and encodings["loud"] == "ppm" and encodings["e4"] == "e4"
    assert u.count() == 15
    assert sorted(c[0] for c in cases if c[1] == "pixels") == [1, 2, 3, 4, 5, 6, 10, 11, 12, 15]
    value = {r["obs_id"]: r["reflectance"] for r in units.in_common_units(u).collect()}
    assert abs(value[1][0] - 0.15) < 1e-9 and value[1][2] is None and abs(value[7][0] - 0.15) < 1e-9 and value[13] is None


def test_empty(spark, observations):
    u, cases = found(spark, observations([]), [])
    assert u.collect() == [] and cases == []
