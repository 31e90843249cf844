import struct

import numpy as np
from conftest import rows_of

from gridloom.functions import crs
from gridloom.operators import nearby as n

POINTS = "record_kind string, record_key string, lon double, lat double, site_id int"
SITES = "site_id bigint, lon double, lat double, record_key string"


def brute(points, sites, metres):
    return sorted(((k, key, s) for k, key, x, y in points if x is not None and y is not None for s, u, v in sites if u is not None and n.great_circle(x, y, u, v) <= metres), key=repr)


def frames(spark, points, sites):
    return spark.createDataFrame([(*p, 1) for p in points], POINTS), spark.createDataFrame([(*s, "clash") for s in sites], SITES)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    sites = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-1, 1, 60), rng.uniform(-1, 1, 60)))]
    sites += [(100, 179.95, 10.0), (101, -179.97, 10.02), (102, 20.0, 89.95), (103, None, 1.0), (104, 0.0, -89.0), (105, 179.95, 10.0)]
    points = [("p", str(k), float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-1, 1, 400), rng.uniform(-1, 1, 400)))]
    points += [("d", str(k), float(x if x < 180 else x - 360), 10.0) for k, x in enumerate(np.linspace(179.7, 180.3, 50))] + [("n", str(k), float(x), 89.9) for k, x in enumerate(range(-170, 180, 20))]
    points += [("p", "0", points[0][2], points[0][3]), ("x", "null", None, None), (None, None, 0.1, 0.1)]
    p, s = frames(spark, points, sites)
    want = brute(points, sites, 12_000.0)
    for group, salts in ((1000, 1), (32, 16), (5, 3)):
        got = rows_of(n.near(p, s, 12_000.0, group, salts).select("record_kind", "record_key", "site_id"))
        assert got == want


def test_empty(spark):
    p, s = frames(spark, [], [(1, 0.0, 0.0)])
    assert n.near(p, s, 1.0).collect() == []
    p, s = frames(spark, [("p", "1", 0.0, 0.0)], [])
    assert n.near(p, s, 1.0).collect() == []


def test_regions_that_cross(spark):
    rng = np.random.default_rng(1)
    rings = []
    for k in range(12):
        w = np.sort(rng.uniform(0, 2 * np.pi, 7))
        c = rng.uniform(-1, 1, 2)
        rings.append((k, np.stack([c[0] + np.cos(w) * rng.uniform(0.3, 1), c[1] + np.sin(w) * rng.uniform(0.3, 1)], axis=1)))
    pts = rng.uniform(-2, 2, (500, 2))

    def inside(ring, x, y):
        hit = False
        for a, b in zip(ring, np.roll(ring, -1, axis=0)):
            if (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]:
                hit = not hit
        return hit

    want = sorted(("p", str(i), k) for i, (x, y) in enumerate(pts) for k, r in rings if inside(r, x, y))
    p, _ = frames(spark, [("p", str(i), float(x), float(y)) for i, (x, y) in enumerate(pts)], [])
    assert rows_of(n.regions_of(p, [(k, list(map(tuple, r))) for k, r in rings])) == sorted(want, key=repr)


def test_many_sites_in_one_place(spark):
    """Regions that all overlap are decomposed in groups; every point meets them all."""
    rng = np.random.default_rng(6)
    sites = [(k, 10.5 + float(x), 20.5 + float(y)) for k, (x, y) in enumerate(rng.uniform(-0.05, 0.05, (150, 2)))]
    points = [("p", str(k), 10.5 + float(x), 20.5 + float(y)) for k, (x, y) in enumerate(rng.uniform(-0.2, 0.2, (300, 2)))]
    p, s = frames(spark, points, sites)
    assert rows_of(n.near(p, s, 12_000.0).select("record_kind", "record_key", "site_id")) == brute(points, sites, 12_000.0)


def test_exchanged_degrees_close_to_the_diagonal():
    """Longitude and latitude nearly alike: exchanging moves a scene by 100 km only, still far out of its tile's reach."""
    lon, lat = 30.9, 30.0
    hy = np.array([np.floor(lat * 111319.49079327358 / 2560)])
    hx = np.array([np.floor(lon * 111319.49079327358 * np.cos(np.radians(lat)) / 2560)])
    code = np.array([4326])
    assert n._exchanged(code, np.array([lat]), np.array([lon]), hx, hy)[0] and not n._exchanged(code, np.array([lon]), np.array([lat]), hx, hy)[0]


def test_utm_round_trip_and_known_point():
    lon, lat = np.array([148.84, -70.5, 9.0]), np.array([52.26, -33.2, 0.0])
    zone, south = np.array([55, 19, 32]), np.array([False, True, False])
    x, y = crs.degrees_to_utm(lon, lat, zone, south)
    u, v = crs.utm_to_degrees(x, y, zone, south)
    assert np.allclose(u, lon, atol=1e-8) and np.allclose(v, lat, atol=1e-8)
    assert abs(x[2] - 500_000) < 1e-6 and abs(y[2]) < 1e-6


def test_wkb_forms():
    ring = [(1.0, 2.0), (3.0, 2.0), (3.0, 5.0), (1.0, 2.0)]
    for end in "<>":
        body = struct.pack(f"{end}II", 1, 4) + struct.pack(f"{end}8d", *[v for p in ring for v in p])
        flag = b"\x01" if end == "<" else b"\x00"
        assert n.polygon_of_wkb(flag + struct.pack(end + "I", 3) + body) == (1.0, 2.0, 3.0, 5.0)
        assert n.polygon_of_wkb(flag + struct.pack(end + "II", 0x20000003, 4326) + body) == (1.0, 2.0, 3.0, 5.0)
    assert n.polygon_of_wkb(b"") is None and n.polygon_of_wkb(b"\x01\x03") is None


def test_places(spark, observations):
    scenes = [
        ("deg", [148.0, 52.0, 149.0, 52.2], None, None), ("swapped", [149.0, 52.2, 148.0, 52.0], "WGS 84", None), ("latlon", [52.0, 148.0, 52.2, 149.0], "EPSG:4326", None),
        ("wrapped", [308.0, 1.0, 309.0, 1.2], "OGC:CRS84", None), ("utm", [500000.0, 0.0, 500000.0, 0.0], "WGS 84 / UTM zone 32N", None), ("merc", [0.0, 0.0, 0.0, 0.0], "EPSG:900913", None),
        ("none", None, None, None), ("short", [1.0, 2.0], None, None), ("hole", [1.0, None, 2.0, 3.0], None, None), ("odd", [1.0, 2.0, 3.0, 4.0], "EPSG:9999", None),
    ]
    s = spark.createDataFrame(scenes, "scene_group string, bounds array<double>, crs string, source_file string")
    t = spark.createDataFrame([("x0000_y0000", None), ("X0_Y0", None), ("x0001_y0001", [1.0, 1.0, 3.0, 3.0]), ("?", None)], "tile_id string, bounds array<double>")
    got = {(r[0], r[1]): (r[2], r[3]) for r in n.record_places(s, t, observations([{"bounds_wkb": b"no"}, {"bounds_wkb": None}])).collect()}
    near = lambda k, x, y: abs(got[k][0] - x) < 1e-6 and abs(got[k][1] - y) < 1e-6
    assert near(("scene", "deg"), 148.5, 52.1) and near(("scene", "swapped"), 148.5, 52.1) and near(("scene", "latlon"), 148.5, 52.1)
    assert near(("scene", "wrapped"), -51.5, 1.1) and near(("scene", "utm"), 9.0, 0.0) and near(("scene", "merc"), 0.0, 0.0)
    assert np.isnan(got[("scene", "odd")][0])
    assert {k[1] for k in got if k[0] == "scene"} == {"deg", "swapped", "latlon", "wrapped", "utm", "merc", "odd"}
    assert {k[1] for k in got if k[0] == "tile"} == {"x0000_y0000", "x0001_y0001"} and near(("tile", "x0001_y0001"), 2.0, 2.0)
    assert near(("tile", "x0000_y0000"), 1280 / 111319.49079327358, 1280 / 111319.49079327358)
