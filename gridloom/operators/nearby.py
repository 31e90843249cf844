"""Points in regions and points near other points.

Method: the regions' boundaries are cut into a trapezoidal decomposition: slabs
between all vertices and edge crossings, in each slab the edges in order from
south to north (no two cross inside a slab), between two edges the set of regions
that cover the gap. A point finds its slab by binary search over the slabs and its
gap by binary search over the slab's edges. For "near", every site's region is a
polygon around the circle of the given radius, and an exact great-circle distance
decides on the few candidates.

Slabs are distributed by cells of a grid of whole degrees: a region goes to every cell
it touches, a point to its own, and the regions of a cell are decomposed in the task
that holds them. A cell with many regions is decomposed in groups of about ``GROUP``
regions, each group on its own, as overlapping regions have a number of trapezoids
that rises faster than their own; a point then meets every group of its cell. Points
carry no geometry but their cell, so a cell that holds a third of all points is
salted: its decompositions are repeated, its points are spread. Points in cells
without a region are dropped before the shuffle by a list of the cells that have
one; of these there are at most 360 x 181, however many regions or points there are.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.crs import crs_code, to_degrees
from gridloom.functions.tiles import ID_INSIDE, METRES_PER_DEGREE, TILE_METRES, canonical, tile_bounds, tile_x, tile_y
from gridloom.functions.trapezoids import Trapezoids

RADIUS = 6378137.0
#: Regions of a cell that are decomposed together, about.
GROUP = 32
#: Tasks over which the points of one cell and group are spread.
SALTS = 16
#: A scene's centre is no further from its tile than this; degrees that put it further and are closer when exchanged are exchanged.
REACH = 20_000.0
CORNERS = 12


def circle_rings(lon: float, lat: float, metres: float) -> list[np.ndarray]:
    """Rings in degrees that contain the circle: a polygon around it, twice if it crosses the date line; a whole band of
    latitude where it holds a pole or comes near one."""
    out = metres / math.cos(math.pi / CORNERS) * 1.003 / RADIUS  # circumscribed, with room for the chords' bend
    if abs(lat) + math.degrees(out) > 88.0:
        s, n = max(lat - math.degrees(out), -90.5), min(lat + math.degrees(out), 90.5)
        return [np.array([(-180.5, s), (180.5, s), (180.5, n), (-180.5, n)])]
    w = np.arange(CORNERS) * 2 * math.pi / CORNERS + 0.1
    p = math.radians(lat)
    q = np.arcsin(np.sin(p) * np.cos(out) + np.cos(p) * np.sin(out) * np.cos(w))
    d = np.arctan2(np.sin(w) * np.sin(out) * np.cos(p), np.cos(out) - np.sin(p) * np.sin(q))
    ring = np.stack([lon + np.degrees(d), np.degrees(q)], axis=1)
    rings = [ring]
    if ring[:, 0].min() < -180:
        rings.append(ring + (360.0, 0.0))
    if ring[:, 0].max() > 180:
        rings.append(ring - (360.0, 0.0))
    return rings


def great_circle(lon1, lat1, lon2, lat2):
    """Metres on the sphere, by the haversine."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def _site_shapes(sites: np.ndarray, lon: np.ndarray, lat: np.ndarray, metres: float, cell: tuple[int, int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Rings of the sites' circles that touch the cell, and the site of each."""
    rings, owner = [], []
    for k in range(len(sites)):
        for ring in circle_rings(float(lon[k]), float(lat[k]), metres):
            if cell in _cells(ring):
                rings.append(ring)
                owner.append(k)
    return rings, np.array(owner, np.int64)


def _exchanged(code: np.ndarray, x: np.ndarray, y: np.ndarray, hint_x: np.ndarray, hint_y: np.ndarray) -> np.ndarray:
    """Whether degrees are given as (latitude, longitude): the latitude is none, or the centre is out of reach of the
    record's tile and closer to it when exchanged."""
    h_lat = (hint_y + 0.5) * TILE_METRES / METRES_PER_DEGREE
    h_lon = (hint_x + 0.5) * TILE_METRES / (METRES_PER_DEGREE * np.cos(np.radians(h_lat)))
    with np.errstate(invalid="ignore"):
        there, other = great_circle(x, y, h_lon, h_lat), great_circle(y, x, h_lon, h_lat)
        return (code == 4326) & (np.abs(y) <= 360) & (np.abs(x) <= 90) & ((np.abs(y) > 90) | ((there > REACH) & (other < there)))


def _cells(ring: np.ndarray) -> list[tuple[int, int]]:
    """Cells (whole degrees) that the ring's box touches, on this side of the date line."""
    (w, s), (e, n) = ring.min(axis=0), ring.max(axis=0)
    xs = range(max(math.floor(w), -180), min(math.floor(e), 179) + 1)
    return [(x, y) for x in xs for y in range(max(math.floor(s), -90), min(math.floor(n), 90) + 1)]


def near(points: DataFrame, sites: DataFrame, metres: float, group: int = GROUP, salts: int = SALTS) -> DataFrame:
    """(record_kind, record_key, site_id, metres) for every point at most ``metres`` from a site.

    points: record_kind, record_key, lon, lat; sites: site_id, lon, lat. Points or sites with NULL or NaN coordinates
    are near nothing; repeated points each give their rows, repeated sites give one; other columns are ignored; empty
    tables give no rows."""
    good = sites.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")).select("site_id", F.col("lon").cast("double"), F.col("lat").cast("double"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lon, lat = (batch.column(c).to_numpy() for c in ("lon", "lat"))
            rows = [(k, *cell) for k in range(batch.num_rows) for ring in circle_rings(float(lon[k]), float(lat[k]), metres) for cell in _cells(ring)]
            k, x, y = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), *batch.take(pa.array(k)).columns], names=["cx", "cy", "site_id", "lon", "lat"])

    regions = good.mapInArrow(spread, "cx int, cy int, site_id bigint, lon double, lat double").distinct()
    # At most 360 x 181 rows: one per cell of the grid.
    cells = F.broadcast(regions.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("groups")))
    grouped = regions.join(cells, ["cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("site_id", "lon", "lat"), F.col("groups")).cast("int"))
    thin = points.select("record_kind", "record_key", F.col("lon").cast("double"), F.col("lat").cast("double"))
    whole = lambda c: F.floor(c).cast("int")
    placed = thin.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")).withColumns({"cx": whole("lon"), "cy": whole("lat")}).join(cells, ["cx", "cy"])
    salt = F.pmod(F.xxhash64("record_kind", "record_key", "lon", "lat", F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    placed = placed.withColumn("salt", salt).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

    # Regions first within each (cell, group, salt), then its points, which stream past the decomposition in batches.
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    order = ["cx", "cy", "part", "salt", "side"]
    left = grouped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        "cx", "cy", "part", "salt", F.lit(0).alias("side"), "site_id", none("string", "record_kind"), none("string", "record_key"), "lon", "lat"
    )
    right = placed.select("cx", "cy", "part", "salt", F.lit(1).alias("side"), none("bigint", "site_id"), "record_kind", "record_key", "lon", "lat")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, built, shapes = None, [], None, None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in order], axis=1)
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.empty(0, int)
            for lo, hi in zip(cuts, [*cuts[1:], len(key)], strict=True):
                part, where = batch.slice(int(lo), int(hi - lo)), tuple(key[lo, :4].tolist())
                if where != at:
                    at, held = where, []
                x, y = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lon", "lat"))
                if key[lo, 4] == 0:
                    held.append((part.column("site_id").to_numpy(), x, y))
                elif held:
                    if built != at[:3]:  # other salts of the same group have the same regions
                        i, u, v = (np.concatenate(z) for z in zip(*held, strict=True))
                        built, shapes = at[:3], (Trapezoids(*_site_shapes(i, u, v, metres, at[:2])), i, u, v)
                    point, k = shapes[0].locate(x, y)
                    yield _within(part, point, x, y, shapes[1][k], shapes[2][k], shapes[3][k], metres)

    both = left.unionByName(right).repartition(*order[:4]).sortWithinPartitions(*order)
    return both.mapInArrow(sweep, "record_kind string, record_key string, site_id bigint, metres double")


def _within(batch: pa.RecordBatch, point: np.ndarray, x, y, ids, lon, lat, metres: float) -> pa.RecordBatch:
    d = great_circle(x[point], y[point], lon, lat)
    # A circle on both sides of the date line or around a pole can meet a point twice.
    keep = np.flatnonzero(d <= metres)
    if len(keep):
        _, once = np.unique(np.stack([point[keep], ids[keep]]), axis=1, return_index=True)
        keep = keep[once]
    take = pa.array(point[keep])
    return pa.RecordBatch.from_arrays(
        [batch.column("record_kind").take(take), batch.column("record_key").take(take), pa.array(ids[keep], pa.int64()), pa.array(d[keep], pa.float64())],
        names=["record_kind", "record_key", "site_id", "metres"],
    )


def polygon_of_wkb(raw: bytes) -> tuple[float, float, float, float] | None:
    """Bounds (minx, miny, maxx, maxy) of a WKB or EWKB polygon in either byte order; None if it is none or cut short."""
    try:
        end = "<" if raw[0] == 1 else ">"
        (kind,) = struct.unpack_from(end + "I", raw, 1)
        at = 5 + (4 if kind & 0x20000000 else 0)
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        if kind & 0xFF != 3:
            return None
        (rings,) = struct.unpack_from(end + "I", raw, at)
        at += 4
        xs, ys = [], []
        for _ in range(rings):
            (n,) = struct.unpack_from(end + "I", raw, at)
            p = struct.unpack_from(f"{end}{n * dims}d", raw, at + 4)
            xs += p[0::dims]
            ys += p[1::dims]
            at += 4 + 8 * n * dims
        return (min(xs), min(ys), max(xs), max(ys)) if xs else None
    except (struct.error, IndexError):
        return None


def _places(rows: DataFrame) -> DataFrame:
    """record_kind, record_key, code, minx, miny, maxx, maxy, wkb, hint_x, hint_y -> record_kind, record_key, lon, lat."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            num = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            box = np.stack([num(c) for c in ("minx", "miny", "maxx", "maxy")])
            for i, raw in enumerate(batch.column("wkb").to_pylist()):
                if raw is not None and (b := polygon_of_wkb(raw)):
                    box[:, i] = b
            code = np.nan_to_num(num("code")).astype(int)
            x, y = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
            lon, lat = to_degrees(code, x, y)
            swap = _exchanged(code, x, y, num("hint_x"), num("hint_y"))
            other_lon, other_lat = to_degrees(code, y, x)
            lon, lat = np.where(swap, other_lon, lon), np.where(swap, other_lat, lat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lon), pa.array(lat)], names=["record_kind", "record_key", "lon", "lat"])

    return rows.mapInArrow(place, "record_kind string, record_key string, lon double, lat double")


def record_places(scenes_index: DataFrame, tile_metadata: DataFrame, observations: DataFrame) -> DataFrame:
    """The centre of every record in degrees: scenes with complete bounds, the distinct tiles of tile_metadata, and
    observations with bounds_wkb. The centre is the midpoint of the bounds in their own system. A tile without bounds
    in any row lies where its id says; a row whose tile id cannot be read and that has no bounds has no place. Bounds
    in an unknown system, or a WKB that cannot be read, give NULL coordinates."""
    corner = lambda i: F.get("bounds", i).alias(("minx", "miny", "maxx", "maxy")[i])
    complete = (F.size("bounds") == 4) & ~F.exists("bounds", lambda v: v.isNull() | F.isnan(v))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    path = F.col("source_file")
    scenes = scenes_index.where(F.col("bounds").isNotNull() & complete).select(
        F.lit("scene").alias("record_kind"),
        F.col("scene_group").alias("record_key"),
        crs_code(F.col("crs")).alias("code"),
        *[corner(i) for i in range(4)],
        none("binary", "wkb"),
        tile_x(path, ID_INSIDE).alias("hint_x"),
        tile_y(path, ID_INSIDE).alias("hint_y"),
    )
    tiles = tile_metadata.select(canonical("tile_id").alias("tile_id"), F.when(F.col("bounds").isNotNull() & complete, F.col("bounds")).alias("bounds")).where(F.col("tile_id").isNotNull())
    distinct = tiles.groupBy("tile_id").agg(F.min("bounds").alias("bounds"))
    x, y = tile_x("tile_id"), tile_y("tile_id")
    grid = tile_bounds(x, y)
    boxed = distinct.select("tile_id", F.coalesce("bounds", F.array(*[grid[c] for c in ("minx", "miny", "maxx", "maxy")])).alias("bounds"), x.alias("hint_x"), y.alias("hint_y"))
    tile_rows = boxed.select(
        F.lit("tile").alias("record_kind"), F.col("tile_id").alias("record_key"), F.lit(4326).alias("code"), *[corner(i) for i in range(4)], none("binary", "wkb"), "hint_x", "hint_y"
    )
    seen = observations.where(F.col("bounds_wkb").isNotNull()).select(
        F.lit("observation").alias("record_kind"),
        F.col("obs_id").cast("string").alias("record_key"),
        crs_code(F.col("crs")).alias("code"),
        *[none("double", c) for c in ("minx", "miny", "maxx", "maxy")],
        F.col("bounds_wkb").alias("wkb"),
        tile_x("tile_id").alias("hint_x"),
        tile_y("tile_id").alias("hint_y"),
    )
    return _places(scenes.unionByName(tile_rows).unionByName(seen))


def scenes_in_box(scenes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Scenes (with minx, miny, maxx, maxy, NULL for none) whose bounds, in any known system, meet a box in degrees.
    Those without bounds or in an unknown system pass: nothing is known against them."""
    hints = [tile_x("source_file", ID_INSIDE), tile_y("source_file", ID_INSIDE)]

    @F.pandas_udf("boolean")
    def meets(code: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, hx: pd.Series, hy: pd.Series) -> pd.Series:
        c = np.nan_to_num(code.to_numpy(dtype=float)).astype(int)
        x0, y0, x1, y1, hx, hy = (v.to_numpy(dtype=float) for v in (x0, y0, x1, y1, hx, hy))
        swap = _exchanged(c, (x0 + x1) / 2, (y0 + y1) / 2, hx, hy)
        x0, y0, x1, y1 = np.where(swap, y0, x0), np.where(swap, x0, y0), np.where(swap, y1, x1), np.where(swap, x1, y1)
        # Points along the edges; longitudes run on from the first one, so that a scene at the date line stays small.
        at = np.linspace(0, 1, 9)
        u, v = np.concatenate([at, at, at * 0, at * 0 + 1]), np.concatenate([at * 0, at * 0 + 1, at, at])
        px, py = x0 + u[:, None] * (x1 - x0), y0 + v[:, None] * (y1 - y0)
        # In degrees only the ends are places: what lies between them is the shorter way round.
        ends = (np.isin(u, (0, 1)) & np.isin(v, (0, 1)))[:, None]
        px, py = np.where((c == 4326) & ~ends, x0, px), np.where((c == 4326) & ~ends, y0, py)
        lon, lat = to_degrees(np.broadcast_to(c, px.shape), px, py)
        lon = lon[0] + (lon - lon[0] + 180.0) % 360.0 - 180.0
        west, east, south, north = lon.min(0), lon.max(0), lat.min(0), lat.max(0)
        with np.errstate(invalid="ignore"):
            around = np.any([(west + k <= box[2]) & (east + k >= box[0]) for k in (-360.0, 0.0, 360.0)], axis=0)
            return pd.Series(np.isnan(lon + lat).any(0) | (around & (south <= box[3]) & (north >= box[1])))

    return scenes.where(meets(crs_code(F.col("crs")), "minx", "miny", "maxx", "maxy", *hints))


def records_near_sites(scenes_index: DataFrame, tile_metadata: DataFrame, observations: DataFrame, sites: DataFrame, metres: float = 12_000.0) -> DataFrame:
    """(record_kind, record_key, site_id) at most ``metres`` apart."""
    return near(record_places(scenes_index, tile_metadata, observations), sites, metres).select("record_kind", "record_key", "site_id")


def regions_of(points: DataFrame, regions: list[tuple[int, list[tuple[float, float]]]]) -> DataFrame:
    """(record_kind, record_key, region_id): the query's own regions (polygon rings given by the caller, in degrees) that
    contain each point. A ring that crosses the date line is given as two rings of the same id."""
    shapes = Trapezoids([np.asarray(r, float) for _, r in regions], np.array([i for i, _ in regions], np.int64))
    shared = points.sparkSession.sparkContext.broadcast(shapes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lon", "lat"))
            point, region = shared.value.locate(x, y)
            if len(point):
                _, once = np.unique(np.stack([point, region]), axis=1, return_index=True)
                point, region = point[once], region[once]
            take = pa.array(point)
            yield pa.RecordBatch.from_arrays([batch.column("record_kind").take(take), batch.column("record_key").take(take), pa.array(region, pa.int64())], names=["record_kind", "record_key", "region_id"])

    return points.select("record_kind", "record_key", "lon", "lat").mapInArrow(scan, "record_kind string, record_key string, region_id bigint")
