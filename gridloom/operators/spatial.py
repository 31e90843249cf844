"""Query geometries against the tile grid: boxes, polygons, GeoJSON, buffers and clipping."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.tiles import METRES_PER_DEGREE, TILE_METRES, tile_bounds, tile_text
from gridloom.functions.trapezoids import Trapezoids

KM_PER_DEGREE = 111.32
Ring = list[tuple[float, float]]


class GeometryError(ValueError):
    """The input is no usable geometry."""


def rings_of(geojson: dict | str | Path) -> list[Ring]:
    """Outer rings of a GeoJSON object, text or file: geometry, feature or the union of a collection's features. A point
    is a ring of one vertex. Holes are left out: they only ever make a region of interest larger."""
    if isinstance(geojson, Path) or isinstance(geojson, str) and not geojson.lstrip().startswith("{"):
        geojson = Path(geojson).read_text()
    if isinstance(geojson, str):
        geojson = json.loads(geojson)
    kind = geojson.get("type")
    if kind == "FeatureCollection":
        rings = [r for f in geojson.get("features", []) for r in rings_of(f)]
        if not rings:
            raise GeometryError("a FeatureCollection without features")
        return rings
    if kind == "Feature":
        if not geojson.get("geometry"):
            raise GeometryError("a Feature without geometry")
        return rings_of(geojson["geometry"])
    c = geojson.get("coordinates")
    match kind:
        case "Polygon":
            parts = [c[0]]
        case "MultiPolygon":
            parts = [p[0] for p in c]
        case "Point":
            parts = [[c]]
        case "GeometryCollection":
            return [r for g in geojson["geometries"] for r in rings_of(g)]
        case _:
            raise GeometryError(f"geometry of type {kind}")
    rings = []
    for ring in parts:
        r = [(float(x), float(y)) for x, y, *_ in ring]
        rings.append(r[:-1] if len(r) > 1 and r[0] == r[-1] else r)
    return rings


def box_of(rings: list[Ring]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    if not xs:
        raise GeometryError("an empty geometry")
    return min(xs), min(ys), max(xs), max(ys)


def intersects_box(minx: Column, miny: Column, maxx: Column, maxy: Column, box: tuple[float, float, float, float]) -> Column:
    """Closed intersection: boxes that touch do."""
    return (minx <= box[2]) & (maxx >= box[0]) & (miny <= box[3]) & (maxy >= box[1])


def clip_to_box(ring: Ring, box: tuple[float, float, float, float]) -> Ring:
    """Part of a ring inside a box, by cutting at the box's four sides in turn; empty if they are apart."""
    out = ring
    for axis, limit, keep_below in ((0, box[0], False), (0, box[2], True), (1, box[1], False), (1, box[3], True)):
        inside = (lambda p: p[axis] <= limit) if keep_below else (lambda p: p[axis] >= limit)  # noqa: B023
        new: Ring = []
        for k, q in enumerate(out):
            p = out[k - 1]
            if inside(p) != inside(q):
                t = (limit - p[axis]) / (q[axis] - p[axis])
                cut = [p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])]
                cut[axis] = limit
                new.append((cut[0], cut[1]))
            if inside(q):
                new.append(q)
        out = new
    return out


def ring_area(ring: Ring) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True))) / 2


def ring_meets_boxes(ring: Ring, boxes: np.ndarray, reach: float = 0.0) -> np.ndarray:
    """Whether a ring, widened by ``reach`` degrees, meets each of many boxes (minx, miny, maxx, maxy)."""
    out = np.zeros(len(boxes), bool)
    p = np.array(ring)
    for x, y in p:  # a vertex within reach of the box
        dx = np.maximum(np.maximum(boxes[:, 0] - x, x - boxes[:, 2]), 0)
        dy = np.maximum(np.maximum(boxes[:, 1] - y, y - boxes[:, 3]), 0)
        out |= dx * dx + dy * dy <= reach * reach
    if len(p) < 2:
        return out
    q = np.roll(p, -1, axis=0)
    corners = np.stack([boxes[:, [0, 1]], boxes[:, [2, 1]], boxes[:, [2, 3]], boxes[:, [0, 3]]], axis=1)
    for a, b in zip(p, q, strict=True):
        d = b - a
        length = float(d @ d)
        if length:  # a corner within reach of the edge
            t = np.clip(((corners - a) @ d) / length, 0, 1)
            gap = corners - (a + t[..., None] * d)
            out |= (np.einsum("nkc,nkc->nk", gap, gap) <= reach * reach).any(axis=1)
        # the edge runs through the box: Liang and Barsky's parameters
        lo, hi = np.zeros(len(boxes)), np.ones(len(boxes))
        for axis in (0, 1):
            with np.errstate(divide="ignore", invalid="ignore"):
                t0, t1 = (boxes[:, axis] - a[axis]) / d[axis], (boxes[:, axis + 2] - a[axis]) / d[axis]
            if d[axis] == 0:
                within = (boxes[:, axis] <= a[axis]) & (a[axis] <= boxes[:, axis + 2])
                lo, hi = np.where(within, lo, 2.0), np.where(within, hi, -1.0)
            else:
                lo, hi = np.maximum(lo, np.minimum(t0, t1)), np.minimum(hi, np.maximum(t0, t1))
        out |= lo <= hi
    # the box lies inside the ring: its first corner does
    x, y = boxes[:, 0], boxes[:, 1]
    crossings = np.zeros(len(boxes), int)
    for a, b in zip(p, q, strict=True):
        spans = (a[1] > y) != (b[1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            crossings += spans & (x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0])
    return out | (crossings % 2 == 1)


def tiles_in_box(spark: SparkSession, box: tuple[float, float, float, float], size: float = TILE_METRES) -> DataFrame:
    """tile_id, x, y, minx, miny, maxx, maxy of the tiles that meet a box. The range of columns is taken at the corners and,
    if the box spans it, at the equator, where columns are widest; rows are generated on the executors."""
    minx, miny, maxx, maxy = box
    lats = [miny, maxy, *([0.0] if miny < 0 < maxy else [])]
    cols = [math.floor(lon * METRES_PER_DEGREE * math.cos(math.radians(lat)) / size) for lon in (minx, maxx) for lat in lats]
    rows = [math.floor(lat * METRES_PER_DEGREE / size) for lat in (miny, maxy)]
    # A tile's bounds use its middle latitude, so a column beside the range can still meet the box.
    xs = spark.range(min(cols) - 1, max(cols) + 2).select(F.col("id").cast("int").alias("x"))
    grid = xs.select("x", F.explode(F.sequence(F.lit(min(rows)), F.lit(max(rows)))).alias("y"))
    b = tile_bounds(F.col("x"), F.col("y"), size)
    boxed = grid.select(tile_text(F.col("x"), F.col("y")).alias("tile_id"), "x", "y", b.alias("b")).select("tile_id", "x", "y", "b.*")
    return boxed.where(intersects_box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), box))


def tiles_meeting(spark: SparkSession, rings: list[Ring], reach: float = 0.0, size: float = TILE_METRES) -> DataFrame:
    """Tiles that meet a geometry widened by ``reach`` degrees: the box's tiles, then the exact predicate in batches."""
    minx, miny, maxx, maxy = box_of(rings)
    box = (minx - reach, miny - reach, maxx + reach, maxy + reach)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = np.stack([batch.column(c).to_numpy() for c in ("minx", "miny", "maxx", "maxy")], axis=1)
            hit = np.zeros(len(boxes), bool)
            for ring in rings:
                hit |= ring_meets_boxes(ring, boxes, reach)
            yield batch.filter(pa.array(hit))

    tiles = tiles_in_box(spark, box, size)
    return tiles.mapInArrow(keep, tiles.schema)


def clipped_area(tiles: DataFrame, rings: list[Ring]) -> DataFrame:
    """Adds ``share``, the part of each tile's box (in degrees) that a geometry covers; tiles it misses are left out."""

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = np.stack([batch.column(c).to_numpy() for c in ("minx", "miny", "maxx", "maxy")], axis=1)
            near = [ring_meets_boxes(r, boxes) for r in rings]  # all boxes of the batch at once
            share = np.zeros(len(boxes))
            for k in np.flatnonzero(np.any(near, axis=0)) if rings else ():
                x0, y0, x1, y1 = boxes[k]
                parts = [p for r, m in zip(rings, near, strict=True) if m[k] and len(p := clip_to_box(r, tuple(boxes[k]))) > 2]
                # Rings that overlap count once.
                area = ring_area(parts[0]) if len(parts) == 1 else Trapezoids([np.asarray(p, float) for p in parts], np.arange(len(parts))).area()
                share[k] = min(area / ((x1 - x0) * (y1 - y0)), 1.0)
            keep = pa.array(share > 0)
            yield pa.RecordBatch.from_arrays([*batch.filter(keep).columns, pa.array(share).filter(keep)], names=[*batch.schema.names, "share"])

    fields = ", ".join(f"{n} {t}" for n, t in tiles.dtypes)
    return tiles.mapInArrow(clip, f"{fields}, share double")


def boxes_on_tiles(boxes: DataFrame, keys: list[str], size: float = TILE_METRES) -> DataFrame:
    """keys, tile_id: every tile whose index range a row's box (minx, miny, maxx, maxy in degrees) touches. This turns a
    range join of boxes with tiles into an equi-join on tile_id. Columns and rows of a box are listed one after the other,
    so that even a box around the globe is no array of more than 16,000 numbers."""
    index = lambda v: F.floor(v / size).cast("int")
    col = lambda lon, lat: index(F.col(lon) * METRES_PER_DEGREE * F.cos(F.radians(F.col(lat))))
    at = [col(a, b) for a in ("minx", "maxx") for b in ("miny", "maxy")]
    west, east = F.least(*at), F.greatest(*at)
    wide = F.when((F.col("miny") < 0) & (F.col("maxy") > 0), F.struct(F.least(west, index(F.col("minx") * METRES_PER_DEGREE)), F.greatest(east, index(F.col("maxx") * METRES_PER_DEGREE)))).otherwise(F.struct(west, east))
    south, north = (index(F.col(c) * METRES_PER_DEGREE) for c in ("miny", "maxy"))
    ranged = boxes.select(*keys, wide.alias("_c"), south.alias("_s"), north.alias("_n")).select(*keys, F.col("_c.col1").alias("_w"), F.col("_c.col2").alias("_e"), "_s", "_n")
    spread = ranged.withColumn("_x", F.explode(F.sequence("_w", "_e"))).withColumn("_y", F.explode(F.sequence("_s", "_n")))
    return spread.select(*keys, tile_text(F.col("_x"), F.col("_y")).alias("tile_id"))


@dataclass(frozen=True)
class SpatialQuery:
    """Fluent query: SpatialQuery().from_point(127, 37).buffer_km(5).tiles(spark)."""

    rings: tuple = ()
    reach: float = 0.0
    available: DataFrame | None = field(default=None, compare=False)

    def from_geojson(self, geojson: dict | str | Path) -> SpatialQuery:
        return replace(self, rings=tuple(rings_of(geojson)))

    def from_bbox(self, minx: float, miny: float, maxx: float, maxy: float) -> SpatialQuery:
        return replace(self, rings=([(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy)],))

    def from_point(self, lon: float, lat: float) -> SpatialQuery:
        return replace(self, rings=([(lon, lat)],))

    def buffer_km(self, km: float) -> SpatialQuery:
        """Widen by km / 111.32 degrees, at every latitude alike."""
        return replace(self, reach=self.reach + km / KM_PER_DEGREE)

    def filter_available(self, tiles: DataFrame) -> SpatialQuery:
        return replace(self, available=tiles)

    def bbox(self) -> tuple[float, float, float, float]:
        if not self.rings:
            raise GeometryError("no geometry given")
        b = box_of(list(self.rings))
        return b[0] - self.reach, b[1] - self.reach, b[2] + self.reach, b[3] + self.reach

    def tiles(self, spark: SparkSession) -> DataFrame:
        if not self.rings:
            raise GeometryError("no geometry given")
        found = tiles_meeting(spark, list(self.rings), self.reach)
        return found if self.available is None else found.join(self.available.select("tile_id").distinct(), "tile_id", "left_semi")
