"""Queries of the engine's own operators over the observation, scene and catalogue tables, each with its SQL.

Times come out as microseconds since 1970, so that both engines compare integers.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import api, ingest, maintenance, products
from gridloom.functions import expr, raster, tiles
from gridloom.functions.bandmath import compile_expression
from gridloom.operators import cube as cubes
from gridloom.operators import nearby
from gridloom.operators import observations as ops
from gridloom.operators import spatial
from gridloom.plans.problems import tile_sql
from gridloom.session import shared_folder, table
from gridloom.warehouse import Warehouse, by_suffix, summarised

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
HOT = "x3961_y2272"
BOX = (-60.0, -30.0, 60.0, 40.0)


def canonical_sql(sql: str) -> str:
    """SQL whose observations and tile_metadata have canonical tile ids: ids that name the same pair are one tile."""
    return re.sub(r"\b(FROM|JOIN) (observations|tile_metadata)\b", lambda m: f"{m[1]} (SELECT * REPLACE ({tile_sql('tile_id')} AS tile_id) FROM {m[2]}) AS {m[2]}", sql)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = canonical_sql(sql)
        return f

    return add


def us() -> Column:
    return F.unix_micros("time").alias("time_us")


def obs(spark: SparkSession, sf: str, name: str = "observations") -> DataFrame:
    """A whole table under canonical tile ids: ids that name the same pair are one tile."""
    return table(spark, sf, name).withColumn("tile_id", tiles.canonical_or_self("tile_id"))


def _ts(*a: int) -> datetime:
    return datetime(*a, tzinfo=UTC)


# scans and filters
@query("SELECT obs_id, tile_id, band, epoch_us(time) AS time_us, pixels, mask FROM observations")
def scan_observations(spark, sf):
    return obs(spark, sf).select("obs_id", "tile_id", "band", us(), "pixels", "mask")


@query(f"""SELECT obs_id, band, epoch_us(time) AS time_us, min_value, max_value FROM observations WHERE tile_id = '{HOT}' AND band IN ('red', 'nir')
 AND time >= TIMESTAMPTZ '2024-01-15 00:00:00+00' AND time <= TIMESTAMPTZ '2024-06-15 00:00:00+00' AND product_id <> 'kestrel_sr' AND min_value IS NOT NULL""")
def filter_tile_band_time(spark, sf):
    df = ops.in_tiles(obs(spark, sf), [HOT]).where(F.col("band").isin("red", "nir"))
    df = ops.between_times(df, _ts(2024, 1, 15), _ts(2024, 6, 15)).where((F.col("product_id") != "kestrel_sr") & F.col("min_value").isNotNull())
    return df.select("obs_id", "band", us(), "min_value", "max_value")


@query("SELECT year_month, count(*) AS n FROM observations WHERE year_month BETWEEN '2023-11' AND '2024-02' GROUP BY 1")
def filter_month_range(spark, sf):
    return ops.in_months(obs(spark, sf), "2023-11", "2024-02").groupBy("year_month").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tile_id, band, count(*) AS n FROM observations WHERE product_id = 'meridian_sr' GROUP BY 1, 2")
def filter_product(spark, sf):
    return obs(spark, sf).where(F.col("product_id") == "meridian_sr").groupBy("tile_id", "band").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH moment AS (SELECT min(time) AS t FROM observations WHERE tile_id = '{HOT}' AND band = 'green')
SELECT obs_id, tile_id, band, epoch_us(time) AS time_us, pixels FROM observations, moment WHERE tile_id = '{HOT}' AND band = 'green' AND time = t ORDER BY obs_id LIMIT 1""")
def observation_point_lookup(spark, sf):
    df = obs(spark, sf)
    first = df.where((F.col("tile_id") == HOT) & (F.col("band") == "green")).agg(F.min(F.unix_micros("time"))).first()[0]
    first = first or 0
    at = datetime.fromtimestamp(first // 1_000_000, UTC).replace(microsecond=first % 1_000_000)
    return ops.at_instant(df, HOT, "green", at).select("obs_id", "tile_id", "band", us(), "pixels")


_ANY_TIME = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes with an instant and a box; incomplete bounds count as none. The instant is of every ISO form: T or a blank,
    any offset; UTC where none is given; NULL where the text is none."""
    s = table(spark, sf, "scenes_index")
    ok = (F.size("bounds") == 4) & ~F.exists("bounds", lambda v: v.isNull() | F.isnan(v))
    iso = F.when(F.col("acquisition_time").rlike(_ANY_TIME), F.col("acquisition_time").try_cast("timestamp"))
    return s.select("*", iso.alias("instant"), *[F.when(F.col("bounds").isNotNull() & ok, F.get("bounds", i)).alias(n) for i, n in enumerate(("minx", "miny", "maxx", "maxy"))])


_SCENES = f"""WITH s AS (SELECT *, CASE WHEN regexp_matches(acquisition_time, '{_ANY_TIME}') THEN try_cast(acquisition_time AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS instant,
 coalesce(len(bounds) = 4 AND len(list_filter(bounds, lambda v: v IS NULL OR isnan(v))) = 0, false) AS ok FROM scenes_index),
 b AS (SELECT *, CASE WHEN ok THEN bounds[1] END AS minx, CASE WHEN ok THEN bounds[2] END AS miny, CASE WHEN ok THEN bounds[3] END AS maxx, CASE WHEN ok THEN bounds[4] END AS maxy FROM s) """


@query()
def bbox_scenes(spark, sf):
    """Scenes of every coordinate system; a scene without bounds passes. tests/test_whole.py has places worked out by hand."""
    return nearby.scenes_in_box(scenes(spark, sf), BOX).select("scene_group", "product_id")


@query(f"""SELECT tile_id, band, year_month, chunk_path FROM tile_metadata
 WHERE bounds IS NULL OR len(bounds) <> 4 OR (bounds[1] <= {BOX[2]} AND bounds[3] >= {BOX[0]} AND bounds[2] <= {BOX[3]} AND bounds[4] >= {BOX[1]})""")
def bbox_tiles(spark, sf):
    """Catalogue entries whose bounds meet a box; one without bounds passes."""
    corner = [F.get("bounds", i) for i in range(4)]
    df = obs(spark, sf, "tile_metadata")
    return df.where(F.col("bounds").isNull() | (F.size("bounds") != 4) | spatial.intersects_box(*corner, BOX)).select("tile_id", "band", "year_month", "chunk_path")


@query(_SCENES + """SELECT scene_group, epoch_us(instant) AS time_us, band_names FROM b WHERE instant >= TIMESTAMP '2024-01-01' AND instant <= TIMESTAMP '2024-04-01' AND product_id = 'halo2_l2a' """)
def scenes_filtered(spark, sf):
    """A scene without an instant fails every time filter."""
    s = scenes(spark, sf).drop("acquisition_time", "bounds").withColumnRenamed("instant", "acquisition_time").withColumn("bounds", F.struct("minx", "miny", "maxx", "maxy"))
    s = api.filter_scenes(s, (_ts(2024, 1, 1), _ts(2024, 4, 1)), product_id="halo2_l2a")
    return s.select("scene_group", F.unix_micros("acquisition_time").alias("time_us"), "band_names")


@query("""SELECT obs_id, epoch_us(time) AS time_us FROM observations WHERE time >= TIMESTAMPTZ '2024-03-01 00:00:00+00' AND time <= TIMESTAMPTZ '2024-06-01 00:00:00+00'""")
def month_slice_sel(spark, sf):
    """In a slice the end month stands for its first instant."""
    return ops.select_time(obs(spark, sf), slice("2024-03", "2024-06")).select("obs_id", us())


@query("SELECT obs_id FROM observations WHERE time >= TIMESTAMPTZ '2024-03-01 00:00:00+00' AND time <= TIMESTAMPTZ '2024-04-01 00:00:00+00'")
def month_label_sel(spark, sf):
    return ops.select_time(obs(spark, sf), "2024-03").select("obs_id")


@query("""WITH d AS (SELECT *, abs(epoch_us(time) - 1710460800000000) AS d FROM observations WHERE time IS NOT NULL),
 best AS (SELECT tile_id, band, min((d, epoch_us(time))) AS b FROM d GROUP BY 1, 2)
SELECT o.obs_id, o.tile_id, o.band, epoch_us(o.time) AS time_us FROM d o JOIN best ON o.tile_id = best.tile_id AND o.band = best.band AND epoch_us(o.time) = b[2]""")
def nearest_time_sel(spark, sf):
    return ops.nearest_in_time(obs(spark, sf), _ts(2024, 3, 15), ["tile_id", "band"]).select("obs_id", "tile_id", "band", us())


@query("SELECT obs_id, tile_id, satellite_id, band FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, satellite_id, band ORDER BY time, obs_id) AS i FROM observations) WHERE i = 3")
def isel_time(spark, sf):
    return ops.at_position(obs(spark, sf), ["tile_id", "satellite_id", "band"], 2, ["time", "obs_id"]).select("obs_id", "tile_id", "satellite_id", "band")


@query("""SELECT obs_id FROM (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY tile_id, satellite_id, band) AS n FROM observations WINDOW w AS (PARTITION BY tile_id, satellite_id, band ORDER BY time, obs_id))
 WHERE i >= n - 4 AND i < n - 1""")
def isel_time_slice(spark, sf):
    return ops.at_position(obs(spark, sf), ["tile_id", "satellite_id", "band"], slice(-4, -1), ["time", "obs_id"]).select("obs_id")


# projections and reshaping
_PIXELS = """SELECT obs_id, tile_id, satellite_id, product_id, band, time, unnest(range(len(pixels))) AS i, unnest(pixels) AS value, unnest(mask) AS valid FROM observations"""


@query(f"SELECT obs_id, CAST(i // 4 AS INT) AS y, CAST(i % 4 AS INT) AS x, value, valid FROM ({_PIXELS})")
def explode_pixels(spark, sf):
    return ops.explode_pixels(obs(spark, sf), ["obs_id"])


@query("""WITH t AS (SELECT obs_id, pixels, CAST(regexp_extract(tile_id, '^x(-?[0-9]{4,})_', 1) AS INT) AS tx, CAST(regexp_extract(tile_id, '_y(-?[0-9]{4,})$', 1) AS INT) AS ty FROM observations WHERE regexp_matches(tile_id, '^x-?[0-9]{4,}_y-?[0-9]{4,}$')),
 b AS (SELECT *, ty * 2560.0 / 111319.49079327358 AS miny, (ty + 1) * 2560.0 / 111319.49079327358 AS maxy FROM t),
 c AS (SELECT *, cos(radians((miny + maxy) / 2)) * 111319.49079327358 AS s FROM b),
 p AS (SELECT *, unnest(range(16)) AS i FROM c)
SELECT obs_id, CAST(i // 4 AS INT) AS y, CAST(i % 4 AS INT) AS x, round(tx * 2560.0 / s + (i % 4) * ((tx + 1) * 2560.0 / s - tx * 2560.0 / s) / 3, 7) AS lon, round(maxy + (i // 4) * (miny - maxy) / 3, 7) AS lat FROM p""")
def pixel_lonlat(spark, sf):
    px = ops.pixel_places(obs(spark, sf), ["obs_id"])
    return px.select("obs_id", "y", "x", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


_KEYS = ["tile_id", "satellite_id", "time"]


def _aligned_sql(*bands: str, where: str = "true") -> str:
    picks = ", ".join(f"arg_max(pixels, obs_id) FILTER (band = '{b}') AS {b}" for b in bands)
    names = ", ".join(f"'{b}'" for b in bands)
    return f"SELECT tile_id, satellite_id, time, {picks} FROM observations WHERE band IN ({names}) AND {where} GROUP BY 1, 2, 3"


def _aligned(df: DataFrame, *bands: str) -> DataFrame:
    return ops.band_arrays(df, list(bands), _KEYS)


@query(f"SELECT tile_id, satellite_id, epoch_us(time) AS time_us, blue, green, red, nir FROM ({_aligned_sql('blue', 'green', 'red', 'nir')})")
def pivot_bands(spark, sf):
    return _aligned(obs(spark, sf), "blue", "green", "red", "nir").select("tile_id", "satellite_id", us(), "blue", "green", "red", "nir")


_PX = "SELECT tile_id, satellite_id, epoch_us(time) AS time_us, CAST(i AS INT) AS i, {e} AS value FROM (SELECT *, unnest(range(16)) AS i FROM ({a})) WHERE {w}"


def _per_pixel(df: DataFrame, value) -> DataFrame:
    """One row per pixel from an array column."""
    return df.select("tile_id", "satellite_id", us(), F.posexplode(value).alias("i", "value"))


def _zip2(a: str, b: str, f):
    return F.zip_with(a, b, lambda p, q: f(p.cast("double"), q.cast("double")))


def _div_sql(n: str, d: str) -> str:
    return f"(CASE WHEN {d} = 0 THEN CASE WHEN {n} > 0 THEN 'inf'::DOUBLE WHEN {n} < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE {n} / {d} END)"


_NDVI = _div_sql("CAST(nir[i + 1] - red[i + 1] AS DOUBLE)", "CAST(nir[i + 1] + red[i + 1] AS DOUBLE)")


@query(_PX.format(e=_NDVI, a=_aligned_sql("red", "nir"), w="red IS NOT NULL AND nir IS NOT NULL"))
def ndvi_pixels(spark, sf):
    return _per_pixel(_aligned(obs(spark, sf), "red", "nir"), _zip2("nir", "red", expr.ndvi))


@query(_PX.format(e="2.5 * " + _div_sql("CAST(nir[i + 1] - red[i + 1] AS DOUBLE)", "(nir[i + 1] + 6.0 * CAST(red[i + 1] AS DOUBLE) - 7.5 * CAST(blue[i + 1] AS DOUBLE) + 1.0)"), a=_aligned_sql("blue", "red", "nir"), w="blue IS NOT NULL AND red IS NOT NULL AND nir IS NOT NULL"))
def evi_pixels(spark, sf):
    df = _aligned(obs(spark, sf), "blue", "red", "nir").where("blue IS NOT NULL AND red IS NOT NULL AND nir IS NOT NULL")
    z = F.arrays_zip("nir", "red", "blue")
    return _per_pixel(df, F.transform(z, lambda s: expr.evi(s["nir"], s["red"], s["blue"])))


@query(_PX.format(e=f"(nir[i + 1] + 2.0 * red[i + 1]) - red[i + 1] * 0.5 + {_div_sql('1.0', '(nir[i + 1] - 100.0)')}", a=_aligned_sql("red", "nir"), w="red IS NOT NULL AND nir IS NOT NULL"))
def band_arith(spark, sf):
    """The operators of cubes: bands as cubes of one number per cell, joined cell by cell."""
    both = _aligned(obs(spark, sf), "red", "nir").where("red IS NOT NULL AND nir IS NOT NULL")
    dims = ["tile_id", "satellite_id", "time", "i"]
    nir, red = (cubes.Cube.of(both.select(*dims[:3], F.posexplode(b).alias("i", "value")), dims) for b in ("nir", "red"))
    out = (nir + red * 2.0) - red * 0.5 + 1.0 / (nir - 100.0)
    return out.df.select("tile_id", "satellite_id", us(), "i", "value")


@query(_PX.format(e=f"CASE WHEN nir[i + 1] > red[i + 1] THEN sqrt(CAST(abs({_NDVI}) AS DOUBLE)) ELSE greatest(0.0, least({_NDVI}, 1.0)) END", a=_aligned_sql("red", "nir"), w="red IS NOT NULL AND nir IS NOT NULL AND nir[i + 1] + red[i + 1] <> 0"))
def bandmath_expr(spark, sf):
    text = "np.where(b1 > red, np.sqrt(np.abs((b1 - b0) / (b1 + b0))), np.maximum(0, np.minimum((nir - red) / (nir + red), 1)))"
    df = _aligned(obs(spark, sf), "red", "nir")
    z = F.filter(F.arrays_zip("red", "nir", F.sequence(F.lit(0), F.lit(15)).alias("k")), lambda s: s["nir"] + s["red"] != 0)
    px = df.where("red IS NOT NULL AND nir IS NOT NULL").select("tile_id", "satellite_id", us(), F.explode(z).alias("s"))
    value = compile_expression(text, {"red": F.col("s.red"), "nir": F.col("s.nir")})
    return px.select("tile_id", "satellite_id", "time_us", F.col("s.k").alias("i"), value.alias("value"))


@query(f"""WITH v AS (SELECT tile_id, strftime(time AT TIME ZONE 'UTC', '%Y-%m') AS month, {_NDVI} AS v FROM (SELECT *, unnest(range(16)) AS i FROM ({_aligned_sql("red", "nir")})) WHERE red IS NOT NULL AND nir IS NOT NULL)
SELECT tile_id, month, count(*) AS n, round(avg(v), 6) AS ndvi FROM v WHERE v BETWEEN -1 AND 1 GROUP BY 1, 2""")
def ndvi_tile_month(spark, sf):
    """Flagship: align bands, per-pixel index, keep its valid range, monthly mean per tile."""
    df = _aligned(obs(spark, sf), "red", "nir").where("red IS NOT NULL AND nir IS NOT NULL")
    v = F.filter(_zip2("nir", "red", expr.ndvi), lambda p: p.between(-1.0, 1.0))
    per = df.select("tile_id", expr.year_month(F.col("time")).alias("month"), F.size(v).cast("long").alias("n"), F.aggregate(v, F.lit(0.0), lambda a, p: a + p).alias("s"))
    return per.groupBy("tile_id", "month").agg(F.sum("n").alias("n"), F.round(F.try_divide(F.sum("s"), F.sum("n").cast("double")), 6).alias("ndvi")).where("n > 0")


# cube reductions over all tiles and products
_PLACE = ["tile_id", "product_id"]
_CELLS = f"(SELECT tile_id, product_id, band, time, CAST(i // 4 AS INT) AS y, CAST(i % 4 AS INT) AS x, value FROM ({_PIXELS}) WHERE valid)"


def _cube(spark, sf) -> cubes.Cube:
    px = ops.explode_pixels(obs(spark, sf), [*_PLACE, "band", "time"]).where("valid")
    return cubes.Cube.of(px, [*_PLACE, "band", "time", "y", "x"])


@query(f"SELECT tile_id, band, year_month, count(*) AS n FROM observations GROUP BY 1, 2, 3")
def count_observations(spark, sf):
    return obs(spark, sf).groupBy("tile_id", "band", "year_month").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT obs_id, tile_id, band, epoch_us(time) AS time_us, pixels[2 * 4 + 1 + 1] AS value FROM observations")
def point_timeseries(spark, sf):
    """Series of the point at 0.3 of every tile's width and 0.6 of its height, over all times."""
    side = ops.width_of(F.size("pixels"))
    at = F.floor(side * 0.6) * side + F.floor(side * 0.3)
    return obs(spark, sf).select("obs_id", "tile_id", "band", us(), F.get("pixels", at.cast("int")).alias("value"))


@query(f"SELECT tile_id, product_id, band, y, x, sum(value) / CAST(count(value) AS DOUBLE) AS value FROM {_CELLS} GROUP BY 1, 2, 3, 4, 5")
def mean_time(spark, sf):
    return _cube(spark, sf).reduce("mean", "time").df


@query(f"SELECT tile_id, product_id, band, epoch_us(time) AS time_us, sum(value) / CAST(count(value) AS DOUBLE) AS value FROM {_CELLS} GROUP BY 1, 2, 3, 4")
def mean_yx(spark, sf):
    return _cube(spark, sf).reduce("mean", ["y", "x"]).df.select(*_PLACE, "band", us(), "value")


@query(f"SELECT tile_id, product_id, sum(value) / CAST(count(value) AS DOUBLE) AS value FROM {_CELLS} GROUP BY 1, 2")
def mean_all(spark, sf):
    return _cube(spark, sf).reduce("mean", ["band", "time", "y", "x"]).df


@query(f"SELECT tile_id, product_id, band, y, x, CAST(max(value) AS DOUBLE) AS hi, CAST(min(value) AS DOUBLE) AS lo FROM {_CELLS} GROUP BY 1, 2, 3, 4, 5")
def max_min_time(spark, sf):
    return _cube(spark, sf).df.groupBy(*_PLACE, "band", "y", "x").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))


@query(f"SELECT tile_id, product_id, band, y, x, CAST(median(value) AS DOUBLE) AS value FROM {_CELLS} GROUP BY 1, 2, 3, 4, 5")
def median_time(spark, sf):
    return _cube(spark, sf).reduce("median", "time").df


@query(f"SELECT tile_id, product_id, band, round(stddev_pop(value), 4) AS value FROM {_CELLS} GROUP BY 1, 2, 3")
def std_time(spark, sf):
    return _cube(spark, sf).reduce("std", ["time", "y", "x"]).df.withColumn("value", F.round("value", 4))


@query(f"""WITH c AS {_CELLS}, n AS (SELECT tile_id, product_id, band, arg_min(y, (abs(y - 2.4), y)) AS y FROM c GROUP BY 1, 2, 3)
SELECT tile_id, product_id, band, epoch_us(time) AS time_us, x, CAST(value AS DOUBLE) AS value FROM c JOIN n USING (tile_id, product_id, band, y)""")
def nearest_label_sel(spark, sf):
    """The row of pixels nearest to y = 2.4 of every tile, product and band."""
    c = _cube(spark, sf).df
    keys = [*_PLACE, "band"]
    label = c.groupBy(*keys).agg(F.min_by("y", F.struct(F.abs(F.col("y") - 2.4), "y")).alias("y"))
    return c.join(label, [*keys, "y"]).select(*keys, us(), "x", "value")


@query(f"SELECT tile_id, product_id, band, epoch_us(time) AS time_us, y, x, CAST(value AS DOUBLE) AS value FROM {_CELLS} WHERE y BETWEEN 1 AND 2 AND x IN (0, 2)")
def label_slice_sel(spark, sf):
    """Slices whose ends are snapped to the nearest labels, both included; a step counts labels."""
    return _cube(spark, sf).sel("y", slice(0.6, 2.3)).sel("x", slice(None, None, 2)).df.select(*_PLACE, "band", us(), "y", "x", "value")


@query(f"SELECT tile_id, product_id, band, CAST(count(*) FILTER (value % 2 = 1) AS DOUBLE) AS value FROM {_CELLS} GROUP BY 1, 2, 3")
def reduce_by_function(spark, sf):
    """A reduction by any aggregate."""
    return _cube(spark, sf).reduce(lambda v: F.count_if(v % 2 == 1), ["time", "y", "x"]).df


@query(f"""WITH c AS (SELECT tile_id, product_id, band, time, y, x, max(value) AS value FROM {_CELLS} GROUP BY 1, 2, 3, 4, 5, 6), t AS (SELECT DISTINCT tile_id, product_id, band, time FROM c), p AS (SELECT DISTINCT tile_id, product_id, band, y, x FROM c)
SELECT tile_id, product_id, band, epoch_us(time) AS time_us, y, x, c.value FROM t JOIN p USING (tile_id, product_id, band) LEFT JOIN c USING (tile_id, product_id, band, time, y, x)""")
def scene_outer_align(spark, sf):
    """Dense union of the scenes of each tile, product and band."""
    keys = [*_PLACE, "band"]
    cells = ops.explode_pixels(obs(spark, sf), [*keys, "time"]).where("valid").groupBy(*keys, "time", "y", "x").agg(F.max("value").alias("value"))
    return cubes.align_outer(cells, {"by": keys, "outer": ["time"], "inner": ["y", "x"]}).select(*keys, us(), "y", "x", "value")


def _resample(how: str, period: str):
    def run(spark, sf):
        c = _cube(spark, sf).resample(period, how)
        return c.df.select(F.date_format("time", "yyyy-MM-dd").alias("start"), *_PLACE, "band", "y", "x", "value")

    return run


for _how, _agg in {"mean": "sum(value) / CAST(count(value) AS DOUBLE)", "max": "CAST(max(value) AS DOUBLE)", "min": "CAST(min(value) AS DOUBLE)", "median": "CAST(median(value) AS DOUBLE)"}.items():
    for _name, _period, _unit in ((f"resample_1m_{_how}", "1M", "month"), *([("resample_1w_mean", "1W", "week")] if _how == "mean" else [])):
        QUERIES[_name] = _resample(_how, _period)
        ORACLE[_name] = canonical_sql(f"SELECT strftime(date_trunc('{_unit}', time AT TIME ZONE 'UTC'), '%Y-%m-%d') AS start, tile_id, product_id, band, y, x, {_agg} AS value FROM {_CELLS} GROUP BY 1, 2, 3, 4, 5, 6")


# statistics and catalogue
@query("""WITH v AS (SELECT obs_id, pixels, list_filter(list_zip(pixels, mask), lambda s: s[2]) AS ok FROM observations),
 w AS (SELECT obs_id, CASE WHEN len(ok) > 0 THEN list_transform(ok, lambda s: s[1]) ELSE pixels END AS p FROM v)
SELECT obs_id, CAST(list_min(p) AS FLOAT) AS min_value, CAST(list_max(p) AS FLOAT) AS max_value, CAST(CAST(list_sum(p) AS DOUBLE) / len(p) AS FLOAT) AS mean_value FROM w""")
def obs_stats_valid(spark, sf):
    return obs(spark, sf).select("obs_id", *[c.alias(n) for n, c in ops.pixel_stats(F.col("pixels"), F.col("mask")).items()])


_MEASURED = """(SELECT tile_id, satellite_id, product_id, band, year_month, time, obs_id, cloud_cover, resolution, list_min(p) AS min_value, list_max(p) AS max_value, CAST(list_sum(p) AS DOUBLE) / len(p) AS mean_value
 FROM (SELECT *, CASE WHEN len(ok) > 0 THEN list_transform(ok, lambda s: s[1]) ELSE pixels END AS p FROM (SELECT *, list_filter(list_zip(pixels, mask), lambda s: s[2]) AS ok FROM observations)))"""


def measured(spark, sf) -> DataFrame:
    """All observations with statistics of their pixels in the place of the stored ones, some of which are wild."""
    return obs(spark, sf).withColumns(ops.pixel_stats(F.col("pixels"), F.col("mask")))


_ROLLUP = f"""SELECT tile_id, year_month, band, count(*) AS num_observations, CAST(min(min_value) AS DOUBLE) AS min_value, CAST(max(max_value) AS DOUBLE) AS max_value, avg(CAST(mean_value AS FLOAT)) AS mean_value,
 coalesce(avg(CAST(cloud_cover AS DOUBLE)) FILTER (NOT isnan(cloud_cover)), 0) AS cloud_cover, min(product_id) AS product_id, CAST(min(resolution) AS DOUBLE) AS resolution FROM {_MEASURED} GROUP BY 1, 2, 3"""


@query(f"SELECT tile_id, year_month, band, num_observations, min_value, max_value, round(mean_value, 3) AS mean_value, round(cloud_cover, 4) AS cloud_cover, product_id, resolution FROM ({_ROLLUP})")
def tile_month_rollup(spark, sf):
    return ops.tile_month_rollup(measured(spark, sf)).withColumns({"mean_value": F.round("mean_value", 3), "cloud_cover": F.round("cloud_cover", 4)}).drop("bounds_wkb")


@query(f"SELECT tile_id, band, min(min_value) AS min_value, max(max_value) AS max_value, round(avg(mean_value), 3) AS mean_value, round(avg(cloud_cover), 4) AS cloud_cover, CAST(sum(num_observations) AS BIGINT) AS num_observations FROM ({_ROLLUP}) GROUP BY 1, 2")
def tile_band_statistics(spark, sf):
    return ops.tile_band_statistics(ops.tile_month_rollup(measured(spark, sf))).withColumns({"mean_value": F.round("mean_value", 3), "cloud_cover": F.round("cloud_cover", 4)})


@query("SELECT tile_id, year_month, band, first(bounds_wkb ORDER BY time, obs_id) FILTER (bounds_wkb IS NOT NULL) AS bounds_wkb FROM observations GROUP BY 1, 2, 3")
def rollup_bounds(spark, sf):
    """The first bounds that a tile, month and band has."""
    return ops.tile_month_rollup(obs(spark, sf)).select("tile_id", "year_month", "band", "bounds_wkb")


@query("""WITH v AS (SELECT tile_id, band, list_filter(list_zip(pixels, mask), lambda s: s[2]) AS ok, pixels FROM observations), w AS (SELECT tile_id, band, CASE WHEN len(ok) > 0 THEN list_transform(ok, lambda s: s[1]) ELSE pixels END AS p FROM v)
SELECT tile_id, band, CAST(sum(len(p)) AS BIGINT) AS n_pixels, CAST(sum(list_sum(p)) AS BIGINT) AS pixel_sum FROM w GROUP BY 1, 2""")
def weighted_mean(spark, sf):
    return ops.weighted_mean(obs(spark, sf), ["tile_id", "band"])


@query(f"SELECT DISTINCT {tile_sql('tile_id')} AS tile_id FROM observations")
def distinct_tiles(spark, sf):
    return obs(spark, sf).select(tiles.canonical_or_self("tile_id").alias("tile_id")).distinct().orderBy("tile_id")


@query("SELECT DISTINCT unnest(band_names) AS band FROM scenes_index")
def distinct_bands(spark, sf):
    return table(spark, sf, "scenes_index").select(F.explode("band_names").alias("band")).distinct().orderBy("band")


@query("SELECT DISTINCT product_id FROM scenes_index WHERE product_id IS NOT NULL")
def distinct_products(spark, sf):
    return table(spark, sf, "scenes_index").select("product_id").where("product_id IS NOT NULL").distinct().orderBy("product_id")


@query("SELECT min(epoch_us(time)) AS first_us, max(epoch_us(time)) AS last_us FROM observations WHERE product_id = 'kestrel_sr'")
def time_extent(spark, sf):
    return obs(spark, sf).where("product_id = 'kestrel_sr'").agg(F.min(F.unix_micros("time")).alias("first_us"), F.max(F.unix_micros("time")).alias("last_us"))


@query(_SCENES + """, g AS (SELECT product_id, count(*) AS scenes, min(epoch_us(instant)) AS first_us, max(epoch_us(instant)) AS last_us FROM b GROUP BY 1),
 n AS (SELECT product_id, list_sort(list_distinct(flatten(list(band_names)))) AS bands FROM scenes_index GROUP BY 1)
SELECT g.product_id, scenes, first_us, last_us, n.bands, p.provider, p.resolution FROM g LEFT JOIN n USING (product_id) LEFT JOIN product_profiles p USING (product_id)""")
def warehouse_summary(spark, sf):
    s = scenes(spark, sf).drop("acquisition_time").withColumnRenamed("instant", "acquisition_time")
    per = api.product_summary(s, table(spark, sf, "product_profiles").select("product_id", "provider", "resolution"))
    return per.select("product_id", "scenes", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "bands", "provider", "resolution")


@query("SELECT product_id, list_sort(list_distinct(flatten(list(band_names)))) AS bands FROM scenes_index GROUP BY 1")
def band_union(spark, sf):
    return table(spark, sf, "scenes_index").groupBy("product_id").agg(api.all_bands().alias("bands"))


@query(f"""WITH s AS (SELECT tile_id, satellite_id, band, mean_value AS v, row_number() OVER (PARTITION BY tile_id, satellite_id, band ORDER BY time, obs_id) - 1 AS x FROM {_MEASURED})
SELECT tile_id, satellite_id, band, count(*) AS n, round(avg(v), 3) AS mean, round(min(v), 3) AS min, round(max(v), 3) AS max, round(stddev_pop(v), 2) AS std, round(regr_slope(v, x), 2) AS slope FROM s GROUP BY 1, 2, 3""")
def series_trend(spark, sf):
    """Every observation counts and has a position; its value is the mean of its valid pixels."""
    v = ops.valid_pixels(F.col("pixels"), F.col("mask"))
    value = F.try_divide(F.aggregate(v, F.lit(0).cast("long"), lambda a, p: a + p).cast("double"), F.size(v).cast("double"))
    df = obs(spark, sf).select("tile_id", "satellite_id", "band", F.struct("time", "obs_id").alias("at"), value.alias("value"))
    t = cubes.trend(df, ["tile_id", "satellite_id", "band"], "at", "value")
    return t.withColumns({c: F.round(c, 3) for c in ("mean", "min", "max")} | {c: F.round(c, 2) for c in ("std", "slope")})


@query("SELECT count(*) AS records, count(DISTINCT tile_id) AS tiles, list_sort(list(DISTINCT band)) AS bands, min(epoch_us(time)) AS first_us, max(epoch_us(time)) AS last_us FROM observations")
def info_report(spark, sf):
    return summarised(obs(spark, sf)).select("records", "tiles", "bands", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query("SELECT regexp_extract(lower(chunk_path), '(\\.[a-z]+)$', 1) AS suffix, count(*) AS files, CAST(sum(file_bytes) AS BIGINT) AS bytes FROM tile_metadata GROUP BY 1")
def storage_stats(spark, sf):
    return by_suffix(table(spark, sf, "tile_metadata").select(F.col("chunk_path").alias("path"), F.col("file_bytes").alias("bytes")))


@query("""SELECT tile_id, band, year_month, coalesce(l.n, 0) AS listed, coalesce(s.n, 0) AS stored FROM (SELECT tile_id, band, year_month, count(*) AS n FROM tile_metadata GROUP BY 1, 2, 3) l
 FULL JOIN (SELECT tile_id, band, year_month, count(*) AS n FROM observations GROUP BY 1, 2, 3) s USING (tile_id, band, year_month) WHERE l.n IS DISTINCT FROM s.n""")
def migration_check(spark, sf):
    """Chunks of the catalogue against those of the store: what differs in number."""
    diff = maintenance.chunk_counts_differ(obs(spark, sf, "tile_metadata"), obs(spark, sf))
    return diff.select("tile_id", "band", "year_month", F.col("in_files").alias("listed"), "stored")


@query("SELECT tile_id, band, obs_id, epoch_us(time) AS time_us FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, band ORDER BY time DESC, obs_id DESC) AS r FROM observations) WHERE r = 1")
def latest_per_tile(spark, sf):
    newest = obs(spark, sf).groupBy("tile_id", "band").agg(F.max(F.struct("time", "obs_id")).alias("n"))
    return newest.select("tile_id", "band", "n.obs_id", F.unix_micros("n.time").alias("time_us"))


@query("SELECT obs_id, epoch_us(time) AS time_us FROM observations ORDER BY time, obs_id LIMIT 10")
def first_observations(spark, sf):
    return obs(spark, sf).orderBy("time", "obs_id").limit(10).select("obs_id", us())


# products, masks and radiometry
@query("""SELECT obs_id, CAST(i AS INT) AS i, CASE WHEN value <> nodata THEN value * scale_factor + value_offset END AS value FROM (SELECT o.obs_id, unnest(range(len(pixels))) AS i, unnest(pixels) AS value, p.* EXCLUDE (product_id) FROM (SELECT obs_id, product_id, pixels FROM observations) o JOIN product_profiles p USING (product_id))""")
def reflectance(spark, sf):
    r = products.to_reflectance(obs(spark, sf).select("obs_id", "product_id", "pixels"), table(spark, sf, "product_profiles"))
    return r.select("obs_id", F.posexplode("reflectance").alias("i", "value"))


@query("SELECT obs_id, list_transform(pixels, lambda p: p <> nodata) AS valid FROM observations JOIN product_profiles USING (product_id)")
def nodata_mask(spark, sf):
    p = table(spark, sf, "product_profiles").select("product_id", "nodata")
    return obs(spark, sf).join(p, "product_id").select("obs_id", ops.mask_nodata(F.col("pixels"), F.col("nodata")).alias("valid"))


@query(f"""WITH a AS ({_aligned_sql("green", "red")}), p AS (SELECT tile_id, satellite_id, time, unnest(red) AS v, unnest(green) AS q FROM a WHERE red IS NOT NULL AND green IS NOT NULL)
SELECT tile_id, satellite_id, epoch_us(time) AS time_us, count(*) FILTER (q % 8 IN (0, 1, 2, 5)) AS n, CAST(sum(v) FILTER (q % 8 IN (0, 1, 2, 5)) AS DOUBLE) / nullif(count(*) FILTER (q % 8 IN (0, 1, 2, 5)), 0) AS value FROM p GROUP BY 1, 2, 3""")
def cloud_masked_mean(spark, sf):
    """The low bits of another band stand for a quality band with eight classes, four of them clear."""
    df = _aligned(obs(spark, sf), "green", "red").where("red IS NOT NULL AND green IS NOT NULL")
    kept = F.filter(ops.keep_clear(F.col("red"), F.transform("green", lambda q: q % 8), [0, 1, 2, 5]), lambda p: p.isNotNull())
    total = F.aggregate(kept, F.lit(0).cast("long"), lambda a, p: a + p)
    n = F.size(kept).cast("long")
    return df.select("tile_id", "satellite_id", us(), n.alias("n"), F.try_divide(total.cast("double"), n.cast("double")).alias("value"))


@query("SELECT product_id, list_transform(list_sort(list_transform(map_entries(bands), lambda e: (e.value, e.key))), lambda s: s[2]) AS band_names, len(map_keys(bands)) AS band_count FROM product_profiles")
def ordered_bands(spark, sf):
    return table(spark, sf, "product_profiles").select("product_id", products.ordered_bands(F.col("bands")).alias("band_names"), F.size("bands").cast("long").alias("band_count"))


@query("SELECT product_id, band, native_name FROM product_bands WHERE resolution = 10.0")
def bands_of_resolution(spark, sf):
    return products.bands_of_resolution(table(spark, sf, "product_bands"), 10.0).select("product_id", "band", "native_name")


@query("SELECT band FROM product_bands GROUP BY band HAVING count(DISTINCT product_id) = (SELECT count(DISTINCT product_id) FROM product_bands)")
def common_bands(spark, sf):
    return products.common_bands(table(spark, sf, "product_bands"))


@query("SELECT product_id, band, wavelength FROM product_bands WHERE native_name IN ('H04', 'M01')")
def band_by_native_name(spark, sf):
    return products.bands_by_native_name(table(spark, sf, "product_bands"), ["H04", "M01"]).select("product_id", "band", "wavelength")


@query()
def profile_json(spark, sf):
    return products.as_json(table(spark, sf, "product_profiles"))


# grid
@query("""WITH i AS (SELECT site_id, CAST(floor(lon * 111319.49079327358 * cos(radians(lat)) / 2560.0) AS INT) AS x, CAST(floor(lat * 111319.49079327358 / 2560.0) AS INT) AS y FROM sites)
SELECT site_id, 'x' || CASE WHEN x < 0 THEN printf('%05d', x) ELSE printf('%04d', x) END || '_y' || CASE WHEN y < 0 THEN printf('%05d', y) ELSE printf('%04d', y) END AS tile_id FROM i""")
def tile_id_points(spark, sf):
    return table(spark, sf, "sites").select("site_id", tiles.tile_of_point(F.col("lon"), F.col("lat")).alias("tile_id"))


_BOUNDS = """WITH t AS (SELECT DISTINCT CAST(regexp_extract(tile_id, '[xX]([+-]?[0-9]+)', 1) AS INT) AS x, CAST(regexp_extract(tile_id, '[yY]([+-]?[0-9]+)', 1) AS INT) AS y FROM observations),
 b AS (SELECT *, y * 2560.0 / 111319.49079327358 AS miny, (y + 1) * 2560.0 / 111319.49079327358 AS maxy FROM t), c AS (SELECT *, cos(radians((miny + maxy) / 2)) * 111319.49079327358 AS s FROM b)
 """


@query(_BOUNDS + "SELECT x, y, round(x * 2560.0 / s, 9) AS minx, round(miny, 9) AS miny, round((x + 1) * 2560.0 / s, 9) AS maxx, round(maxy, 9) AS maxy FROM c")
def tile_bounds(spark, sf):
    t = obs(spark, sf).select(tiles.tile_x("tile_id").alias("x"), tiles.tile_y("tile_id").alias("y")).distinct()
    b = t.select("x", "y", tiles.tile_bounds(F.col("x"), F.col("y")).alias("b"))
    return b.select("x", "y", *[F.round(f"b.{c}", 9).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


def _tiles_sql(box: tuple[float, float, float, float]) -> str:
    x0, y0, x1, y1 = box
    return f"""WITH ys AS (SELECT unnest(range(CAST(floor(CAST({y0} AS DOUBLE) * 111319.49079327358 / 2560.0) AS BIGINT) - 1, CAST(floor(CAST({y1} AS DOUBLE) * 111319.49079327358 / 2560.0) AS BIGINT) + 2)) AS y),
 b AS (SELECT y, y * 2560.0 / 111319.49079327358 AS miny, (y + 1) * 2560.0 / 111319.49079327358 AS maxy FROM ys), c AS (SELECT *, cos(radians((miny + maxy) / 2)) * 111319.49079327358 AS s FROM b),
 g AS (SELECT *, unnest(range(CAST(floor(CAST({x0} AS DOUBLE) * s / 2560.0) AS BIGINT) - 1, CAST(floor(CAST({x1} AS DOUBLE) * s / 2560.0) AS BIGINT) + 2)) AS x FROM c)
SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM g WHERE x * 2560.0 / s <= {x1} AND (x + 1) * 2560.0 / s >= {x0} AND miny <= {y1} AND maxy >= {y0}"""


@query(_tiles_sql((-0.4, -0.3, 0.5, 0.35)))
def tiles_in_bounds(spark, sf):
    return spatial.tiles_in_box(spark, (-0.4, -0.3, 0.5, 0.35)).select("x", "y")


@query("SELECT product_id, band, CAST(ceil(2560.0 / resolution) AS INT) AS pixels FROM product_bands")
def pixels_for_resolution(spark, sf):
    return table(spark, sf, "product_bands").select("product_id", "band", tiles.pixels_across("resolution").alias("pixels"))


@query("""SELECT site_id, record FROM (SELECT s.site_id, o.tile AS record, row_number() OVER (PARTITION BY s.site_id, o.tile) AS r FROM (SELECT site_id, CAST(floor(lon * 111319.49079327358 * cos(radians(lat)) / 2560.0) AS INT) AS x,
 CAST(floor(lat * 111319.49079327358 / 2560.0) AS INT) AS y FROM sites) s JOIN (SELECT DISTINCT tile_id AS tile, CAST(regexp_extract(tile_id, '[xX]([+-]?[0-9]+)', 1) AS INT) AS x, CAST(regexp_extract(tile_id, '[yY]([+-]?[0-9]+)', 1) AS INT) AS y FROM observations) o USING (x, y)) WHERE r = 1""")
def point_in_tile_join(spark, sf):
    """Points meet tiles by an equi-join on the computed id, not by a range join."""
    sites = table(spark, sf, "sites").select("site_id", tiles.tile_of_point(F.col("lon"), F.col("lat")).alias("id"))
    seen = obs(spark, sf).select(F.col("tile_id").alias("record")).distinct()
    return sites.join(seen, F.col("id") == F.col("record")).select("site_id", "record")


TRIANGLE = [(10.0, 45.0), (11.0, 45.1), (10.4, 45.9)]
GEOJSON = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[*map(list, TRIANGLE), list(TRIANGLE[0])]]}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [12.0, 45.0]}}]}


def _apart_sql() -> str:
    """A box meets a convex polygon unless an axis keeps them apart: here the normals of the polygon's edges, the box's own
    axes being taken by its tiles' range."""
    tests = []
    for (px, py), (qx, qy) in zip(TRIANGLE, [*TRIANGLE[1:], TRIANGLE[0]]):
        a, b = qy - py, px - qx
        at = [a * x + b * y for x, y in TRIANGLE]
        low = f"{a!r} * {'minx' if a > 0 else 'maxx'} + {b!r} * {'miny' if b > 0 else 'maxy'}"
        high = f"{a!r} * {'maxx' if a > 0 else 'minx'} + {b!r} * {'maxy' if b > 0 else 'miny'}"
        tests.append(f"{low} <= {max(at)!r} AND {high} >= {min(at)!r}")
    return " AND ".join(tests)


@query(f"""WITH t AS (SELECT x, y FROM ({_tiles_sql((10.0, 45.0, 12.0, 45.9))})), b AS (SELECT *, y * 2560.0 / 111319.49079327358 AS miny, (y + 1) * 2560.0 / 111319.49079327358 AS maxy FROM t),
 c AS (SELECT *, cos(radians((miny + maxy) / 2)) * 111319.49079327358 AS s FROM b), d AS (SELECT *, x * 2560.0 / s AS minx, (x + 1) * 2560.0 / s AS maxx FROM c)
SELECT 'x' || printf('%04d', x) || '_y' || printf('%04d', y) AS tile_id, x, y FROM d
WHERE (minx <= 11.0 AND {_apart_sql()}) OR (12.0 BETWEEN minx AND maxx AND 45.0 BETWEEN miny AND maxy)""")
def polygon_tiles(spark, sf):
    return spatial.SpatialQuery().from_geojson(GEOJSON).tiles(spark).select("tile_id", "x", "y")


@query()
def clipped_tiles(spark, sf):
    found = spatial.tiles_meeting(spark, [TRIANGLE])
    return spatial.clipped_area(found, [TRIANGLE]).select("tile_id", F.round("share", 6).alias("share"))


@query(f"""WITH t AS ({_tiles_sql((126.5, 36.5, 127.5, 37.5))}), b AS (SELECT *, y * 2560.0 / 111319.49079327358 AS miny, (y + 1) * 2560.0 / 111319.49079327358 AS maxy FROM t), c AS (SELECT *, cos(radians((miny + maxy) / 2)) * 111319.49079327358 AS s FROM b),
 d AS (SELECT x, y, greatest(x * 2560.0 / s - 127.0::DOUBLE, 127.0::DOUBLE - (x + 1) * 2560.0 / s, 0) AS dx, greatest(miny - 37.0::DOUBLE, 37.0::DOUBLE - maxy, 0) AS dy FROM c)
SELECT x, y FROM d WHERE dx * dx + dy * dy <= (20.0::DOUBLE / 111.32) * (20.0::DOUBLE / 111.32)""")
def buffer_tiles(spark, sf):
    return spatial.SpatialQuery().from_point(127.0, 37.0).buffer_km(20.0).tiles(spark).select("x", "y")


@query("SELECT DISTINCT tile_id FROM tile_metadata WHERE tile_id IN (SELECT tile_id FROM observations)")
def available_tiles_semi(spark, sf):
    return obs(spark, sf, "tile_metadata").select("tile_id").distinct().join(obs(spark, sf).select("tile_id").distinct(), "tile_id", "left_semi")


@query("SELECT b AS band FROM (VALUES ('red'), ('nir'), ('thermal'), ('b9')) v(b) WHERE b NOT IN (SELECT band FROM observations)")
def invalid_bands_anti(spark, sf):
    wanted = spark.createDataFrame([(b,) for b in ("red", "nir", "thermal", "b9")], "band string")
    return wanted.join(obs(spark, sf).select("band").distinct(), "band", "left_anti")


@query("SELECT tile_id, band, year_month FROM observations WHERE tile_id IS NOT NULL AND band IS NOT NULL AND year_month IS NOT NULL INTERSECT SELECT tile_id, band, year_month FROM tile_metadata")
def chunks_in_both(spark, sf):
    key = ["tile_id", "band", "year_month"]
    return obs(spark, sf).select(*key).where("tile_id IS NOT NULL AND band IS NOT NULL AND year_month IS NOT NULL").intersect(obs(spark, sf, "tile_metadata").select(*key))


@query("""WITH e AS (SELECT satellite_id, min(time AT TIME ZONE 'UTC') AS lo, max(time AT TIME ZONE 'UTC') AS hi FROM observations GROUP BY 1)
SELECT satellite_id, strftime(m, '%Y-%m') AS month FROM (SELECT satellite_id, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m FROM e)""")
def month_sequence(spark, sf):
    e = obs(spark, sf).groupBy("satellite_id").agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    return e.select("satellite_id", F.explode(expr.months_between(F.col("lo"), F.col("hi"))).alias("month"))


# files, masks and scenes
_NAME = "regexp_extract(source_file, '([^/]+)$', 1)"


@query(rf"""SELECT scene_group, CASE WHEN regexp_extract({_NAME}, '([0-9]{{8}})', 1) <> '' THEN strftime(try_strptime(regexp_extract({_NAME}, '([0-9]{{8}})', 1), '%Y%m%d'), '%Y-%m-%d') END AS day FROM scenes_index""")
def date_from_filename(spark, sf):
    name = F.regexp_extract("source_file", r"([^/]+)$", 1)
    return table(spark, sf, "scenes_index").select("scene_group", F.date_format(expr.date_in_name(name), "yyyy-MM-dd").alias("day"))


@query("SELECT scene_group, string_split(source_file, '/')[-2] AS folder FROM scenes_index WHERE source_file IS NOT NULL")
def product_from_path(spark, sf):
    return table(spark, sf, "scenes_index").where("source_file IS NOT NULL").select("scene_group", expr.product_of_path(F.col("source_file")).alias("folder"))


@query(rf"""WITH d AS (SELECT satellite_id, source_file, mask_source_file, regexp_extract({_NAME}, '_([0-9]{{8}})_', 1) AS day FROM scenes_index WHERE source_file IS NOT NULL),
 m AS (SELECT satellite_id, day, min(mask_source_file) AS mask_file FROM d WHERE mask_source_file IS NOT NULL AND day <> '' GROUP BY 1, 2)
SELECT d.satellite_id, d.source_file, m.mask_file FROM (SELECT DISTINCT satellite_id, source_file, day FROM d) d LEFT JOIN m ON d.satellite_id = m.satellite_id AND d.day = m.day""")
def mask_file_match(spark, sf):
    """Files meet the first mask of their satellite and date."""
    day = F.regexp_extract(F.regexp_extract("source_file", r"([^/]+)$", 1), r"_(\d{8})_", 1)
    d = table(spark, sf, "scenes_index").where("source_file IS NOT NULL").select("satellite_id", "source_file", "mask_source_file", F.when(day != "", day).alias("day"))
    files = d.select("satellite_id", "source_file", "day").distinct()
    found = ingest.with_first_mask(files, d.select("satellite_id", "day", F.col("mask_source_file").alias("path")), ["satellite_id", "day"])
    return found.select("satellite_id", "source_file", F.col("mask_source_file").alias("mask_file"))


@query("""WITH o AS (SELECT obs_id, pixels FROM observations), a AS (SELECT unnest(range(7)) AS k), s AS (SELECT k, k * 0.5 AS p, CAST(floor(k * 0.5) AS INT) AS lo, least(CAST(floor(k * 0.5) AS INT) + 1, 3) AS hi FROM a)
SELECT obs_id, CAST(y.k * 7 + x.k AS INT) AS i, CAST(least(greatest(floor((pixels[y.lo * 4 + x.lo + 1] * (1 - (x.p - x.lo)) + pixels[y.lo * 4 + x.hi + 1] * (x.p - x.lo)) * (1 - (y.p - y.lo)) + (pixels[y.hi * 4 + x.lo + 1] * (1 - (x.p - x.lo)) + pixels[y.hi * 4 + x.hi + 1] * (x.p - x.lo)) * (y.p - y.lo) + 0.5), 0), 65535) AS INT) AS value
FROM o, s y, s x""")
def resample_bilinear(spark, sf):
    df = obs(spark, sf).select("obs_id", raster.bilinear_column(F.col("pixels"), 7, 7).alias("p"))
    return df.select("obs_id", F.posexplode("p").alias("i", "value"))


@query("""WITH s AS (SELECT k, CAST(least(greatest(floor((k + 0.5) * 4 / 6), 0), 3) AS INT) AS n FROM (SELECT unnest(range(6)) AS k))
SELECT obs_id, CAST(y.k * 6 + x.k AS INT) AS i, mask[y.n * 4 + x.n + 1] AS valid FROM observations, s y, s x""")
def resample_nearest(spark, sf):
    df = obs(spark, sf).select("obs_id", raster.nearest_column(F.col("mask"), 6, 6).alias("m"))
    return df.select("obs_id", F.posexplode("m").alias("i", "valid"))


@query(f"""WITH l AS (SELECT tile_id AS tile, arg_max(pixels, (time, obs_id)) AS pixels FROM observations WHERE band = 'red' AND regexp_matches(tile_id, '^x-?[0-9]+_y-?[0-9]+$') GROUP BY 1),
 g AS (SELECT CAST(regexp_extract(tile, '^x(-?[0-9]+)_', 1) AS INT) AS tx, CAST(regexp_extract(tile, '_y(-?[0-9]+)$', 1) AS INT) AS ty, unnest(range(16)) AS i, unnest(pixels) AS value FROM l), o AS (SELECT min(tx) AS x0, max(ty) AS y1 FROM g)
SELECT CAST((y1 - ty) * 4 + i // 4 AS BIGINT) AS row, CAST((tx - x0) * 4 + i % 4 AS BIGINT) AS col, value FROM g, o""")
def mosaic_tiles(spark, sf):
    """Latest image of every tile of the data on one raster; cells between the tiles have no row."""
    df = obs(spark, sf).where((F.col("band") == "red") & tiles.canonical("tile_id").isNotNull())
    newest = df.groupBy("tile_id").agg(F.max_by("pixels", F.struct("time", "obs_id")).alias("pixels")).withColumn("mask", F.transform("pixels", lambda p: F.lit(True)))
    px = ops.explode_pixels(newest.withColumns({"tx": tiles.tile_x("tile_id"), "ty": tiles.tile_y("tile_id")}), ["tx", "ty"])
    seen = df.select("tile_id").distinct()
    x0, y1 = seen.agg(F.min(tiles.tile_x("tile_id"))).scalar(), seen.agg(F.max(tiles.tile_y("tile_id"))).scalar()
    return px.select(((y1 - F.col("ty")) * 4 + F.col("y")).cast("long").alias("row"), ((F.col("tx") - x0) * 4 + F.col("x")).cast("long").alias("col"), "value")


def _history(spark, sf) -> Warehouse:
    """A store in the shared folder that took in the observations in three commits, by the time of their arrival."""
    df, came = obs(spark, sf).select("obs_id", "product_id", "band", "ingestion_time"), F.col("ingestion_time")
    store = Warehouse(spark, f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}", df.schema, ["band"])
    ends = [F.lit(_ts(2023, 12, 31)), F.lit(_ts(2024, 6, 1))]
    store.append(df.where(came <= ends[0]), "until 2023")
    store.append(df.where((came > ends[0]) & (came <= ends[1])), "until June")
    store.append(df.where(came.isNull() | (came > ends[1])), "the rest")
    return store


@query("SELECT product_id, band, count(*) AS n FROM observations WHERE ingestion_time <= TIMESTAMPTZ '2024-06-01 00:00:00+00' GROUP BY 1, 2")
def time_travel_asof(spark, sf):
    """The store as of its second snapshot."""
    store = _history(spark, sf)
    return store.read(as_of=store.log()[1].snapshot_id).groupBy("product_id", "band").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT product_id, band, count(*) AS n FROM observations WHERE ingestion_time <= TIMESTAMPTZ '2023-12-31 00:00:00+00' GROUP BY 1, 2")
def rollback_read(spark, sf):
    """The store taken back to its first snapshot."""
    store = _history(spark, sf)
    store.rollback(store.log()[0].snapshot_id)
    return store.read().groupBy("product_id", "band").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT obs_id, band, product_id FROM observations WHERE band <> 'red' OR product_id = 'halo2_l2a'")
def overwrite_where(spark, sf):
    """One band of the store replaced by a part of it; the files of the others stay."""
    store = _history(spark, sf)
    red = obs(spark, sf).select("obs_id", "product_id", "band", "ingestion_time").where("band = 'red' AND product_id = 'halo2_l2a'")
    store.overwrite(red, F.col("band") == "red")
    return store.read().select("obs_id", "band", "product_id")


@query("""WITH c AS (SELECT CASE WHEN ingestion_time <= TIMESTAMPTZ '2023-12-31 00:00:00+00' THEN 'until 2023' WHEN ingestion_time <= TIMESTAMPTZ '2024-06-01 00:00:00+00' THEN 'until June' ELSE 'the rest' END AS message FROM observations)
SELECT message, 'append' AS operation, count(*) AS records FROM c GROUP BY 1""")
def snapshot_history(spark, sf):
    """The log of the store, one row per commit."""
    return _history(spark, sf).history().select("message", "operation", "records")


@query("SELECT tile_id, satellite_id, product_id, band, epoch_us(time) AS time_us, obs_id FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, satellite_id, product_id, band, time ORDER BY coalesce(epoch_us(ingestion_time), -2208988800000000) DESC, obs_id DESC) AS r FROM observations) WHERE r = 1")
def latest_delivery(spark, sf):
    keys = ["tile_id", "satellite_id", "product_id", "band", "time"]
    return ops.latest_delivery(obs(spark, sf).select(*keys, "ingestion_time", "obs_id"), keys).select("tile_id", "satellite_id", "product_id", "band", us(), "obs_id")


@query("""WITH p AS (SELECT tile_id, band, strftime(time AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, product_id, list_sum(pixels) AS s, len(pixels) AS n FROM observations WHERE band IN ('red', 'nir'))
SELECT tile_id, band, day, count(DISTINCT product_id) AS products, CAST(sum(s) AS DOUBLE) / sum(n) AS value FROM p GROUP BY 1, 2, 3""")
def daily_fusion(spark, sf):
    """Products of a tile brought together by day; tiles of every product share one 4 x 4 raster here."""
    px = obs(spark, sf).where("band IN ('red', 'nir')").select("tile_id", "band", F.date_format("time", "yyyy-MM-dd").alias("day"), "product_id", F.size("pixels").cast("long").alias("n"), F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p).alias("s"))
    return px.groupBy("tile_id", "band", "day").agg(F.countDistinct("product_id").alias("products"), F.try_divide(F.sum("s").cast("double"), F.sum("n").cast("double")).alias("value"))


# bulk volume
@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty, count(*) AS n FROM lineitem GROUP BY 1, 2")
def bulk_rollup(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
