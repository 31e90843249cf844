"""Queries of the general large-scale operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import compaction, late_events, nearby, regular_grid, spikes, units
from gridloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_events.late_accepted(table(spark, sf_dir, "observations"))


def p1_diverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = late_events.diverted(table(spark, sf_dir, "observations"))
    return late.select("obs_id", F.date_format("period_start", "yyyy-MM").alias("period"), "status")


def p1_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = late_events.period_state(table(spark, sf_dir, "observations"))
    return state.select(F.date_format("period_start", "yyyy-MM").alias("period"), "sources", "idle_sources", F.unix_micros("complete_at").alias("complete_us"), F.unix_micros("closed_at").alias("closed_us"))


def p1_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = late_events.corrected_aggregates(table(spark, sf_dir, "observations"), ["tile_id", "band"])
    return rows.select(
        "tile_id", "band", F.date_format("period_start", "yyyy-MM").alias("period"), "version", "obs_id", "n_readings", "n_pixels", "pixel_sum", "pixel_min", "pixel_max"
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid.missing_slots(table(spark, sf_dir, "observations"))


def p2_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = regular_grid.regular_grid(table(spark, sf_dir, "observations"))
    return grid.select("tile_id", "satellite_id", "band", "slot_start", "n_readings", "value", "missing", "carried", "interpolated")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.surplus_records(table(spark, sf_dir, "chunk_rows"))


def p3_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = compaction.consolidated(table(spark, sf_dir, "chunk_rows"))
    return kept.select("row_id", "tile_id", "year_month", "band", F.unix_micros("time").alias("time_us"), "pixels", "mask")


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renewed catalogue: range metadata of every chunk, with what the old one knows of it."""
    per = compaction.range_metadata(compaction.consolidated(table(spark, sf_dir, "chunk_rows")))
    new = compaction.renewed_catalogue(per, table(spark, sf_dir, "tile_metadata"))
    us = lambda c: F.unix_micros(c).alias(c.replace("time", "us"))
    return new.select(*compaction.KEY, "num_observations", us("min_time"), us("max_time"), "source_files", "min_value", "max_value", F.round("mean_value", 6).alias("mean_value"), "bounds", "product_id", "resolution")


def p3_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.catalogue_drift(table(spark, sf_dir, "tile_metadata"), table(spark, sf_dir, "chunk_rows"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.measured_units(*(table(spark, sf_dir, n) for n in ("observations", "scenes_index", "product_profiles", "product_bands")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.other_units(_units(spark, sf_dir))


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.in_common_units(_units(spark, sf_dir))


def p4_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.evidence(_units(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.untrustworthy(table(spark, sf_dir, "observations"))


def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flagged(table(spark, sf_dir, "observations"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearby.records_near_sites(*(table(spark, sf_dir, n) for n in ("scenes_index", "tile_metadata", "observations", "sites")))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_diverted, p1_periods, p1_monthly, p2_found, p2_grid, p3_found, p3_consolidated, p3_files, p3_catalogue,
            p4_found, p4_values, p4_evidence, p5_found, p5_flags, p6_found,
        )
    }


# Canonical spelling of a tile id in SQL; {t} is the id.
_TILE = r"""(CASE WHEN regexp_matches({t}, '^\s*[xX][+-]?[0-9]{{1,9}}_[yY][+-]?[0-9]{{1,9}}\s*$') THEN
 (SELECT 'x' || CASE WHEN x < 0 THEN '-' ELSE '' END || CASE WHEN abs(x) < 1000 THEN lpad(CAST(abs(x) AS VARCHAR), 4, '0') ELSE CAST(abs(x) AS VARCHAR) END
      || '_y' || CASE WHEN y < 0 THEN '-' ELSE '' END || CASE WHEN abs(y) < 1000 THEN lpad(CAST(abs(y) AS VARCHAR), 4, '0') ELSE CAST(abs(y) AS VARCHAR) END
  FROM (SELECT CAST(regexp_extract({t}, '[xX]([+-]?[0-9]+)', 1) AS INT) AS x, CAST(regexp_extract({t}, '[yY]([+-]?[0-9]+)', 1) AS INT) AS y))
 ELSE {t} END)"""


def tile_sql(t: str) -> str:
    return _TILE.format(t=t)


_FIRST = f"""
WITH named AS (SELECT *, {tile_sql("tile_id")} AS tile FROM observations WHERE ingestion_time IS NOT NULL AND time IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tile, satellite_id, product_id, band, time, pixels ORDER BY ingestion_time, obs_id) AS rn FROM named),
readings AS (SELECT *, date_trunc('month', time AT TIME ZONE 'UTC') AS month, ingestion_time AT TIME ZONE 'UTC' AS seen FROM ranked WHERE rn = 1)
"""


def _passed_sql(after: int) -> str:
    """When the last source passed the bound ``after`` days behind each month, and how many were timed out after a week."""
    return f"""(SELECT e, (SELECT count(DISTINCT s) FROM shown) AS sources, (SELECT count(DISTINCT s) FROM shown) - count(i) + count(*) FILTER (i > e + INTERVAL {after + 7} DAY) AS idle,
  CASE WHEN count(i) < (SELECT count(DISTINCT s) FROM shown) THEN e + INTERVAL {after + 7} DAY ELSE max(least(i, e + INTERVAL {after + 7} DAY)) END AS passed
  FROM ends LEFT JOIN (SELECT s, e, min(i) AS i FROM shown JOIN ends ON i > e + INTERVAL {after} DAY GROUP BY 1, 2) USING (e) GROUP BY e)"""


_STATE = f"""
, shown AS (SELECT satellite_id AS s, ingestion_time AT TIME ZONE 'UTC' AS i FROM observations WHERE ingestion_time IS NOT NULL),
ends AS (SELECT DISTINCT month + INTERVAL 1 MONTH AS e FROM readings),
complete AS {_passed_sql(3)}, closed AS {_passed_sql(45)}
"""
_SLOTS = f"""
WITH slots AS (SELECT {tile_sql("tile_id")} AS tile, satellite_id, band,
   CAST(floor((epoch_us(time) - 1672531200000000) / 432000000000.0) AS BIGINT) AS slot, count(obs_id) AS n_readings,
   CAST(arg_min(mean_value, (epoch_us(time), obs_id)) AS DOUBLE) AS lo, CAST(arg_max(mean_value, (epoch_us(time), obs_id)) AS DOUBLE) AS hi
  FROM observations WHERE mean_value IS NOT NULL AND NOT isnan(mean_value) AND time IS NOT NULL GROUP BY 1, 2, 3, 4),
links AS (SELECT *, lead(slot) OVER w AS next_slot, lead(lo) OVER w AS next_lo FROM slots WINDOW w AS (PARTITION BY tile, satellite_id, band ORDER BY slot)),
grid AS (SELECT *, unnest(range(slot, coalesce(next_slot, slot + 1))) AS s FROM links)
"""
_SAME_SERIES = "tile, sat, band"


def _scale_sql(source: str, previous: str) -> str:
    """One more round of the trimmed scale: root mean square of the distances within five scales."""
    parts = ", ".join(f"greatest(sqrt(avg(d{k} * d{k}) FILTER (d{k} < 5 * s{k})), 0.5) AS s{k}" for k in (1, 2, 3))
    return f"SELECT {_SAME_SERIES}, {parts} FROM {source} JOIN {previous} USING ({_SAME_SERIES}) GROUP BY 1, 2, 3"


# By plain rules: hard bounds; beyond eight scales of the series; six consecutive readings that share one triple.
_SPIKES = f"""
WITH u AS (SELECT obs_id, {tile_sql("tile_id")} AS tile, satellite_id AS sat, band, time, CAST(min_value AS DOUBLE) AS v1, CAST(max_value AS DOUBLE) AS v2, CAST(mean_value AS DOUBLE) AS v3 FROM observations
  WHERE NOT (min_value IS NULL AND max_value IS NULL AND mean_value IS NULL) AND (mean_value IS NULL OR NOT isnan(mean_value)) AND time IS NOT NULL),
h AS (SELECT *, coalesce(v1 < 0, false) OR coalesce(v2 < 0, false) OR coalesce(v3 < 0, false) OR coalesce(v1 > v3, false) OR coalesce(v3 > v2, false) AS hard FROM u),
d AS (SELECT DISTINCT tile, sat, band, v1, v2, v3 FROM h WHERE NOT hard),
m AS (SELECT {_SAME_SERIES}, median(v1) AS m1, median(v2) AS m2, median(v3) AS m3 FROM d GROUP BY 1, 2, 3),
e AS (SELECT d.*, abs(v1 - m1) AS d1, abs(v2 - m2) AS d2, abs(v3 - m3) AS d3 FROM d JOIN m USING ({_SAME_SERIES})),
r0 AS (SELECT {_SAME_SERIES}, greatest(1.2 * median(d1), 0.5) AS s1, greatest(1.2 * median(d2), 0.5) AS s2, greatest(1.2 * median(d3), 0.5) AS s3 FROM e GROUP BY 1, 2, 3),
r1 AS ({_scale_sql("e", "r0")}), r2 AS ({_scale_sql("e", "r1")}), r3 AS ({_scale_sql("e", "r2")}), r4 AS ({_scale_sql("e", "r3")}),
n AS (SELECT *, dense_rank() OVER (PARTITION BY {_SAME_SERIES} ORDER BY time) AS k FROM h),
o AS (SELECT DISTINCT tile, sat, band, v1, v2, v3, k FROM n),
g AS (SELECT *, k - row_number() OVER (PARTITION BY tile, sat, band, v1, v2, v3 ORDER BY k) AS island FROM o),
w AS (SELECT *, count(*) OVER (PARTITION BY tile, sat, band, v1, v2, v3, island) >= 6 AS stuck FROM g)
SELECT obs_id FROM n JOIN w USING (tile, sat, band, v1, v2, v3, k) JOIN m USING ({_SAME_SERIES}) JOIN r4 USING ({_SAME_SERIES})
WHERE hard OR stuck OR abs(v1 - m1) > 8 * s1 OR abs(v2 - m2) > 8 * s2 OR abs(v3 - m3) > 8 * s3"""
_PATH = r"lower(regexp_replace(chunk_path, '[/\\]+', '/', 'g'))"
_KEYED = r"""CAST(regexp_extract(p, '(?:^|[/=])x([+-]?[0-9]+)_y', 1) AS INT) AS x, CAST(regexp_extract(p, '(?:^|[/=])x[+-]?[0-9]+_y([+-]?[0-9]+)', 1) AS INT) AS y,
   regexp_extract(p, '(?:^|[/=])([0-9]{4})-([0-9]{1,2})/', 1) || '-' || lpad(regexp_extract(p, '(?:^|[/=])([0-9]{4})-([0-9]{1,2})/', 2), 2, '0') AS ym,
   CASE WHEN regexp_extract(p, '/band=([^/]+)', 1) <> '' THEN regexp_extract(p, '/band=([^/]+)', 1)
        ELSE regexp_extract(p, '/([a-z][a-z0-9]*(?:_[0-9]{1,2})?)[-_.][0-9a-f]{4,}\.arrow', 1) END"""
_CHUNKS = rf"""
WITH paths AS (SELECT *, {_PATH} AS p FROM chunk_rows),
keyed AS (SELECT row_id, time, pixels, mask, chunk_path, {_KEYED} AS band, ym AS year_month FROM paths),
ranked AS (SELECT *, row_number() OVER (PARTITION BY x, y, year_month, band, time, pixels, mask ORDER BY row_id) AS rn FROM keyed)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _FIRST
        + "SELECT obs_id FROM readings WHERE seen > month + INTERVAL 1 MONTH + INTERVAL 3 DAY AND seen <= month + INTERVAL 1 MONTH + INTERVAL 45 DAY",
        "p1_diverted": _FIRST
        + _STATE
        + """SELECT obs_id, strftime(month, '%Y-%m') AS period, CASE WHEN seen >= passed THEN 'diverted' ELSE 'overdue' END AS status
FROM readings JOIN closed ON e = month + INTERVAL 1 MONTH WHERE seen > month + INTERVAL 1 MONTH + INTERVAL 45 DAY""",
        "p1_periods": _FIRST
        + _STATE
        + """SELECT strftime(e - INTERVAL 1 MONTH, '%Y-%m') AS period, closed.sources, CAST(closed.idle AS BIGINT) AS idle_sources, epoch_us(complete.passed) AS complete_us, epoch_us(closed.passed) AS closed_us
FROM complete JOIN closed USING (e)""",
        "p1_monthly": _FIRST
        + """, measured AS (SELECT tile AS tile_id, band, month, obs_id, seen, seen <= month + INTERVAL 1 MONTH + INTERVAL 3 DAY AS punctual,
   len(pixels) AS k, list_sum(pixels) AS s, list_min(pixels) AS lo, list_max(pixels) AS hi FROM readings WHERE seen <= month + INTERVAL 1 MONTH + INTERVAL 45 DAY),
running AS (SELECT tile_id, band, month, punctual, CASE WHEN punctual THEN NULL ELSE obs_id END AS obs_id,
   count(*) FILTER (NOT punctual) OVER w AS version, count(*) OVER w AS n_readings, sum(k) OVER w AS n_pixels, sum(s) OVER w AS pixel_sum, min(lo) OVER w AS pixel_min, max(hi) OVER w AS pixel_max,
   row_number() OVER w AS r, count(*) FILTER (punctual) OVER (PARTITION BY tile_id, band, month) AS n0
  FROM measured WINDOW w AS (PARTITION BY tile_id, band, month ORDER BY punctual DESC, seen, obs_id ROWS UNBOUNDED PRECEDING))
SELECT tile_id, band, strftime(month, '%Y-%m') AS period, CAST(version AS BIGINT) AS version, obs_id, CAST(n_readings AS BIGINT) AS n_readings, CAST(n_pixels AS BIGINT) AS n_pixels,
 CAST(pixel_sum AS BIGINT) AS pixel_sum, pixel_min, pixel_max FROM running WHERE NOT punctual OR r = n0""",
        "p2_found": _SLOTS
        + "SELECT tile AS tile_id, satellite_id, band, strftime(DATE '2023-01-01' + CAST(s * 5 AS INT), '%Y-%m-%d') AS slot_start FROM grid WHERE s <> slot",
        "p2_grid": _SLOTS
        + """SELECT tile AS tile_id, satellite_id, band, strftime(DATE '2023-01-01' + CAST(s * 5 AS INT), '%Y-%m-%d') AS slot_start,
 CASE WHEN s = slot THEN n_readings ELSE 0 END AS n_readings, CASE WHEN s = slot THEN hi END AS value, s <> slot AS missing, hi AS carried,
 CASE WHEN s = slot THEN hi ELSE hi + (next_lo - hi) * ((s - slot) / (next_slot - slot)) END AS interpolated FROM grid""",
        "p5_found": _SPIKES,
        "p3_found": _CHUNKS + "SELECT row_id FROM ranked WHERE rn > 1",
        "p3_consolidated": _CHUNKS
        + """SELECT row_id, 'x' || CASE WHEN x < 0 THEN '-' ELSE '' END || lpad(CAST(abs(x) AS VARCHAR), 4, '0') || '_y' || CASE WHEN y < 0 THEN '-' ELSE '' END || lpad(CAST(abs(y) AS VARCHAR), 4, '0') AS tile_id,
 year_month, band, epoch_us(time) AS time_us, pixels, mask FROM ranked WHERE rn = 1""",
        "p3_files": _CHUNKS
        + rf""", kept AS (SELECT *, list_filter(list_zip(pixels, mask), lambda s: s[2]) AS ok FROM ranked WHERE rn = 1),
measured AS (SELECT *, CASE WHEN len(ok) > 0 THEN list_transform(ok, lambda s: s[1]) ELSE pixels END AS v FROM kept),
new AS (SELECT x, y, year_month, band, count(*) AS num_observations, epoch_us(min(time)) AS min_us, epoch_us(max(time)) AS max_us, count(DISTINCT chunk_path) AS source_files,
  CAST(min(list_min(v)) AS DOUBLE) AS min_value, CAST(max(list_max(v)) AS DOUBLE) AS max_value, round(CAST(sum(list_sum(v)) AS DOUBLE) / sum(len(v)), 6) AS mean_value FROM measured GROUP BY 1, 2, 3, 4),
listed AS (SELECT {_KEYED} AS band, * EXCLUDE (band, tile_id, year_month) FROM (SELECT *, {_PATH} AS p FROM tile_metadata)),
old AS (SELECT x, y, ym AS year_month, band, min(bounds) AS bounds, min(product_id) AS product_id, min(resolution) AS resolution FROM listed GROUP BY 1, 2, 3, 4)
SELECT 'x' || CASE WHEN x < 0 THEN '-' ELSE '' END || lpad(CAST(abs(x) AS VARCHAR), 4, '0') || '_y' || CASE WHEN y < 0 THEN '-' ELSE '' END || lpad(CAST(abs(y) AS VARCHAR), 4, '0') AS tile_id,
 year_month, band, num_observations, min_us, max_us, source_files, min_value, max_value, mean_value, bounds, product_id, resolution FROM new LEFT JOIN old USING (x, y, year_month, band)""",
        "p3_catalogue": """WITH held AS (SELECT chunk_path, count(*) AS held FROM chunk_rows WHERE chunk_path IS NOT NULL GROUP BY 1),
listed AS (SELECT chunk_path, min(num_observations) AS listed, count(*) AS entries FROM tile_metadata WHERE chunk_path IS NOT NULL GROUP BY 1)
SELECT chunk_path, listed, coalesce(held, 0) AS held, CASE WHEN entries IS NULL THEN 'unlisted' WHEN held IS NULL THEN 'empty' WHEN entries > 1 THEN 'repeated'
 WHEN listed IS NOT DISTINCT FROM held THEN 'right' ELSE 'stale' END AS state FROM listed FULL JOIN held USING (chunk_path)""",
    }
