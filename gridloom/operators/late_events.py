"""Event-time aggregates over records that arrive late and out of order.

Method: every source (satellite) has a low watermark, the latest ingestion instant
it has shown. A source gives the punctuation of a period's bound when its watermark
passes that bound; a source that shows nothing for ``idle`` days after the bound is
timed out and counts as passed. A period has two bounds: it is *complete* once every
source has passed its end + ``allowed``, and it *closes* once every source has passed
its end + ``cutoff``. The state of the periods is joined to the readings and decides:

* on_time: the reading's own source had not passed end + ``allowed`` when it came;
* late: it had; the reading is accepted and corrects the period's aggregates;
* overdue: past end + ``cutoff``, but the period is still open for a slower source;
* diverted: the period was closed.

Overdue and diverted readings are set apart. Watermarks are kept per source, kind of
bound and month: the earliest instant that passed all bounds up to that month's. That
is a few hundred rows a source, however many records it has, and combined map-side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.joins import null_safe_join
from gridloom.functions.tiles import canonical_or_self

#: Microseconds before midnight that still belong to the day before: a bound is only passed by a later instant.
_JUST = "INTERVAL 1 MICROSECOND"
READING = ["tile_id", "satellite_id", "product_id", "band", "time"]


@dataclass(frozen=True)
class Lateness:
    """Bounds in days. ``allowed``: on time until then; ``cutoff``: accepted until then; ``idle``: a silent source is passed over."""

    allowed: int = 3
    cutoff: int = 45
    idle: int = 7


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL {n} DAYS")


def with_period(df: DataFrame, time: str = "time") -> DataFrame:
    """Adds period_start and period_end, the UTC calendar month of ``time``; both NULL where time is NULL."""
    start = F.date_trunc("month", F.col(time))
    return df.withColumn("period_start", start).withColumn("period_end", start + F.expr("INTERVAL 1 MONTH"))


def _digest(pixels: Column) -> list[Column]:
    """Keys that are equal for equal pixels only: size and 128 bits of hash, and the pixels themselves where one is NULL,
    as NULLs leave no trace in a hash."""
    holes = F.when(F.exists(pixels, lambda p: p.isNull()), pixels)
    return [F.size(pixels).alias("_n"), F.xxhash64(F.lit(1), pixels).alias("_h1"), F.xxhash64(F.lit(2), pixels).alias("_h2"), holes.alias("_holes")]


def first_deliveries(observations: DataFrame, measures: bool = False) -> DataFrame:
    """One row per reading: of the rows equal in tile, satellite, product, band, time and pixels the one that came
    first (of several, the smallest obs_id). Rows without ingestion_time or time are left out. NULLs in the other
    columns count as a value. Extra columns are ignored. ``measures`` adds n_pixels, pixel_sum, pixel_min and pixel_max,
    NULL pixels skipped. Pixels are compared by a digest, so they are not shuffled; copies are combined map-side."""
    px = F.filter(F.coalesce(F.col("pixels"), F.array().cast("array<int>")), lambda p: p.isNotNull())
    measured = {
        "n_pixels": F.size(px).cast("long"),
        "pixel_sum": F.aggregate(px, F.lit(0).cast("long"), lambda a, p: a + p),
        "pixel_min": F.array_min(px),
        "pixel_max": F.array_max(px),
    }
    more = [c.alias(n) for n, c in measured.items()] if measures else []
    return (
        observations.where(F.col("ingestion_time").isNotNull() & F.col("time").isNotNull())
        .groupBy(canonical_or_self("tile_id").alias("tile_id"), *READING[1:], *_digest(F.col("pixels")))
        .agg(F.min(F.struct("ingestion_time", "obs_id", *more)).alias("first"))
        .select(*READING, "first.*")
    )


def watermarks(observations: DataFrame, rule: Lateness = Lateness(), source: str = "satellite_id") -> DataFrame:
    """(source, kind, passed_end, first_seen): per source and kind of bound (allowed, cutoff) the first instant shown
    after the bounds of all periods that end by ``passed_end``. Every row with an ingestion_time carries its source's
    clock, repeated deliveries and rows without time too."""
    kinds = F.array(F.struct(F.lit("allowed").alias("kind"), F.lit(rule.allowed).alias("after")), F.struct(F.lit("cutoff").alias("kind"), F.lit(rule.cutoff).alias("after")))
    shown = observations.where(F.col("ingestion_time").isNotNull()).select(F.col(source).alias("source"), "ingestion_time", F.explode(kinds).alias("k"))
    day = F.date_sub(F.to_date(F.col("ingestion_time") - F.expr(_JUST)), F.col("k.after"))
    return shown.groupBy("source", "k.kind", F.trunc(day, "month").alias("passed_end")).agg(F.min("ingestion_time").alias("first_seen"))


def _periods(observations: DataFrame) -> DataFrame:
    """One row: the ends of all periods that hold a record, at most one per calendar month."""
    some = observations.where(F.col("time").isNotNull() & F.col("ingestion_time").isNotNull())
    return with_period(some.select("time")).agg(F.collect_set(F.to_date("period_end")).alias("ends"))


def punctuations(observations: DataFrame, rule: Lateness = Lateness(), source: str = "satellite_id") -> DataFrame:
    """(source, kind, period_end, passed_at, idle): when each source passed each period's bound, or was timed out. A
    source never heard of after a bound has no row."""
    marks = watermarks(observations, rule, source).join(F.broadcast(_periods(observations)))  # one row
    before = F.lag("passed_end").over(Window.partitionBy("source", "kind").orderBy("passed_end"))
    spans = marks.withColumn("previous", before)
    crossed = F.filter("ends", lambda e: (e <= F.col("passed_end")) & (F.col("previous").isNull() | (e > F.col("previous"))))
    end = F.col("end").cast("timestamp")
    limit = end + F.when(F.col("kind") == "allowed", _days(rule.allowed + rule.idle)).otherwise(_days(rule.cutoff + rule.idle))
    return spans.select("source", "kind", "first_seen", F.explode(crossed).alias("end")).select(
        "source", "kind", end.alias("period_end"), F.least("first_seen", limit).alias("passed_at"), (F.col("first_seen") > limit).alias("idle")
    )


def period_state(observations: DataFrame, rule: Lateness = Lateness(), source: str = "satellite_id", said: DataFrame | None = None) -> DataFrame:
    """(period_start, period_end, sources, idle_sources, complete_at, closed_at) of every period that holds a record: all
    sources, those timed out at closing, and when the last source passed each bound. A source not heard of in time is
    timed out, so neither instant exceeds its bound + ``idle``."""
    said = punctuations(observations, rule, source) if said is None else said
    sources = observations.where(F.col("ingestion_time").isNotNull()).agg(F.countDistinct(F.struct(source)).alias("sources"))
    per = said.groupBy("period_end").pivot("kind", ["allowed", "cutoff"]).agg(F.count(F.lit(1)).alias("heard"), F.sum(F.col("idle").cast("long")).alias("idle"), F.max("passed_at").alias("last"))
    periods = _periods(observations).select(F.explode("ends").alias("end")).select(F.col("end").cast("timestamp").alias("period_end"))
    at = lambda kind, days: F.when(F.col(f"{kind}_heard") == F.col("sources"), F.col(f"{kind}_last")).otherwise(F.col("period_end") + _days(days + rule.idle))
    heard = F.coalesce("cutoff_heard", F.lit(0))
    return (
        periods.join(per, "period_end", "left")
        .join(F.broadcast(sources))  # one row
        .select(
            (F.col("period_end") - F.expr("INTERVAL 1 MONTH")).alias("period_start"),
            "period_end",
            "sources",
            (F.col("sources") - heard + F.coalesce("cutoff_idle", F.lit(0))).alias("idle_sources"),
            at("allowed", rule.allowed).alias("complete_at"),
            at("cutoff", rule.cutoff).alias("closed_at"),
        )
    )


def arrivals(observations: DataFrame, rule: Lateness = Lateness(), source: str = "satellite_id", measures: bool = False) -> DataFrame:
    """The readings (see first_deliveries) with period_start, period_end, closed_at and status (on_time, late, overdue,
    diverted), told by the state of the periods and of their own source when they came."""
    said = punctuations(observations, rule, source)
    own = said.where(F.col("kind") == "allowed").select(F.col("source").alias(source), "period_end", "passed_at")
    # One row per period: at most one per calendar month.
    state = F.broadcast(period_state(observations, rule, source, said).select("period_end", "closed_at"))
    readings = with_period(first_deliveries(observations, measures))
    known = null_safe_join(readings, own, [source, "period_end"], "left").join(state, "period_end", "left")
    came = F.col("ingestion_time")
    status = (
        F.when(came >= F.col("closed_at"), "diverted")
        .when(F.col("passed_at").isNull() | (came < F.col("passed_at")), "on_time")
        .when(came > F.col("period_end") + _days(rule.cutoff), "overdue")
        .otherwise("late")
    )
    return known.withColumn("status", status).drop("passed_at")


def corrected_aggregates(observations: DataFrame, keys: list[str], rule: Lateness = Lateness()) -> DataFrame:
    """Per key and period the statistics as they stand when the period is first complete (version 0) and after each
    accepted late record (version 1, 2, ...), in ingestion order, ties by obs_id.

    Columns: keys, period_start, version, obs_id (NULL at version 0), as_of, n_readings, n_pixels, pixel_sum,
    pixel_min, pixel_max. NULL pixels are skipped. On-time records are combined map-side; late ones are summed per
    ingestion day first and the days' totals carried by a prefix scan, so a hot key is spread over its days."""
    measured = arrivals(observations, rule, measures=True).where(F.col("status").isin("on_time", "late")).select(
        *keys,
        "period_start",
        "status",
        "obs_id",
        "ingestion_time",
        F.to_date("ingestion_time").alias("day"),
        F.col("n_pixels").alias("k"),
        F.col("pixel_sum").alias("s"),
        F.col("pixel_min").alias("lo"),
        F.col("pixel_max").alias("hi"),
    )
    group = [*keys, "period_start"]
    sums = [F.count("obs_id").alias("n"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    base = measured.where(F.col("status") == "on_time").groupBy(*group).agg(*sums)
    late = measured.where(F.col("status") == "late")
    per_day = late.groupBy(*group, "day").agg(*sums)
    keyed = lambda a, b: [a[c].eqNullSafe(b[c]) for c in group]
    # The base stands as day NULL, which sorts first: one prefix scan carries it and the days' totals.
    days = base.withColumn("day", F.lit(None).cast("date")).unionByName(per_day)
    before = Window.partitionBy(*group).orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(
        *group,
        "day",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"c_{c}") for c in ("n", "k", "s")],
        F.min("lo").over(before).alias("c_lo"),
        F.max("hi").over(before).alias("c_hi"),
        F.coalesce(F.sum(F.when(F.col("day").isNotNull(), F.col("n"))).over(before), F.lit(0)).alias("c_v"),
    ).where(F.col("day").isNotNull())
    order = Window.partitionBy(*group, "day").orderBy("ingestion_time", "obs_id").rowsBetween(Window.unboundedPreceding, 0)
    within = late.select(
        *group,
        "day",
        "obs_id",
        "ingestion_time",
        F.count("obs_id").over(order).alias("n"),
        F.sum("k").over(order).alias("k"),
        F.sum("s").over(order).alias("s"),
        F.min("lo").over(order).alias("lo"),
        F.max("hi").over(order).alias("hi"),
    )
    a, b = within.alias("a"), carried.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "day"]]
    versions = a.join(b, on).select(
        *[F.col(f"a.{c}") for c in group],
        (F.col("c_v") + F.col("a.n")).alias("version"),
        "a.obs_id",
        F.col("a.ingestion_time").alias("as_of"),
        (F.col("c_n") + F.col("a.n")).alias("n_readings"),
        (F.col("c_k") + F.col("a.k")).alias("n_pixels"),
        (F.col("c_s") + F.col("a.s")).alias("pixel_sum"),
        F.least("c_lo", "a.lo").alias("pixel_min"),
        F.greatest("c_hi", "a.hi").alias("pixel_max"),
    )
    bound = F.col("period_start") + F.expr("INTERVAL 1 MONTH") + F.expr(f"INTERVAL {rule.allowed} DAYS")
    first = base.select(
        *group,
        F.lit(0).cast("long").alias("version"),
        F.lit(None).cast("long").alias("obs_id"),
        bound.alias("as_of"),
        F.col("n").alias("n_readings"),
        F.col("k").alias("n_pixels"),
        F.col("s").alias("pixel_sum"),
        F.col("lo").alias("pixel_min"),
        F.col("hi").alias("pixel_max"),
    )
    return first.unionByName(versions)


def late_accepted(observations: DataFrame, rule: Lateness = Lateness()) -> DataFrame:
    """obs_id of the readings that came late but before the cut-off."""
    return arrivals(observations, rule).where(F.col("status") == "late").select("obs_id")


def diverted(observations: DataFrame, rule: Lateness = Lateness()) -> DataFrame:
    """Readings past the cut-off, set apart: obs_id, period_start, ingestion_time, status (overdue, diverted)."""
    return arrivals(observations, rule).where(F.col("status").isin("overdue", "diverted")).select("obs_id", "period_start", "ingestion_time", "status")
