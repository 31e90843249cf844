"""Irregular readings onto a regular grid of slots.

Method: the readings of a series are reduced to slots, the slots to time shards
of ``shard`` slots each. Of a shard only its occupied slots and its first and
last reading are kept; a prefix scan over a series' shards carries the last
reading before and the first reading after each shard, and then every shard
fills its own slots independently, shards without any reading included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.tiles import canonical_or_self

ORIGIN_US = 1_672_531_200_000_000  # 2023-01-01T00:00:00Z
DAY_US = 86_400_000_000
SERIES = ["tile_id", "satellite_id", "band"]


def occupied_slots(observations: DataFrame, days: int = 5) -> DataFrame:
    """(series, slot, n_readings, first_value, last_value): slots with a usable reading, i.e. one whose mean_value is
    neither NULL nor NaN. first and last are by time, ties by obs_id. Rows without time are ignored; NULLs in the
    series' columns form a series of their own."""
    slot = F.floor((F.unix_micros("time") - F.lit(ORIGIN_US)) / F.lit(days * DAY_US))
    usable = F.col("mean_value").isNotNull() & ~F.isnan("mean_value") & F.col("time").isNotNull()
    at = F.struct("time", "obs_id", F.col("mean_value").cast("double").alias("value"))
    return (
        observations.where(usable)
        .groupBy(canonical_or_self("tile_id").alias("tile_id"), "satellite_id", "band", slot.alias("slot"))
        .agg(F.count("obs_id").alias("n_readings"), F.min(at).alias("lo"), F.max(at).alias("hi"))
        .select(*SERIES, "slot", "n_readings", F.col("lo.value").alias("first_value"), F.col("hi.value").alias("last_value"))
    )


def regular_grid(observations: DataFrame, days: int = 5, shard: int = 64) -> DataFrame:
    """One row per series and slot between the series' first and last usable slot.

    Columns: series, slot, slot_start (YYYY-MM-DD), n_readings, value, missing, carried, interpolated. ``value`` is the
    slot's last usable reading, NULL in a missing slot; ``carried`` repeats the reading before; ``interpolated`` runs
    straight from the last reading before to the first one after. An empty table gives an empty grid."""
    slots = occupied_slots(observations, days)
    shards = (
        slots.groupBy(*SERIES, F.floor(F.col("slot") / shard).alias("shard"))
        .agg(F.array_sort(F.collect_list(F.struct("slot", "n_readings", "first_value", "last_value"))).alias("own"))  # at most `shard` entries
        .withColumn("head", F.element_at("own", 1))
        .withColumn("tail", F.element_at("own", -1))
    )
    order = Window.partitionBy(*SERIES).orderBy("shard")
    scanned = shards.withColumn("before", F.lag("tail").over(order)).withColumn("before_shard", F.lag("shard").over(order)).withColumn("after", F.lead("head").over(order))
    # Shards without a reading come in here: each occupied one brings those between it and the one before.
    work = scanned.withColumn("fill", F.explode(F.sequence(F.coalesce(F.col("before_shard") + 1, F.col("shard")), F.col("shard"))))
    is_own = F.col("fill") == F.col("shard")
    start = F.greatest(F.col("fill") * shard, F.coalesce(F.col("before.slot") + 1, F.col("head.slot")))
    # The last shard of a series ends at its last reading, every other one at its own limit.
    end = F.when(is_own & F.col("after").isNull(), F.col("tail.slot")).otherwise((F.col("fill") + 1) * shard - 1)
    piece = lambda left, right, a, b: F.struct(left.alias("left"), right.alias("right"), a.alias("from"), b.alias("to"))
    # A segment runs from a reading's slot to the slot before the next reading, or to the shard's limit.
    nothing = F.slice(F.array("head"), 1, 0)
    lead_in = piece(F.col("before"), F.col("head"), F.col("start"), F.when(is_own, F.col("head.slot") - 1).otherwise(F.col("end")))
    own = F.transform(
        F.when(is_own, F.col("own")).otherwise(nothing),
        lambda e, i: piece(e, F.coalesce(F.get("own", i + 1), F.col("after")), e["slot"], F.coalesce(F.get("own", i + 1)["slot"] - 1, F.col("end"))),
    )
    segments = (
        work.withColumn("start", start)
        .withColumn("end", end)
        .select(*SERIES, F.explode(F.concat(F.array(lead_in), own)).alias("seg"))
        .where(F.col("seg.from") <= F.col("seg.to"))
        .select(*SERIES, "seg.left", "seg.right", F.explode(F.sequence("seg.from", "seg.to")).alias("slot"))
    )
    missing = F.coalesce(F.col("left.slot") != F.col("slot"), F.lit(True))
    share = (F.col("slot") - F.col("left.slot")) / (F.col("right.slot") - F.col("left.slot"))
    line = F.col("left.last_value") + (F.col("right.first_value") - F.col("left.last_value")) * share
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("slot") * days).cast("int"))
    return segments.select(
        *SERIES,
        "slot",
        F.date_format(day, "yyyy-MM-dd").alias("slot_start"),
        F.when(missing, F.lit(0)).otherwise(F.col("left.n_readings")).cast("long").alias("n_readings"),
        F.when(~missing, F.col("left.last_value")).alias("value"),
        missing.alias("missing"),
        F.col("left.last_value").alias("carried"),
        F.when(missing, line).otherwise(F.col("left.last_value")).alias("interpolated"),
    )


def missing_slots(observations: DataFrame, days: int = 5) -> DataFrame:
    """Slots without a usable reading that lie between two with one."""
    return regular_grid(observations, days).where("missing").select(*SERIES, "slot_start")
