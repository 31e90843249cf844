"""Scenes and observations as streams. Extensions: the batch operators are the reference for their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.late_events import Lateness
from gridloom.warehouse import Warehouse


def follow(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def into_warehouse(stream: DataFrame, store: Warehouse, checkpoint: str, name: str = "ingest") -> StreamingQuery:
    """Commit every micro-batch once: its number names the commit, so a batch that runs again adds nothing."""

    def commit(batch: DataFrame, number: int) -> None:
        store.append(batch, f"{name} {number}", batch=f"{name}-{number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()


def monthly_composites(stream: DataFrame, rule: Lateness = Lateness()) -> DataFrame:
    """Per tile, band and month the number, extremes and sum of usable means, one row a month, updated as late rows
    arrive. The watermark is on the month's end: the state of a month is dropped once a month that ends ``cutoff`` days
    and a month later has begun to arrive. A stream has one watermark; the per-source rule is the batch operator's."""
    usable = stream.where(F.col("mean_value").isNotNull() & ~F.isnan("mean_value") & F.col("time").isNotNull())
    month = F.date_trunc("month", "time")
    return (
        usable.withColumn("month_end", month + F.expr("INTERVAL 1 MONTH"))
        .withWatermark("month_end", f"{rule.cutoff + 31} days")
        .groupBy("tile_id", "band", "month_end")
        .agg(F.count(F.lit(1)).alias("n"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum(F.col("mean_value").cast("double")).alias("mean_sum"))
        .withColumn("month", F.col("month_end") - F.expr("INTERVAL 1 MONTH"))
    )
