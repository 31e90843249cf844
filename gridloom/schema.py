"""Schemas of the stored tables, enforced on write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import ValidationError


def _f(name: str, kind: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind, nullable)


OBSERVATIONS = T.StructType(
    [
        _f("tile_id", T.StringType(), False),
        _f("band", T.StringType(), False),
        _f("year_month", T.StringType(), False),
        _f("time", T.TimestampType(), False),
        _f("pixels", T.ArrayType(T.IntegerType(), False), False),
        _f("mask", T.ArrayType(T.BooleanType(), False), False),
        _f("product_id", T.StringType(), False),
        _f("resolution", T.FloatType(), False),
        _f("bounds_wkb", T.BinaryType()),
        _f("num_pixels", T.IntegerType(), False),
        _f("min_value", T.FloatType()),
        _f("max_value", T.FloatType()),
        _f("mean_value", T.FloatType()),
        _f("cloud_cover", T.FloatType()),
        _f("crs", T.StringType()),
        _f("transform", T.StringType()),
        _f("source_file", T.StringType()),
        _f("ingestion_time", T.TimestampType()),
    ]
)
PARTITIONS = ["tile_id", "band", "year_month"]
BOUNDS = T.StructType([_f(c, T.DoubleType()) for c in ("minx", "miny", "maxx", "maxy")])
SCENES = T.StructType(
    [
        _f("scene_id", T.StringType(), False),
        _f("acquisition_time", T.TimestampType()),
        _f("product_id", T.StringType()),
        _f("band_names", T.ArrayType(T.StringType())),
        _f("source_file", T.StringType(), False),
        _f("crs", T.StringType()),
        _f("cloud_cover", T.DoubleType()),
        _f("mask_source_file", T.StringType()),
        _f("bounds", BOUNDS),
        _f("shape", T.ArrayType(T.IntegerType())),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order and types; a missing optional column is NULL, a missing required one raises. A
    NULL in a required column fails when the rows are computed. Other columns are left out."""
    missing = [f.name for f in schema if not f.nullable and f.name not in df.columns]
    if missing:
        raise ValidationError(f"columns {missing} are required")

    def column(f: T.StructField):
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        array = isinstance(f.dataType, T.ArrayType)
        kind = T.ArrayType(f.dataType.elementType, True) if array else f.dataType
        c = F.col(f.name).cast(kind)
        refuse = F.raise_error(F.lit(f"NULL in {f.name}")).cast(kind)
        if array and not f.dataType.containsNull:
            c = F.when(F.exists(c, lambda v: v.isNull()), refuse).otherwise(c)
        return (c if f.nullable else F.coalesce(c, refuse)).alias(f.name)

    return df.select(*[column(f) for f in schema])


def check_lengths(df: DataFrame) -> DataFrame:
    """Rows whose mask is as long as their pixels; any other row fails when it is computed."""
    same = F.size("pixels") == F.size("mask")
    return df.withColumn("pixels", F.when(same, F.col("pixels")).otherwise(F.raise_error(F.lit("pixels and mask of different length")).cast("array<int>")))
