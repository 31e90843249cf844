"""Joins on keys in which NULL equals NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hint: bool = False) -> DataFrame:
    """Equi-join on ``keys`` with NULL equal to NULL; the keys come out once, as the left side has them. ``hint``
    broadcasts the right side and is for sides of a checked size only."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__{c}"]) for c in keys])
    return left.join(F.broadcast(renamed) if hint else renamed, on, how).drop(*[f"__{c}" for c in keys])
