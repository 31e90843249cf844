"""A labelled cube over a long DataFrame: one row per cell, dimensions as columns, NULL or no row for a missing cell."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.bandmath import compile_expression
from gridloom.functions.expr import divide

REDUCERS = {"mean": F.avg, "max": F.max, "min": F.min, "median": F.median, "std": F.stddev_pop, "count": F.count, "sum": F.sum}
PERIODS = {"1D": "day", "1W": "week", "1M": "month", "1Q": "quarter", "1Y": "year"}


@dataclass(frozen=True)
class Cube:
    """df: the dims and ``value``; name: of the variable."""

    df: DataFrame
    dims: tuple[str, ...]
    name: str = "value"

    @staticmethod
    def of(df: DataFrame, dims: Sequence[str], value: str = "value") -> Cube:
        return Cube(df.select(*dims, F.col(value).cast("double").alias("value")), tuple(dims), value)

    # selection
    def bands(self, names: Sequence[str], strict: bool = True) -> Cube:
        if strict:
            known = {r[0] for r in self.df.select("band").distinct().collect()}
            if missing := sorted(set(names) - known):
                raise ValueError(f"unknown bands {missing}; there are {sorted(known)}")
        return replace(self, df=self.df.where(F.col("band").isin(list(names))))

    def band(self, name: str, strict: bool = True) -> Cube:
        return Cube(self.bands([name], strict).df.drop("band"), tuple(d for d in self.dims if d != "band"), name)

    def _require(self, dim: str) -> None:
        if dim not in self.dims:
            raise KeyError(f"{dim} is no dimension; there are {self.dims}")

    def between(self, dim: str, low, high) -> Cube:
        self._require(dim)
        return replace(self, df=self.df.where(F.col(dim).between(low, high)))

    def nearest(self, dim: str, at: float) -> Cube:
        """The cells of the label nearest to ``at``, the first of two as near; the dimension goes."""
        self._require(dim)
        label = self.df.agg(F.min_by(dim, F.struct(F.abs(F.col(dim) - at), dim)).alias("_at"))  # one row
        rest = tuple(d for d in self.dims if d != dim)
        return Cube(self.df.join(F.broadcast(label), F.col(dim) == F.col("_at")).select(*rest, "value"), rest, self.name)

    def at(self, dim: str, position: int | slice) -> Cube:
        """Cells at a position among the sorted labels of a dimension. An int drops the dimension, a slice keeps it."""
        self._require(dim)
        labels = [r[0] for r in self.df.select(dim).distinct().orderBy(dim).collect()]  # the labels of one dimension
        if isinstance(position, int):
            rest = tuple(d for d in self.dims if d != dim)
            return Cube(self.df.where(F.col(dim) == F.lit(labels[position])).select(*rest, "value"), rest, self.name)
        return replace(self, df=self.df.where(F.col(dim).isin(labels[position])))

    def sel(self, dim: str, label: float | slice) -> Cube:
        """By label: the nearest one, the lower of two as near; of a slice both ends are snapped to their nearest labels,
        which are included, and a step counts labels. An unknown dimension or one without labels raises."""
        self._require(dim)
        if not isinstance(label, slice):
            return self.nearest(dim, label)
        snap = lambda v: F.min_by(dim, F.struct(F.abs(F.col(dim) - F.lit(v)), dim))
        ends = self.df.agg(*[(snap(v) if v is not None else other(dim)).alias(n) for n, v, other in (("low", label.start, F.min), ("high", label.stop, F.max))]).first()
        if ends["low"] is None:
            raise KeyError(f"{dim} has no labels")
        part = self.between(dim, ends["low"], ends["high"])
        if label.step in (None, 1):
            return part
        # Positions among the labels of one dimension, not among its cells.
        place = part.df.select(dim).distinct().withColumn("_k", F.row_number().over(Window.orderBy(dim)) - 1).where(F.col("_k") % label.step == 0)
        return replace(part, df=part.df.join(place.select(dim), dim, "left_semi"))

    # arithmetic
    def _with(self, other: Cube | float, f, tag: str, swap: bool = False) -> Cube:
        if not isinstance(other, Cube):
            a, b = F.col("value"), F.lit(float(other))
            return Cube(self.df.select(*self.dims, f(*((b, a) if swap else (a, b))).alias("value")), self.dims, f"{self.name}_{tag}")
        if set(other.dims) != set(self.dims):
            raise ValueError(f"cubes of different dimensions: {self.dims} and {other.dims}")
        right = other.df.select(*[F.col(d).alias(f"_{d}") for d in self.dims], F.col("value").alias("_value"))
        on = reduce(lambda p, q: p & q, [F.col(d) == F.col(f"_{d}") for d in self.dims])
        return Cube(self.df.join(right, on).select(*self.dims, f(F.col("value"), F.col("_value")).alias("value")), self.dims, f"{self.name}_{tag}")

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b, "add")

    __radd__ = __add__

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b, "sub")

    def __rsub__(self, o):
        return self._with(o, lambda a, b: a - b, "rsub", swap=True)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b, "mul")

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self._with(o, divide, "div")

    def __rtruediv__(self, o):
        return self._with(o, divide, "rtruediv", swap=True)

    def bandmath(self, expression: str, bands: Sequence[str]) -> Cube:
        """An expression over bands of the same cell. Bands become columns in one grouped pass, however many there are."""
        wide = self.wide(bands)
        rest = tuple(d for d in self.dims if d != "band")
        return Cube(wide.select(*rest, compile_expression(expression, {b: F.col(b) for b in bands}).cast("double").alias("value")), rest, "bandmath")

    # reduction
    def reduce(self, how: str | Callable[[Column], Column], dims: str | Sequence[str] | None = None) -> Cube:
        """mean, max, min, median, std (population), count or sum over dimensions, over all if none is named, or any aggregate
        given as a function from the value's column. NULL cells are skipped."""
        over = set(self.dims if dims is None else [dims] if isinstance(dims, str) else dims)
        for d in over:
            self._require(d)
        rest = tuple(d for d in self.dims if d not in over)
        named = how if isinstance(how, str) else getattr(how, "__name__", "reduced")
        value = (REDUCERS[how] if isinstance(how, str) else how)(F.col("value")).cast("double").alias("value")
        return Cube(self.df.groupBy(*rest).agg(value) if rest else self.df.agg(value), rest, f"{self.name}_{named}")

    def resample(self, period: str, how: str) -> Cube:
        """Aggregate over calendar periods of ``time``: days, ISO weeks, months, quarters or years, labelled by start."""
        self._require("time")
        rest = [d for d in self.dims if d != "time"]
        start = F.date_trunc(PERIODS[period], F.col("time")).alias("time")
        return Cube(self.df.groupBy(start, *rest).agg(REDUCERS[how](F.col("value")).cast("double").alias("value")), ("time", *rest), f"{self.name}_{how}")

    # shape
    def wide(self, bands: Sequence[str]) -> DataFrame:
        rest = [d for d in self.dims if d != "band"]
        return self.df.groupBy(*rest).pivot("band", list(bands)).agg(F.first("value", ignorenulls=True))

    def shape(self) -> dict[str, int]:
        row = self.df.agg(*[F.countDistinct(d).alias(d) for d in self.dims]).first()
        return row.asDict() if row else {}

    def to_pandas(self):
        return self.df.toPandas()

    def to_numpy(self) -> np.ndarray:
        """Dense array in the order of dims with sorted labels, NaN where a cell is missing. For results of export size."""
        pdf = self.to_pandas()
        if not self.dims:
            return np.asarray(pdf["value"])
        codes = [np.unique(pdf[d], return_inverse=True) for d in self.dims]
        out = np.full([len(labels) for labels, _ in codes], np.nan)
        out[tuple(inverse for _, inverse in codes)] = pdf["value"]
        return out

    def to_xarray(self, bounds: tuple[float, float, float, float] | None = None, attrs: Mapping | None = None):
        """An xarray.DataArray of the dense cube, where that library is installed; ``bounds`` (degrees) give lon and lat."""
        import xarray

        cells = self.to_pandas()
        labels = {d: np.sort(cells[d].unique()) for d in self.dims}
        out = xarray.DataArray(self.to_numpy(), coords=labels, dims=list(self.dims), name=self.name, attrs=dict(attrs or {}))
        if bounds:
            x0, y0, x1, y1 = bounds
            out = out.assign_coords(lon=("x", np.linspace(x0, x1, len(labels["x"]))), lat=("y", np.linspace(y1, y0, len(labels["y"]))))
        return out


def align_outer(cells: DataFrame, dims: Mapping[str, Sequence[str]]) -> DataFrame:
    """Dense union of scenes of different extents: every instant of the first group of dims with every cell of the
    second, value NULL where a scene has none. dims: {"outer": [...], "inner": [...]}, and under "by" dims whose groups
    are aligned each on its own. For export: the result is as large as the product, which is its meaning; kept sparse
    everywhere else."""
    outer, inner, by = list(dims["outer"]), list(dims["inner"]), list(dims.get("by", []))
    if by:
        frame = cells.select(*by, *outer).distinct().join(cells.select(*by, *inner).distinct(), by)
        return frame.join(cells, [*by, *outer, *inner], "left")
    places = cells.select(*inner).distinct()
    times = cells.select(*outer).distinct().agg(F.collect_set(F.struct(*outer)).alias("_t"))
    frame = places.join(F.broadcast(times)).select(*inner, F.explode("_t").alias("_t")).select(*[F.col(f"_t.{c}").alias(c) for c in outer], *inner)
    return frame.join(cells, [*outer, *inner], "left")


def trend(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Per group: number, mean, extremes, population deviation and slope of the straight line over the position in time."""
    at = Window.partitionBy(*keys).orderBy(order)
    x = (F.row_number().over(at) - 1).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), x.alias("x"))
    return rows.groupBy(*keys).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("std"), F.regr_slope("v", "x").alias("slope")
    )


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
