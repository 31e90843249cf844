"""Resampling kernels. Pixel arrays are flattened row by row from the north-west."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP = 65535


def bilinear(values: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Bilinear with aligned end points, rounded half away from zero, kept within unsigned 16 bits. An empty input gives
    zeros, an input of the wanted size itself. Leading axes are images of their own."""
    if values.size == 0:
        return np.zeros((*values.shape[:-2], out_h, out_w), np.int32)
    h, w = values.shape[-2:]
    if (h, w) == (out_h, out_w):
        return values.astype(np.int32)

    def steps(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(m) * ((n - 1) / max(m - 1, 1))
        lo = np.minimum(at.astype(int), n - 1)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    y0, y1, fy = steps(h, out_h)
    x0, x1, fx = steps(w, out_w)
    v = values.astype(float)
    top, bottom = v[..., y0, :], v[..., y1, :]
    north = top[..., x0] * (1 - fx) + top[..., x1] * fx
    south = bottom[..., x0] * (1 - fx) + bottom[..., x1] * fx
    return np.clip(np.floor(north * (1 - fy)[:, None] + south * fy[:, None] + 0.5), 0, TOP).astype(np.int32)


def nearest(values: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Nearest by pixel centres."""
    if values.size == 0:
        return np.zeros((out_h, out_w), values.dtype)
    pick = lambda n, m: np.clip(np.floor((np.arange(m) + 0.5) * n / m - 0.5 + 0.5).astype(int), 0, n - 1)
    return values[np.ix_(pick(values.shape[0], out_h), pick(values.shape[1], out_w))]


def bilinear_column(pixels: Column, out_h: int, out_w: int) -> Column:
    """Resample square arrays in Arrow batches; NULL for a NULL array, an array with NULLs or one that is no square."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def kernel(s: pd.Series) -> pd.Series:
        arrays, out = s.tolist(), [None] * len(s)
        sizes = np.array([-1 if a is None else len(a) for a in arrays], dtype=int)
        for n in np.unique(sizes[sizes >= 0]):  # arrays of one size are resampled together
            side = int(round(n**0.5))
            if side * side != n:
                continue
            at = np.flatnonzero(sizes == n)
            v = np.array([arrays[i] for i in at], dtype=float)
            full = ~np.isnan(v).any(axis=1)
            got = bilinear(v[full].reshape(full.sum(), side, side), out_h, out_w)
            for i, image in zip(at[full], got.reshape(full.sum(), out_h * out_w), strict=True):
                out[i] = image
        return pd.Series(out, dtype=object)

    return kernel(pixels)


def nearest_column(values: Column, out_h: int, out_w: int) -> Column:
    """Nearest resampling of square arrays by array functions alone."""
    side = F.rint(F.sqrt(F.size(values).cast("double"))).cast("int")
    pick = lambda k, m: F.greatest(F.lit(0), F.least(side - 1, F.floor((k + 0.5) * side / m).cast("int")))
    index = F.sequence(F.lit(0), F.lit(out_h * out_w - 1))
    return F.when(side * side == F.size(values), F.transform(index, lambda k: F.get(values, pick(F.floor(k / out_w), out_h) * side + pick(k % out_w, out_w))))
