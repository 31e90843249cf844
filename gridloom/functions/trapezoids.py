"""Trapezoidal decomposition of polygons in the plane."""

from __future__ import annotations

import numpy as np


class Trapezoids:
    """Trapezoidal decomposition of polygons (lists of (x, y) rings, one ring per region)."""

    def __init__(self, rings: list[np.ndarray], ids: np.ndarray):
        a, b, owner = [], [], []
        for k, ring in enumerate(rings):
            p, q = ring, np.roll(ring, -1, axis=0)
            left = p[:, 0] <= q[:, 0]
            a.append(np.where(left[:, None], p, q))
            b.append(np.where(left[:, None], q, p))
            owner.append(np.full(len(ring), k))
        a, b = (np.concatenate(v) if v else np.empty((0, 2)) for v in (a, b))
        owner = np.concatenate(owner) if owner else np.empty(0, int)
        slanted = a[:, 0] < b[:, 0]  # a vertical edge bounds no gap
        a, b, owner = a[slanted], b[slanted], owner[slanted]
        self.ids = np.asarray(ids)
        xs = np.unique(np.concatenate([a[:, 0], b[:, 0], self._crossings(a, b)]))
        self.xs = xs
        slabs = max(len(xs) - 1, 0)
        lo, hi = np.searchsorted(xs, a[:, 0]), np.searchsorted(xs, b[:, 0])
        edge = np.repeat(np.arange(len(a)), hi - lo)
        slab = np.concatenate([np.arange(s, t) for s, t in zip(lo, hi, strict=True)]) if len(a) else np.empty(0, int)
        slope = (b[:, 1] - a[:, 1]) / (b[:, 0] - a[:, 0])
        base = a[:, 1] - slope * a[:, 0]
        mid = (xs[slab] + xs[slab + 1]) / 2 if len(slab) else np.empty(0)
        order = np.lexsort((base[edge] + slope[edge] * mid, slab))
        edge, slab = edge[order], slab[order]
        self.slope, self.base = slope[edge], base[edge]
        self.start = np.searchsorted(slab, np.arange(slabs + 1))
        # The regions that cover the gap above each edge: an edge of a region opens or closes it.
        cover: list[tuple[int, ...]] = []
        for s in range(slabs):
            inside: set[int] = set()
            for k in owner[edge[self.start[s] : self.start[s + 1]]].tolist():
                inside ^= {k}
                cover.append(tuple(sorted(inside)))
        self.cover_start = np.concatenate([[0], np.cumsum([len(c) for c in cover])]).astype(np.int64)
        self.cover = np.array([k for c in cover for k in c], np.int64)

    @staticmethod
    def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """x of all crossings, by a sweep over the edges' left ends."""
        order = np.argsort(a[:, 0], kind="stable")
        found: list[np.ndarray] = []
        live = np.empty(0, int)
        for e in order.tolist():
            live = live[b[live, 0] > a[e, 0]]
            near = live[(np.maximum(a[live, 1], b[live, 1]) >= min(a[e, 1], b[e, 1])) & (np.minimum(a[live, 1], b[live, 1]) <= max(a[e, 1], b[e, 1]))]
            if len(near):
                s = (b[near, 1] - a[near, 1]) / (b[near, 0] - a[near, 0])
                s0 = (b[e, 1] - a[e, 1]) / (b[e, 0] - a[e, 0])
                with np.errstate(divide="ignore", invalid="ignore"):
                    x = ((a[e, 1] - s0 * a[e, 0]) - (a[near, 1] - s * a[near, 0])) / (s - s0)
                ok = (x > np.maximum(a[near, 0], a[e, 0])) & (x < np.minimum(b[near, 0], b[e, 0]))
                found.append(x[ok])
            live = np.append(live, e)
        return np.concatenate(found) if found else np.empty(0)

    def locate(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of point, region id) for every region that covers a point. Points with a NaN are in none."""
        none = np.empty(0, np.int64)
        if len(self.xs) < 2:
            return none, self.ids[none]
        ok = np.flatnonzero(np.isfinite(x) & np.isfinite(y) & (x >= self.xs[0]) & (x <= self.xs[-1]))
        slab = np.minimum(np.searchsorted(self.xs, x[ok], side="right") - 1, len(self.xs) - 2)
        lo, hi = self.start[slab], self.start[slab + 1]  # the number of edges below the point lies in [lo, hi]
        px, py = x[ok], y[ok]
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = np.minimum(mid, len(self.base) - 1)
            below = self.base[at] + self.slope[at] * px <= py
            lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        inside = lo > self.start[slab]
        point, gap = ok[inside], lo[inside] - 1
        n = self.cover_start[gap + 1] - self.cover_start[gap]
        take = np.repeat(self.cover_start[gap] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(point, n), self.ids[self.cover[take]]

    def area(self) -> float:
        """Area that at least one region covers."""
        if len(self.xs) < 2:
            return 0.0
        slab = np.repeat(np.arange(len(self.xs) - 1), np.diff(self.start))
        y = self.base + self.slope * (self.xs[slab] + self.xs[slab + 1]) / 2
        covered = np.flatnonzero(np.diff(self.cover_start) > 0)  # never the last gap of a slab, which nothing covers
        return float(((y[covered + 1] - y[covered]) * np.diff(self.xs)[slab[covered]]).sum())
