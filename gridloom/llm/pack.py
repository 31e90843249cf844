"""Filling containers of fixed capacity with texts, by tokens.

Method: Karmarkar-Karp multiway differencing. A window of texts is to be divided
into k containers. Every text starts as a partial partition with one filled
container; the two partitions with the largest imbalance are merged again and
again, the fullest containers of one with the emptiest of the other, until one
partition is left. Its containers are near-equal. k starts at the least number
that could do and rises whenever a container exceeds the capacity.

Differencing balances, and with three or four texts a container near-equal still means
some 2 % below the fullest. So before the count rises, an overfull container and an
emptier one are differenced anew, completely: of all ways to give their texts opposite
signs the best is taken. ``mend=False`` leaves that out; ``fill_report`` compares both.

Only a text longer than the capacity is divided: into full containers and a rest
that is packed like a text. Windows are formed where the texts lie, so nothing is
shuffled: a task gathers ``window`` containers' worth of tokens or a few texts more,
until the tokens fill a whole number of containers up to a little slack, packs them,
and goes on; per task one last window is smaller. Skewed sources make no difference.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import VOCABULARY, Vocabulary, pieces, worker

CAPACITY = 4096
#: Containers of a window. More give a little less unused space and take longer to merge.
WINDOW = 128
#: Share of a window's room that is left for slack, at least, where its end can be chosen.
LOOSE = 0.002
#: Containers an overfull one is divided anew with, and items of the two at most; beyond that, items are exchanged.
PARTNERS, TOGETHER = 64, 12


def differencing(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """k containers as (filled, items): items are indices into ``sizes``. Only filled containers of a partial partition
    are held, in ascending order; the others are empty."""
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        # The fullest of b go to the emptiest of a: empty ones first, then a's filled ones in ascending order.
        out = list(a)
        for j, (s, items) in enumerate(reversed(b)):
            if j < free:
                out.append((s, items))
            else:
                t, own = a[j - free]
                out[j - free] = (t + s, own + items)
        out.sort(key=lambda c: c[0])
        spread = out[-1][0] - (out[0][0] if len(out) == k else 0)
        heapq.heappush(heap, (-spread, tick, out))
        tick += 1
    return heap[0][2] if heap else []


def exchange(sizes: np.ndarray, home: np.ndarray, filled: np.ndarray, capacity: int) -> bool:
    """Bring overfull containers down to the capacity by exchanging one item for a smaller one, or for nothing, of another
    container with room for the difference, the smallest sufficient difference first; changes home and filled in place.
    False if one stays overfull."""
    items = len(sizes)
    sizes = np.concatenate([sizes, np.zeros(len(filled), np.int64)])  # an item of no size in each: to move is to exchange
    place = np.concatenate([home, np.arange(len(filled))])
    done = _exchange(sizes, place, filled, capacity)
    home[:] = place[:items]
    return done


def _exchange(sizes: np.ndarray, home: np.ndarray, filled: np.ndarray, capacity: int) -> bool:
    for _ in range(8 * len(filled)):
        c = int(filled.argmax())
        over = filled[c] - capacity
        if over <= 0:
            return True
        room = np.where(np.arange(len(filled)) == c, -1, capacity - filled)
        mine = np.flatnonzero(home == c)
        d = sizes[mine][:, None] - sizes[None, :]
        fits = (d >= 1) & (d <= room[home][None, :])
        enough = np.where(fits & (d >= over), d, np.iinfo(np.int64).max)
        at = int(enough.argmin())
        if enough.flat[at] == np.iinfo(np.int64).max:
            some = np.where(fits, d, 0)
            at = int(some.argmax())
            if not some.flat[at]:
                return False
        i, j = mine[at // len(sizes)], at % len(sizes)
        step = sizes[i] - sizes[j]
        filled[c] -= step
        filled[home[j]] += step
        home[i], home[j] = home[j], c
    return bool(filled.max() <= capacity)


@cache
def _subsets(n: int) -> np.ndarray:
    """All subsets of n items that hold the first one, as rows of 0 and 1."""
    return ((np.arange(1 << (n - 1))[:, None] >> np.arange(n - 1)) & 1).astype(np.int64) if n > 1 else np.zeros((1, 0), np.int64)


def redivide(sizes: np.ndarray, home: np.ndarray, filled: np.ndarray, capacity: int) -> bool:
    """Bring overfull containers down by dividing their items and those of another container anew: of all divisions of
    the two the one that fills a container fullest without exceeding it, else the one that leaves the least excess.
    Containers with much room are tried first. Changes home and filled in place; False if one stays overfull."""
    for _ in range(4 * len(filled)):
        c = int(filled.argmax())
        if filled[c] <= capacity:
            return True
        mine, best = np.flatnonzero(home == c), (int(filled[c] - capacity), -1, None, None)
        for d in np.argsort(filled, kind="stable")[:PARTNERS].tolist():
            both = np.concatenate([mine, np.flatnonzero(home == d)])
            if d == c or len(both) > TOGETHER:
                continue
            one = sizes[both[0]] + _subsets(len(both)) @ sizes[both[1:]]
            other = filled[c] + filled[d] - one
            excess = np.maximum(one - capacity, 0) + np.maximum(other - capacity, 0)
            if excess.min() == 0:
                at = int(np.where(excess == 0, np.maximum(one, other), -1).argmax())
                best = (0, d, both, at)
                break
            if excess.min() < best[0]:
                best = (int(excess.min()), d, both, int(excess.argmin()))
        _, d, both, at = best
        if both is None:
            return False
        first = np.concatenate([[1], _subsets(len(both))[at]]).astype(bool)
        home[both] = np.where(first, c, d)
        filled[c], filled[d] = sizes[both[first]].sum(), sizes[both[~first]].sum()
    return bool(filled.max() <= capacity)


def pack_window(sizes: list[int], capacity: int = CAPACITY, mend: bool = True) -> list[list[int]]:
    """Containers as lists of indices into ``sizes``; no size exceeds the capacity. The number of containers rises from
    the least possible until the fullest one fits; with one container a text it always does. With ``mend`` the containers
    that differencing leaves a little overfull are divided anew with others, or exchange items, before the number rises."""
    k = max(1, -(-sum(sizes) // capacity))
    n = np.array(sizes, np.int64)
    while True:
        parts = differencing(sizes, k)
        home, filled = np.zeros(len(sizes), np.int64), np.zeros(max(k, 1), np.int64)
        for c, (s, items) in enumerate(parts):
            home[items], filled[c] = c, s
        if filled.max() <= capacity or mend and (redivide(n, home, filled, capacity) or exchange(n, home, filled, capacity)):
            order = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.diff(home[order])) + 1
            return [x.tolist() for x in np.split(order, cuts)] if len(order) else []
        k += 1


def _windows(entries: Iterator[tuple[int | None, int]], capacity: int, window: int, mend: bool = True) -> Iterator[list[tuple]]:
    """Placements (container of the task, doc_id, piece, token_start, n_tokens, offset) of one window after another."""
    number = 0
    held: list[tuple[int | None, int, int, int]] = []
    filled = 0

    def flush() -> list[tuple]:
        nonlocal number, held, filled
        rows = []
        # Items of full size are containers already; the rest is differenced.
        for doc, piece, start, n in [h for h in held if h[3] == capacity]:
            rows.append((number, doc, piece, start, n, 0))
            number += 1
        rest = [h for h in held if h[3] < capacity]
        for items in pack_window([h[3] for h in rest], capacity, mend):
            offset = 0
            for i in items:
                doc, piece, start, n = rest[i]
                rows.append((number, doc, piece, start, n, offset))
                offset += n
            number += 1
        held, filled = [], 0
        return rows

    for doc, n in entries:
        for piece, start in enumerate(range(0, n, capacity)):
            take = min(capacity, n - start)
            held.append((doc, piece, start, take))
            filled += take
            slack = -filled % capacity
            if filled >= window * capacity and (LOOSE <= slack / filled <= 2 * LOOSE or filled >= 2 * window * capacity):
                yield flush()
    if held:
        yield flush()


SCHEMA = "container_id bigint, doc_id bigint, piece int, token_start bigint, n_tokens int, offset int"


def containers(documents: DataFrame, capacity: int = CAPACITY, window: int = WINDOW, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", mend: bool = True) -> DataFrame:
    """Where every token goes: tokens [token_start, token_start + n_tokens) of a document lie in the container from
    ``offset`` on. A document that fits the capacity has one row (piece 0).

    NULL and empty texts have no tokens and so no row. Repeated rows are packed once each; other columns are ignored;
    an empty table gives no containers. container_id holds the task's partition and a number within it, so a task that
    runs again after a loss gives the same containers; another split of the input into tasks gives other containers."""
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, encoder = TaskContext.get().partitionId() << 40, worker(shared.value)

        def entries() -> Iterator[tuple[int | None, int]]:
            for batch in batches:
                for row, end, b, limits in pieces(batch.column(1)):
                    _, n = encoder.texts(b, limits, sizes_only=True)
                    yield from zip(batch.column(0).slice(row, end - row).to_pylist(), n.tolist(), strict=True)

        for rows in _windows(entries(), capacity, window, mend):
            c = list(zip(*rows, strict=True))
            cols = [pa.array(np.array(c[0]) + base, pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[x.strip().split()[0] for x in SCHEMA.split(",")])

    return documents.select(key, text).mapInArrow(pack, SCHEMA)


def fill_report(placements: dict[str, DataFrame], capacity: int = CAPACITY) -> DataFrame:
    """One row per way of packing, by its name: containers, items, tokens, unused share, fullest and emptiest container."""
    named = reduce(DataFrame.unionByName, [p.withColumn("packed_by", F.lit(name)) for name, p in placements.items()])
    per = named.groupBy("packed_by", "container_id").agg(F.sum(F.col("n_tokens").cast("long")).alias("filled"), F.count(F.lit(1)).alias("items"))
    return per.groupBy("packed_by").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("items").alias("items"),
        F.sum("filled").alias("tokens"),
        (1 - F.try_divide(F.sum("filled").cast("double"), F.count(F.lit(1)) * float(capacity))).alias("unused_share"),
        F.max("filled").alias("fullest"),
        F.min("filled").alias("emptiest"),
    )
