"""Implausible statistics, flagged per series relative to the series itself.

Method: a hidden Markov model per series (tile, satellite, band). Its states are
normal, spike, out of range and a chain of ``RUN`` stuck states: the chain is
entered at its first state by a reading that is new, each further one must repeat
the reading before it, and only the last one may stay or leave, so stuck stretches
of fewer than ``RUN`` readings have no path. The normal state emits distances from the series' middle
on the series' own scale, which is fitted to the series by trimmed estimation;
the spike state has a heavy tail on the same scale; the state out of range emits
what breaks the hard bounds (negative, or min, mean, max not in order) and nothing
else. Forward-backward probabilities decide: a reading is stuck if the chain has
more than half of its probability, and a row is a spike if, in the context of the
readings around it, spike is more probable than normal. Hard bounds give out of range.

Middle and scale are functions of the distinct triples of a series, so neither
copies nor stuck values weigh in them. Rows are shuffled once, by series. A series
of more than ``limit`` rows is cut into time shards: its middle comes from an exact
radix selection, its scale from the histogram that short series use too, each shard
is reduced to its forward operator and its first and last reading, a scan over the
shards hands every shard the messages at its ends, and all shards finish
independently. Both ways give the same flags.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.joins import null_safe_join
from gridloom.functions.tiles import canonical_or_self

SERIES = ["tile_id", "satellite_id", "band"]
STATS = ["min_value", "max_value", "mean_value"]
RUN = 6
NORMAL, SPIKE, OUT, STUCK = 0, 1, 2, 3  # STUCK is the first of RUN states
STATES = STUCK + RUN
#: Fall of the normal state's density per unit of the series' scale; the spike state's is 1 / (z * TAIL) from one unit on.
FALL, TAIL = 1.3, 14.0
#: Chance that an ordinary reading repeats the one before.
REPEAT = 0.02
#: The statistics are of whole pixels: rounding alone moves them by so much.
ROUNDING = 0.5
#: Distances beyond so many units of the scale do not count towards it.
TRIM = 5.0
#: Buckets of distances: so many per octave, from 2**OCTAVES[0] to 2**OCTAVES[1]; a distance below counts as the least.
PER_OCTAVE, OCTAVES = 8, (-8, 40)
BUCKETS = PER_OCTAVE * (OCTAVES[1] - OCTAVES[0]) + 1
FLAGS = ("ok", "spike", "stuck", "out_of_range")
NEVER = 1e-30


def _transitions() -> np.ndarray:
    step = np.zeros((STATES, STATES))
    step[[NORMAL, SPIKE, OUT, STATES - 1], NORMAL] = 0.96, 0.96, 0.96, 0.1
    step[[NORMAL, SPIKE, OUT, STATES - 1], SPIKE] = 0.02, 0.02, 0.02, 0.01
    step[[NORMAL, SPIKE, OUT, STATES - 1], OUT] = 0.01
    step[[NORMAL, SPIKE, OUT, STATES - 1], STUCK] = 0.01
    for k in range(STUCK, STATES - 1):
        step[k, k + 1] = 1.0
    step[-1, -1] = 0.87
    return step


STEP = _transitions()
#: Before the first reading a series is normal; after the last one the chain must be complete.
START = np.eye(STATES)[NORMAL]
END = np.array([1.0, 1.0, 1.0, *[0.0] * (RUN - 1), 1.0])


def _near(z: np.ndarray) -> np.ndarray:
    return FALL * np.exp(-FALL * np.minimum(z, 200.0))


def _far(z: np.ndarray) -> np.ndarray:
    return 1.0 / (TAIL * np.clip(z, 1.0, 1e9))


def _emissions(z: np.ndarray, same: np.ndarray, hard: np.ndarray) -> np.ndarray:
    near, far = _near(z), _far(z)
    e = np.empty((len(z), STATES))
    repeat = np.where(same, REPEAT, 1.0 - REPEAT)
    e[:, NORMAL], e[:, SPIKE], e[:, OUT] = near * repeat, far * repeat, NEVER
    any_level = 0.5 * near + 0.5 * far
    e[:, STUCK] = np.where(same, NEVER, any_level)
    e[:, STUCK + 1 :] = np.where(same, any_level, NEVER)[:, None]
    e[hard] = NEVER
    e[hard, OUT] = 1.0
    return np.maximum(e, NEVER)


def _forward_backward(e: np.ndarray, first: np.ndarray, length: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state probabilities, context) of all readings of many sequences side by side; the context of a reading is what
    all others say of its state. e: emissions of all readings, sequence k being e[first[k] : first[k] + length[k]];
    before, after: messages into its two ends."""
    order = np.argsort(-length, kind="stable")
    first, length, alpha, beta = first[order], length[order], before[order].copy(), after[order].copy()
    context = np.empty_like(e)
    live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    for t, n in enumerate(live):
        at = first[:n] + t
        ahead = alpha[:n] @ STEP
        context[at] = ahead
        a = ahead * e[at]
        alpha[:n] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = first[:n] + t
        c = context[at] * beta[:n]
        context[at] = c / c.sum(axis=1, keepdims=True)
        b = (e[at] * beta[:n]) @ STEP.T
        beta[:n] = b / b.sum(axis=1, keepdims=True)
    p = context * e
    return p / p.sum(axis=1, keepdims=True), context


def _operator(e: np.ndarray) -> np.ndarray:
    """The forward operator of a stretch of readings: the normalised product of STEP and emissions."""
    m = np.eye(STATES)
    for row in e:
        m = (m @ STEP) * row
        m /= m.sum()
    return m


def _starts(*codes: np.ndarray) -> np.ndarray:
    """Positions where any of the codes differs from the row before."""
    n = len(codes[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in codes:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _triples(v: np.ndarray) -> np.ndarray:
    """A number for each row; equal for equal triples of statistics."""
    raw = np.ascontiguousarray(v + 0.0).view([("", np.float64)] * 3).ravel()
    return np.unique(raw.view("V24"), return_inverse=True)[1].ravel()


def _scale(counts: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Scale of each series from its histogram of distances (rows: series): the root of the mean square of the distances
    within ``TRIM`` scales, from 1.2 medians on until it stands, at least ``ROUNDING``."""
    edges = np.concatenate([[0.0], 2.0 ** (np.arange(1, BUCKETS) / PER_OCTAVE + OCTAVES[0] - 1 / PER_OCTAVE)])
    n, s = np.cumsum(counts, axis=1), np.cumsum(squares, axis=1)
    total = n[:, -1]
    half = np.minimum((n < (total[:, None] + 1) // 2).sum(axis=1), BUCKETS - 1)
    scale = np.maximum(1.2 * np.append(edges[1:], edges[-1])[half], ROUNDING)
    rows = np.arange(len(scale))
    for _ in range(10):
        last = np.searchsorted(edges, TRIM * scale) - 1
        scale = np.maximum(np.sqrt(s[rows, last] / np.maximum(n[rows, last], 1)), ROUNDING)
    return scale


def _bucket(d: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        k = np.floor(PER_OCTAVE * np.log2(d)) - PER_OCTAVE * OCTAVES[0] + 1
    return np.clip(np.nan_to_num(k, nan=0.0, neginf=0.0, posinf=BUCKETS - 1), 0, BUCKETS - 1).astype(np.int64)


def _fit(v: np.ndarray, hard: np.ndarray, sid: np.ndarray, k: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, scale) per series and statistic, from the distinct triples of each series."""
    one = np.unique(sid * np.int64(len(v) + 1) + code, return_index=True)[1]
    one = one[~hard[one]]
    x, s = v[one], sid[one]
    middle, scale = np.full((k, 3), np.nan), np.full((k, 3), ROUNDING)
    for c in range(3):
        use = np.isfinite(x[:, c])
        y, o = x[use, c], s[use]
        order = np.lexsort((y, o))
        y, o = y[order], o[order]
        m = np.bincount(o, minlength=k)
        at = np.concatenate([[0], np.cumsum(m)[:-1]])
        some = np.flatnonzero(m)
        middle[some, c] = (y[(at + np.maximum(m - 1, 0) // 2)[some]] + y[(at + m // 2)[some]]) / 2
        d = np.abs(y - middle[o, c])
        slot = o * BUCKETS + _bucket(d)
        counts = np.bincount(slot, minlength=k * BUCKETS).reshape(k, BUCKETS)
        d2 = np.minimum(d, 2.0 ** (OCTAVES[1] + 1)) ** 2
        scale[:, c] = _scale(counts, np.bincount(slot, d2, k * BUCKETS).reshape(k, BUCKETS))
    return middle, scale


def _distance(v: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Distance from the middle in units of the scale, the largest of the three statistics."""
    with np.errstate(invalid="ignore", over="ignore"):
        z = np.abs(v - middle) / scale
    return np.max(np.nan_to_num(z, nan=0.0, posinf=1e300), axis=1)


class _Readings:
    """Readings of many sequences: rows of one sequence and time are one reading. A reading repeats the one before if a
    row of it has the three statistics of a row of that one. ``before`` and ``behind``: triples of the readings around
    each sequence, where it is a shard."""

    def __init__(self, first, length, t, v, hard, code, middle, scale, before=None, behind=None):
        n = len(t)
        self.sid = np.repeat(np.arange(len(first)), length)
        new = np.zeros(n, bool)
        new[first] = True
        new[1:] |= t[1:] != t[:-1]
        self.rows = np.flatnonzero(new)
        self.of = of = np.cumsum(new) - 1
        self.owner = self.sid[self.rows]
        self.head = _starts(self.owner)
        self.count = np.diff(np.append(self.head, len(self.rows)))
        tail = np.append(self.head[1:], len(self.rows)) - 1
        whole = ~np.isnan(v).any(axis=1)
        width = np.int64(n + 1)
        there = np.unique(of * width + code)
        is_head, is_tail = np.zeros(len(self.rows), bool), np.zeros(len(self.rows), bool)
        is_head[self.head], is_tail[tail] = True, True
        in_last = whole & ~is_head[of] & np.isin((of - 1) * width + code, there)
        in_next = whole & ~is_tail[of] & np.isin((of + 1) * width + code, there)
        for known, ends, mark in ((before, is_head, in_last), (behind, is_tail, in_next)):
            for i in np.flatnonzero(ends[of]) if known is not None else ():
                mark[i] |= tuple(v[i]) in known[self.sid[i]]
        self.repeats = in_last | in_next
        self.same = np.logical_or.reduceat(in_last, self.rows)
        self.z_row = _distance(v, middle[self.sid], scale[self.sid])
        # For the readings around it a reading is what its most ordinary row is.
        self.z = np.minimum.reduceat(np.where(hard, np.inf, self.z_row), self.rows)
        self.hard = np.logical_and.reduceat(hard, self.rows)
        self.z[self.hard] = 0.0
        self.tail = tail

    def emissions(self) -> np.ndarray:
        return _emissions(self.z, self.same, self.hard)

    def flags(self, hard: np.ndarray, start: np.ndarray, end: np.ndarray, model=_forward_backward) -> tuple[np.ndarray, np.ndarray]:
        """(flag, probability of not being normal) of every row."""
        p, context = model(self.emissions(), self.head, self.count, start, end)
        stuck = (p[:, STUCK:].sum(axis=1) > 0.5)[self.of] & self.repeats
        own = context[self.of, :STUCK] * np.stack([_near(self.z_row), _far(self.z_row), np.zeros(len(self.of))], axis=1)
        flag = np.where(stuck, 2, np.where(own[:, SPIKE] > own[:, NORMAL], 1, 0))
        flag[hard] = 3
        shown = np.where(stuck, p[self.of, STUCK:].sum(axis=1), own[:, SPIKE] / np.maximum(own[:, SPIKE] + own[:, NORMAL], 1e-300))
        return flag.astype(np.int8), np.where(hard, 1.0, shown)


def series_rows(observations: DataFrame) -> DataFrame:
    """The rows that can be cases, with the series in canonical spelling. Rows whose statistics are all NULL, whose
    mean_value is NaN, or that have no time are none. Extra columns are ignored."""
    null = F.col("min_value").isNull() & F.col("max_value").isNull() & F.col("mean_value").isNull()
    return observations.where(~null & ~F.coalesce(F.isnan("mean_value"), F.lit(False)) & F.col("time").isNotNull()).select(
        canonical_or_self("tile_id").alias("tile_id"), "satellite_id", "band", F.unix_micros("time").alias("t"), "obs_id", *[F.col(c).cast("double") for c in STATS]
    )


def _hard(v: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return (v < 0).any(axis=1) | (v[:, 0] > v[:, 2]) | (v[:, 2] > v[:, 1])


def _hard_column() -> Column:
    lo, hi, mid = (F.when(~F.isnan(c), F.col(c)) for c in STATS)
    no = F.lit(False)
    return F.coalesce(lo < 0, no) | F.coalesce(hi < 0, no) | F.coalesce(mid < 0, no) | F.coalesce(lo > mid, no) | F.coalesce(mid > hi, no)


def _numbers(tab: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([tab.column(c).to_numpy().astype(float) for c in names], axis=1)


def _columns(tab: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first row and length of each group, times, statistics) of a sorted table."""
    codes = [pc.fill_null(tab.column(c).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for c in keys]
    first = _starts(*codes)
    return first, np.diff(np.append(first, tab.num_rows)), tab.column("t").to_numpy(), _numbers(tab, STATS)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group ends; a group is held until its last row has come."""
    rest: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(c)[i].as_py() for c in keys)

    for b in batches:
        if not b.num_rows:
            continue
        last = key(b, b.num_rows - 1)
        if rest and key(rest[-1], rest[-1].num_rows - 1) != key(b, 0):
            yield pa.Table.from_batches(rest)
            rest = []
        same = np.ones(b.num_rows, bool)
        for c, x in zip(keys, last, strict=True):
            col = b.column(c)
            hit = col.is_null() if x is None else pc.fill_null(pc.equal(col, pa.scalar(x, col.type)), False)
            same &= hit.to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*rest, b.slice(0, cut)])
            rest = []
        rest.append(b.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def _flag_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tab in _whole_groups(batches, SERIES):
        first, length, t, v = _columns(tab, SERIES)
        hard, code, k = _hard(v), _triples(v), len(first)
        middle, scale = _fit(v, hard, np.repeat(np.arange(k), length), k, code)
        flag, p = _Readings(first, length, t, v, hard, code, middle, scale).flags(hard, np.tile(START, (k, 1)), np.tile(END, (k, 1)))
        yield pa.RecordBatch.from_arrays([tab.column("obs_id").combine_chunks(), _names(flag), pa.array(p)], names=["obs_id", "flag", "p_abnormal"])


def _names(flag: np.ndarray) -> pa.Array:
    return pa.array(np.array(FLAGS, object)[flag], pa.string())


RESULT = "obs_id bigint, flag string, p_abnormal double"


def flagged(observations: DataFrame, limit: int = 50_000) -> DataFrame:
    """(obs_id, flag, p_abnormal) for every row that has statistics; flag is ok, spike, stuck or out_of_range.

    Series of more than ``limit`` rows are worked in time shards of about ``limit`` rows. NULLs in the series' columns
    form a series; repeated rows each get their flag; an empty table gives no rows."""
    rows = series_rows(observations)
    sizes = rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).drop("n")
    hot = sizes.count()  # at most rows / limit
    order = [*SERIES, "t", "obs_id"]
    if not hot:
        return rows.repartition(*SERIES).sortWithinPartitions(*order).mapInArrow(_flag_whole, RESULT)
    few = hot <= 10_000
    plain = null_safe_join(rows, sizes, SERIES, "left_anti", few).repartition(*SERIES).sortWithinPartitions(*order).mapInArrow(_flag_whole, RESULT)
    return plain.unionByName(_flag_sharded(null_safe_join(rows, sizes, SERIES, "left_semi", few), limit))


def _middles(values: DataFrame) -> DataFrame:
    """(series, c, lo, hi): the two middle values of each statistic, exactly, by radix selection: values are counted by
    their upper and then by their lower half of bits (in order of size), 65,536 counts a series at most each time.
    Statistics are single precision by schema; wider values are counted by their nearest single first."""
    key = [*SERIES, "c"]

    @F.pandas_udf("bigint")
    def ordered(x: pd.Series) -> pd.Series:
        bits = x.to_numpy(np.float32).view(np.int32).astype(np.int64)
        return pd.Series(np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) + (1 << 31))

    @F.pandas_udf("double")
    def value(code: pd.Series) -> pd.Series:
        k = code.to_numpy() - (1 << 31)
        return pd.Series(np.where(k < 0, -k | (1 << 31), k).astype(np.uint32).view(np.float32).astype(float))

    coded = values.select(*key, ordered("x").alias("code"))
    upper = coded.groupBy(*key, F.shiftright("code", 16).alias("top")).agg(F.count(F.lit(1)).alias("k"))
    run = Window.partitionBy(*key).orderBy("top")
    total = F.sum("k").over(Window.partitionBy(*key))
    ranked = upper.withColumns({"below": F.sum("k").over(run) - F.col("k"), "m": total})
    wanted = ranked.withColumn("rank", F.explode(F.array(F.floor((F.col("m") - 1) / 2), F.floor(F.col("m") / 2))))
    tops = wanted.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("k"))).groupBy(*key, "top", "below").agg(F.collect_set("rank").alias("ranks"))
    lower = coded.groupBy(*key, F.shiftright("code", 16).alias("top"), "code").agg(F.count(F.lit(1)).alias("k"))
    fine = null_safe_join(lower, tops, [*key, "top"])
    run = Window.partitionBy(*key, "top").orderBy("code")
    placed = fine.withColumn("from", F.col("below") + F.sum("k").over(run) - F.col("k")).withColumn("rank", F.explode("ranks"))
    hit = placed.where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("from") + F.col("k")))
    return hit.groupBy(*key).agg(((value(F.min("code")) + value(F.max("code"))) / 2).alias("middle"))


def _hot_parameters(rows: DataFrame) -> DataFrame:
    """Middle and scale of each series from counts that merge: see _middles and _scale."""
    distinct = rows.where(~_hard_column()).select(*SERIES, *STATS).distinct()
    x = distinct.select(*SERIES, F.posexplode(F.array(*STATS)).alias("c", "x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    key = [*SERIES, "c"]
    d = null_safe_join(x, _middles(x), key).withColumn("d", F.abs(F.col("x") - F.col("middle")))
    bucket = F.when(F.col("d") > 0, F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor(PER_OCTAVE * F.log2("d")) - PER_OCTAVE * OCTAVES[0] + 1))).otherwise(F.lit(0))
    d2 = F.pow(F.least("d", F.lit(2.0 ** (OCTAVES[1] + 1))), 2)
    counts = d.groupBy(*key, "middle", bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("k"), F.sum(d2).alias("s"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        middle, scale = [math.nan] * 3, [ROUNDING] * 3
        for c, part in pdf.groupby("c"):
            n, s = np.zeros((1, BUCKETS)), np.zeros((1, BUCKETS))
            n[0, part["bucket"]], s[0, part["bucket"]] = part["k"], part["s"]
            middle[c], scale[c] = part["middle"].iloc[0], float(_scale(n, s)[0])
        return pdf[SERIES].head(1).assign(middle=[middle], scale=[scale])

    text = "tile_id string, satellite_id string, band string"
    return counts.groupBy(*SERIES).applyInPandas(fit, f"{text}, middle array<double>, scale array<double>")


def _time_shards(rows: DataFrame, limit: int) -> DataFrame:
    """(series, hour, shard): whole hours in order, put together to shards of about ``limit`` rows."""
    hours = rows.groupBy(*SERIES, _hour().alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*SERIES).orderBy("hour")
    return hours.select(*SERIES, "hour", F.floor((F.sum("n").over(run) - F.col("n")) / limit).cast("int").alias("shard"))


def _hour() -> Column:
    return F.floor(F.col("t") / 3_600_000_000)


def _flag_sharded(rows: DataFrame, limit: int) -> DataFrame:
    """Flags of the rows of hot series. Copies (same series, time and statistics) are worked once and joined back."""
    once = rows.select(*SERIES, "t", *STATS).distinct()
    params = _hot_parameters(once).select(*SERIES, *[F.get(n, F.lit(i)).alias(f"{n}_{i}") for n in ("middle", "scale") for i in range(3)])
    sharded = null_safe_join(once.withColumn("hour", _hour()), _time_shards(once, limit), [*SERIES, "hour"]).drop("hour")
    # A series of hard or unreadable rows only has no parameters; every distance from no middle is 0.
    wide = null_safe_join(sharded, params, SERIES, "left")
    key = [*SERIES, "shard"]

    def parts(tab: pa.Table, around=(None, None)):
        first, length, t, v = _columns(tab, key)
        at = lambda n: np.stack([tab.column(f"{n}_{i}").to_numpy().astype(float)[first] for i in range(3)], axis=1)
        hard = _hard(v)
        return first, length, v, hard, _Readings(first, length, t, v, hard, _triples(v), at("middle"), np.nan_to_num(at("scale"), nan=ROUNDING), *around)

    def triples(v: np.ndarray, of: np.ndarray, reading: int) -> list[list[float]]:
        own = v[np.searchsorted(of, reading) : np.searchsorted(of, reading, side="right")]
        return [x.tolist() for x in own if not np.isnan(x).any()]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in _whole_groups(batches, key):
            first, _, v, _, r = parts(tab)
            e = r.emissions()
            out = {c: [tab.column(c)[int(i)].as_py() for i in first] for c in key}
            out["op"] = [_operator(e[h + 1 : h + n]).ravel().tolist() for h, n in zip(r.head, r.count, strict=True)]
            out["head"] = [triples(v, r.of, h) for h in r.head]
            out["tail"] = [triples(v, r.of, h) for h in r.tail]
            out["z"], out["hard"] = r.z[r.head].tolist(), r.hard[r.head].tolist()
            yield pa.RecordBatch.from_pydict(out, schema=SUMMARY)

    text = "tile_id string, satellite_id string, band string, shard int"
    sorted_rows = wide.repartition(*key).sortWithinPartitions(*key, "t")
    summaries = sorted_rows.mapInArrow(summarise, f"{text}, op array<double>, head array<array<double>>, tail array<array<double>>, z double, hard boolean")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        n = len(pdf)
        heads, tails = ([{tuple(x) for x in rows} for rows in pdf[c]] for c in ("head", "tail"))
        joins = np.array([False, *[bool(heads[k] & tails[k - 1]) for k in range(1, n)]])
        e = _emissions(pdf["z"].to_numpy(), joins, pdf["hard"].to_numpy(bool))
        ops = [np.asarray(x).reshape(STATES, STATES) for x in pdf["op"]]
        start, end = np.empty((n, STATES)), np.empty((n, STATES))
        a = START.copy()
        for k in range(n):
            start[k] = a
            a = ((a @ STEP) * e[k]) @ ops[k]
            a /= a.sum()
        b = END.copy()
        for k in range(n - 1, -1, -1):
            end[k] = b
            b = STEP @ (e[k] * (ops[k] @ b))
            b /= b.sum()
        listed = lambda sets: [[list(x) for x in s] for s in sets]
        return pdf[key].assign(start=list(start), end=list(end), before=listed([set(), *tails[:-1]]), behind=listed([*heads[1:], set()]))

    messages = summaries.groupBy(*SERIES).applyInPandas(scan, f"{text}, start array<double>, end array<double>, before array<array<double>>, behind array<array<double>>")
    carried = null_safe_join(wide, messages, key)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in _whole_groups(batches, key):
            at = pa.array(_columns(tab, key)[0])
            pick = lambda n: tab.column(n).take(at).to_pylist()  # noqa: B023, E731
            around = [[{tuple(x) for x in rows} for rows in pick(n)] for n in ("before", "behind")]
            *_, hard, r = parts(tab, around)
            flag, p = r.flags(hard, np.array(pick("start")), np.array(pick("end")))
            kept = [tab.column(c).combine_chunks() for c in [*SERIES, "t", *STATS]]
            yield pa.RecordBatch.from_arrays([*kept, _names(flag), pa.array(p)], names=[*SERIES, "t", *STATS, "flag", "p_abnormal"])

    stats = ", ".join(f"{c} double" for c in STATS)
    told = carried.repartition(*key).sortWithinPartitions(*key, "t").mapInArrow(finish, f"tile_id string, satellite_id string, band string, t bigint, {stats}, flag string, p_abnormal double")
    return null_safe_join(rows, told, [*SERIES, "t", *STATS]).select("obs_id", "flag", "p_abnormal")


SUMMARY = pa.schema(
    [("tile_id", pa.string()), ("satellite_id", pa.string()), ("band", pa.string()), ("shard", pa.int32()), ("op", pa.list_(pa.float64())), ("head", pa.list_(pa.list_(pa.float64()))), ("tail", pa.list_(pa.list_(pa.float64()))), ("z", pa.float64()), ("hard", pa.bool_())]
)


def untrustworthy(observations: DataFrame, limit: int = 50_000) -> DataFrame:
    """obs_id of the rows whose statistics cannot be trusted."""
    return flagged(observations, limit).where(F.col("flag") != "ok").select("obs_id")
