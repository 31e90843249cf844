import math
import random

import numpy as np
from conftest import rows_of

from gridloom.operators import spikes


def series(n, rng, sat="s", base=1000.0, **more):
    out = []
    for k in range(n):
        v = base * (1 + 0.04 * math.sin(k / 9) + rng.uniform(-0.01, 0.01))
        out.append({"satellite_id": sat, "time": f"2024-{1 + k // 28 % 12:02d}-{1 + k % 28:02d} {k // 336:02d}:00", "min_value": v * 0.995, "max_value": v * 1.005, "mean_value": v} | more)
    return out


def flags(df, **more):
    return {r["obs_id"]: r["flag"] for r in spikes.flagged(df, **more).collect()}


def test_kinds(observations):
    rng = random.Random(1)
    rows = series(60, rng)
    rows[7] |= {"min_value": -9999.0}
    rows[11] |= {"max_value": 100.0}
    rows[20] |= {"max_value": 1400.0}
    rows[21] |= {"mean_value": float("nan")}
    rows[22] |= {"mean_value": None, "min_value": None, "max_value": None}
    for k in range(30, 36):
        rows[k] |= {"min_value": 990.0, "max_value": 1010.0, "mean_value": 1000.0}
    for k in range(50, 55):  # five are not enough
        rows[k] |= {"min_value": 991.0, "max_value": 1011.0, "mean_value": 1001.0}
    got = flags(observations(rows))
    assert {k: f for k, f in got.items() if f != "ok"} == {8: "out_of_range", 12: "out_of_range", 21: "spike", **dict.fromkeys(range(31, 37), "stuck")}
    assert 22 not in got and 23 not in got


def test_deliveries_count_once_for_a_run_and_are_flagged_each(observations):
    rng = random.Random(2)
    rows = series(30, rng)
    for k in range(10, 15):
        rows[k] |= {"min_value": 990.0, "max_value": 1010.0, "mean_value": 1000.0}
    assert set(flags(observations([*rows, rows[12]])).values()) == {"ok"}  # five readings, six rows
    rows[15] |= {"min_value": 990.0, "max_value": 1010.0, "mean_value": 1000.0}
    got = flags(observations([*rows, rows[12], rows[13] | {"mean_value": 1003.0}]))
    assert sorted(k for k, f in got.items() if f == "stuck") == [11, 12, 13, 14, 15, 16, 31]


def test_other_unit_and_slow_change_are_ordinary(observations):
    rng = random.Random(3)
    rows = series(80, rng, base=30.0) + series(80, rng, sat="b", base=200_000.0) + [r | {"satellite_id": None} for r in series(80, rng)]
    assert set(flags(observations(rows)).values()) == {"ok"}


def random_table(rng, series_rows=150):
    rows = []
    for sat in ("a", "b", None):
        part = series(series_rows, rng, sat)
        for k in rng.sample(range(series_rows), 3):
            part[k] |= {"mean_value": part[k]["max_value"] - 1, "max_value": 2500.0}
        at = rng.randrange(20, series_rows - 30)
        for k in range(at, at + rng.randrange(4, 10)):
            part[k] |= {"min_value": 990.0, "max_value": 1010.0, "mean_value": 1000.0}
        part[3] |= {"min_value": -1.0}
        rows += part + [rng.choice(part) for _ in range(5)] + [rng.choice(part) | {"max_value": 1200.0} for _ in range(3)]
    rng.shuffle(rows)
    return rows


def test_sharded_equals_whole(observations):
    rng = random.Random(5)
    rows = []
    for k in range(20):  # twenty random tables, told apart by their band
        rows += [r | {"band": f"band {k}"} for r in random_table(rng, rng.randrange(60, 160))]
    df = observations(rows)
    whole = rows_of(spikes.flagged(df).select("obs_id", "flag"))
    assert len(whole) == len(rows) and sum(f == "stuck" for _, f in whole) > 100 and sum(f == "spike" for _, f in whole) > 100
    for limit in (17, 50):
        assert rows_of(spikes.flagged(df, limit=limit).select("obs_id", "flag")) == whole


def test_stuck_is_told_by_length_alone():
    rng = np.random.default_rng(4)
    for n in range(1, 12):
        for at in (0, 9, 30 - n):  # also at both ends of the series
            v = 1000.0 + rng.normal(0, 10, 30)[:, None] + np.array([-5.0, 5.0, 0.0])
            v[at : at + n] = v[at]
            hard, code, first, length = np.zeros(30, bool), spikes._triples(v), np.array([0]), np.array([30])
            r = spikes._Readings(first, length, np.arange(30), v, hard, code, *spikes._fit(v, hard, np.zeros(30, int), 1, code))
            flag, _ = r.flags(hard, spikes.START[None], spikes.END[None])
            assert flag.tolist() == [2 if n >= 6 and at <= k < at + n else 0 for k in range(30)]


def test_the_model_decides():
    """Without the messages of the readings around and with even states nothing of spikes and stuck values is left."""
    rng = random.Random(7)
    rows = series(60, rng)
    for k in range(30, 37):
        rows[k] |= {"min_value": 990.0, "max_value": 1010.0, "mean_value": 1000.0}
    rows[9] |= {"max_value": 1500.0}
    v = np.array([[r[c] for c in spikes.STATS] for r in rows])
    hard, code = spikes._hard(v), spikes._triples(v)
    r = spikes._Readings(np.array([0]), np.array([60]), np.arange(60), v, hard, code, *spikes._fit(v, hard, np.zeros(60, int), 1, code))
    on, _ = r.flags(hard, spikes.START[None], spikes.END[None])

    def off(e, *_):
        even = np.ones_like(e)
        return even / even.sum(axis=1, keepdims=True) * (np.arange(spikes.STATES) < spikes.STUCK), even * (np.arange(spikes.STATES) == 0)

    without, _ = r.flags(hard, spikes.START[None], spikes.END[None], model=off)
    assert np.flatnonzero(on == 2).tolist() == list(range(30, 37)) and on[9] == 1 and not without.any()


def test_far_for_others_is_ordinary_for_a_wide_series(observations):
    """A row twice as far as all others may still be ordinary; more spikes than a tenth of the series are still spikes."""
    rng = random.Random(8)
    rows = series(40, rng)
    rows[5] |= {k: rows[5][k] * 1.09 for k in ("min_value", "max_value", "mean_value")}
    assert set(flags(observations(rows)).values()) == {"ok"}
    for k in range(0, 40, 8):
        rows[k] |= {"max_value": 1900.0 + k}
    assert sorted(k - 1 for k, f in flags(observations(rows)).items() if f == "spike") == list(range(0, 40, 8))


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e = rng.uniform(0.1, 1, (7, spikes.STATES))
    p, context = spikes._forward_backward(e, np.array([0, 3]), np.array([3, 4]), np.tile(spikes.START, (2, 1)), np.tile(spikes.END, (2, 1)))
    for lo, hi in ((0, 3), (3, 7)):
        total = np.zeros((hi - lo, spikes.STATES))
        for path in np.ndindex(*(spikes.STATES,) * (hi - lo)):
            w = spikes.STEP[spikes.NORMAL, path[0]] * e[lo, path[0]] * spikes.END[path[-1]]
            for k in range(1, hi - lo):
                w *= spikes.STEP[path[k - 1], path[k]] * e[lo + k, path[k]]
            for k, s in enumerate(path):
                total[k, s] += w
        assert np.allclose(p[lo:hi], total / total.sum(axis=1, keepdims=True))
    assert np.allclose(p, context * e / (context * e).sum(axis=1, keepdims=True))


def test_empty_and_tiny(observations):
    assert spikes.untrustworthy(observations([])).collect() == []
    assert flags(observations([{"min_value": 1.0, "max_value": 1.0, "mean_value": 1.0}, {"min_value": None, "max_value": 3.0, "mean_value": None}])) == {1: "ok", 2: "ok"}
