import random
from datetime import date, timedelta

from conftest import rows_of

from gridloom.operators import regular_grid as grid


def test_gap_and_values(observations):
    df = observations(
        [
            {"time": "2023-01-01", "mean_value": 1.0},
            {"time": "2023-01-05 23:59:59", "mean_value": 2.0},  # the same slot, later
            {"time": "2023-01-08", "mean_value": float("nan")},
            {"time": "2023-01-12", "mean_value": None},
            {"time": "2023-01-16", "mean_value": 8.0},
            {"time": None, "mean_value": 5.0},
        ]
    )
    out = grid.regular_grid(df).orderBy("slot").collect()
    assert [(r["slot_start"], r["n_readings"], r["value"], r["missing"], r["carried"], r["interpolated"]) for r in out] == [
        ("2023-01-01", 2, 2.0, False, 2.0, 2.0),
        ("2023-01-06", 0, None, True, 2.0, 4.0),
        ("2023-01-11", 0, None, True, 2.0, 6.0),
        ("2023-01-16", 1, 8.0, False, 8.0, 8.0),
    ]


def test_slots_before_the_origin(observations):
    df = observations([{"time": "2022-12-20", "mean_value": 1.0}, {"time": "2023-01-01", "mean_value": 1.0}])
    assert [r["slot_start"] for r in grid.missing_slots(df).orderBy("slot_start").collect()] == ["2022-12-22", "2022-12-27"]


def test_spellings_of_a_tile_are_one_series(observations):
    df = observations([{"tile_id": " X1_Y-5", "time": "2023-01-01", "mean_value": 1.0}, {"tile_id": "x000001_y-00005", "time": "2023-01-12", "mean_value": 1.0}])
    assert rows_of(grid.missing_slots(df)) == [("x0001_y-0005", "s", "red", "2023-01-06")]


def test_against_brute_force_with_small_shards(observations):
    rng = random.Random(4)
    rows, seen = [], {}
    for k in range(400):
        series, slot = (rng.choice(["x0001_y0001", "x0002_y0001"]), rng.choice(["a", None])), rng.choice(range(-200, 400))
        t = date(2023, 1, 1) + timedelta(days=5 * slot + rng.randrange(5))
        rows.append({"tile_id": series[0], "satellite_id": series[1], "time": f"{t} 0{rng.randrange(9)}:00", "mean_value": float(k)})
        seen.setdefault(series, set()).add(slot)
    want = sorted(((t, s, "red", str(date(2023, 1, 1) + timedelta(days=5 * k))) for (t, s), slots in seen.items() for k in range(min(slots), max(slots)) if k not in slots), key=repr)
    df = observations(rows)
    for shard in (1, 7, 64, 5000):
        got = sorted((tuple(r) for r in grid.regular_grid(df, shard=shard).where("missing").select(*grid.SERIES, "slot_start").collect()), key=repr)
        assert got == want
    whole, cut = (rows_of(grid.regular_grid(df, shard=s)) for s in (5000, 7))
    assert whole == cut


def test_empty_and_single(observations):
    assert grid.missing_slots(observations([])).collect() == []
    assert grid.missing_slots(observations([{"mean_value": 1.0}])).collect() == []
