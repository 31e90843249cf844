from conftest import rows_of, utc

from gridloom.operators import late_events as late


def ids(df):
    return sorted(r[0] for r in df.select("obs_id").collect())


def test_bounds_are_exclusive_and_inclusive(observations):
    df = observations(
        [
            {"time": "2024-01-10", "ingestion_time": "2024-02-04", "pixels": [1]},  # on the bound: on time
            {"time": "2024-01-10", "ingestion_time": "2024-02-04 00:00:00.000001", "pixels": [2]},  # just late
            {"time": "2024-01-10", "ingestion_time": "2024-03-17", "pixels": [3]},  # on the cut-off: accepted
            {"time": "2024-01-10", "ingestion_time": "2024-03-17 00:00:00.000001", "pixels": [4]},  # diverted
            {"time": "2024-01-31 23:59:59", "ingestion_time": "2024-01-01", "pixels": [5]},  # before its own time
            {"time": "2024-01-10", "ingestion_time": None, "pixels": [6]},
            {"time": None, "ingestion_time": "2024-02-10", "pixels": [7]},
        ]
    )
    assert ids(late.late_accepted(df)) == [2, 3]
    assert ids(late.diverted(df)) == [4]


def test_only_the_first_delivery_counts(observations):
    df = observations(
        [
            {"ingestion_time": "2024-02-10"},
            {"ingestion_time": "2024-02-10"},  # a tie: the smaller obs_id stands
            {"ingestion_time": "2024-02-09", "tile_id": "X1_Y1"},  # the same tile, earlier
            {"ingestion_time": "2024-02-12", "pixels": [9, 9]},  # another reading
            {"ingestion_time": "2024-01-12", "band": None},
            {"ingestion_time": "2024-02-12", "band": None},  # NULL is a value: not the first
            {"ingestion_time": "2024-02-12", "pixels": None},
        ]
    )
    assert ids(late.late_accepted(df)) == [3, 4, 7]


def test_empty(observations):
    df = observations([])
    assert late.late_accepted(df).collect() == []
    assert late.period_state(df).collect() == []
    assert late.corrected_aggregates(df, ["tile_id"]).collect() == []


def test_a_period_closes_with_its_last_source(observations):
    df = observations(
        [
            {"satellite_id": "a", "time": "2024-01-10", "ingestion_time": "2024-01-11"},
            {"satellite_id": "b", "time": "2024-01-10", "ingestion_time": "2024-01-12"},
            {"satellite_id": "a", "time": "2024-02-05", "ingestion_time": "2024-02-05 06:00"},
            {"satellite_id": "b", "time": "2024-02-06", "ingestion_time": "2024-02-07 12:00"},
            {"satellite_id": "a", "time": "2024-03-06", "ingestion_time": "2024-03-20"},
            {"satellite_id": "b", "time": "2024-03-06", "ingestion_time": "2024-03-21"},
        ]
    )
    plain = lambda t: t.replace(tzinfo=None)
    got = {str(r["period_start"])[:7]: r for r in late.period_state(df).collect()}
    january = got["2024-01"]
    assert plain(january["complete_at"]) == plain(utc("2024-02-07 12:00")) and plain(january["closed_at"]) == plain(utc("2024-03-21"))
    assert (january["sources"], january["idle_sources"]) == (2, 0)
    february = got["2024-02"]  # nobody is heard of after the cut-off: both are timed out; complete by time-out, too
    assert february["idle_sources"] == 2 and plain(february["complete_at"]) == plain(utc("2024-03-11"))
    assert plain(february["closed_at"]) == plain(utc("2024-04-22"))


def test_another_source_keeps_a_period_open(observations):
    """Tables that differ in the clock of another source only: other closing, other diversions, the same late rows."""
    own = [
        {"time": "2024-01-10", "ingestion_time": "2024-02-20", "pixels": [1]},
        {"time": "2024-01-10", "ingestion_time": "2024-03-18", "pixels": [2]},
        {"time": "2024-01-10", "ingestion_time": "2024-03-19", "pixels": [3]},
        {"time": "2024-01-10", "ingestion_time": "2024-04-19", "pixels": [4]},
    ]

    def states(clock):
        df = observations([*own, {"satellite_id": "other", "time": "2024-01-11", "ingestion_time": "2024-01-12"}, *({"satellite_id": "other", "time": "2024-01-11", "ingestion_time": t, "pixels": [k]} for k, t in enumerate(clock))])
        closed = late.period_state(df).first()["closed_at"].replace(tzinfo=None)
        return closed, ids(late.late_accepted(df)), {r["obs_id"]: r["status"] for r in late.diverted(df).collect() if r["obs_id"] < 5}

    prompt, slow, idle = states(["2024-03-17 12:00"]), states(["2024-03-18 12:00"]), states([])
    assert prompt == (utc("2024-03-18").replace(tzinfo=None), [1], {2: "diverted", 3: "diverted", 4: "diverted"})
    assert slow == (utc("2024-03-18 12:00").replace(tzinfo=None), [1], {2: "overdue", 3: "diverted", 4: "diverted"})
    assert idle == (utc("2024-03-24").replace(tzinfo=None), [1], {2: "overdue", 3: "overdue", 4: "diverted"})


def test_pixels_are_told_apart(observations):
    kinds = [None, [], [None], [None, None], [0], [0, None], [None, 0], [1, 2], [2, 1]]
    df = observations([{"pixels": p, "ingestion_time": "2024-02-10"} for p in [*kinds, *kinds]])
    assert ids(late.late_accepted(df)) == list(range(1, len(kinds) + 1))


def test_corrections_follow_each_late_row(observations):
    df = observations(
        [
            {"pixels": [1, 3], "ingestion_time": "2024-01-11"},
            {"pixels": [10], "ingestion_time": "2024-02-10"},
            {"pixels": [0], "ingestion_time": "2024-02-10", "time": "2024-01-12"},
            {"pixels": [7], "ingestion_time": "2024-02-20", "time": "2024-01-13"},
            {"pixels": [99], "ingestion_time": "2025-01-01", "time": "2024-01-14"},
            {"pixels": None, "ingestion_time": "2024-02-21", "time": "2024-01-15"},
        ]
    )
    out = late.corrected_aggregates(df, ["tile_id", "band"]).orderBy("version").collect()
    assert [(r["version"], r["obs_id"], r["n_readings"], r["n_pixels"], r["pixel_sum"], r["pixel_min"], r["pixel_max"]) for r in out] == [
        (0, None, 1, 2, 4, 1, 3), (1, 2, 2, 3, 14, 1, 10), (2, 3, 3, 4, 14, 0, 10), (3, 4, 4, 5, 21, 0, 10), (4, 6, 5, 5, 21, 0, 10),
    ]


def test_repeated_rows_are_one_reading(observations):
    df = observations([{"obs_id": 5, "ingestion_time": "2024-02-10"}, {"obs_id": 5, "ingestion_time": "2024-02-10"}])
    assert rows_of(late.late_accepted(df)) == [(5,)]
