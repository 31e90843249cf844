import random

import numpy as np
from conftest import rows_of, utc

from gridloom.operators import compaction as c

SCHEMA = "row_id bigint, chunk_path string, time timestamp, pixels array<int>, mask array<boolean>, band string, digest int"
SAME = [
    "tiles/x0012_y-0345/2024-03/swir_1-54a85e5.arrow",
    "./tiles//x12_y-345/2024-3/swir_1-0a85e51.arrow.tmp",
    "D:\\wh\\tiles\\X0012_Y-0345\\2024-03\\SWIR_1-54a85e5.arrow",
    "wh/pix/tile_id=x000012_y-00345/band=swir_1/year_month=2024-03/part-00aa11b.arrow",
    "file:///srv/wh/tiles/x0012_y-0345/2024-03/SWIR_1_54a85e5.arrow",
    "wh/pix/data/x0012_y-0345/2024-03/swir_1.beb8e8e.arrow",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, p, utc(t), px, m, "clash", 1) for i, p, t, px, m in rows], SCHEMA)


def test_all_layouts_name_one_chunk(spark):
    df = frame(spark, [(k, p, "2024-03-01", [1, 2], [True, False]) for k, p in enumerate(SAME)])
    merged = c.merged_runs(df)
    assert {tuple(r) for r in merged.select(*c.KEY).collect()} == {("x0012_y-0345", "2024-03", "swir_1")}
    assert rows_of(c.surplus_records(df)) == [(1,), (2,), (3,), (4,), (5,)]


def test_near_copies_stay(spark):
    p = SAME[0]
    df = frame(
        spark,
        [
            (1, p, "2024-03-01", [1, 2], [True, True]), (2, p, "2024-03-01", [1, 3], [True, True]), (3, p, "2024-03-01", [1, 2], [True, False]), (4, p, "2024-03-02", [1, 2], [True, True]),
            (5, p.replace("2024-03", "2024-04"), "2024-03-01", [1, 2], [True, True]), (6, p, None, None, None), (7, p, None, None, None), (8, None, "2024-03-01", [1, 2], [True, True]),
            (9, "odd", "2024-03-01", [1, 2], [True, True]), (10, "strange", "2024-03-01", [1, 2], [True, True]), (11, "odd", "2024-03-01", [1, 2], [True, True]), (1, p, "2024-03-01", [1, 2], [True, True]),
        ],
    )
    assert rows_of(c.surplus_records(df)) == [(1,), (11,), (7,)]


def test_nothing_lost_and_files_roll(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, SAME[k % len(SAME)].replace("2024-03", f"2024-0{1 + k % 9}"), f"2024-0{1 + k % 9}-1{rng.randrange(9)}", [rng.randrange(3)] * 40, [True] * 40) for k in range(20_000)]
    rows += [(20_000 + k, SAME[0], "2024-03-01", [k], None) for k in range(20_000)]
    df = frame(spark, rows)
    surplus = {r[0] for r in c.surplus_records(df).collect()}
    kept = {r["row_id"] for r in c.consolidated(df, 3).collect()}
    assert len(kept) + len(surplus) == len(rows) and not surplus & kept
    folder, target = str(tmp_path / "out"), 300_000
    old = spark.createDataFrame([(SAME[1], [0.0, 1.0], 5.0, "p", 10.0), (SAME[2], None, 7.0, "p", 3.0)], "chunk_path string, bounds array<double>, cloud_cover double, product_id string, resolution double")
    meta = c.write_consolidated(df, folder, target, 3, old).collect()
    assert sum(r["num_observations"] for r in meta) == len(kept)
    assert {(tuple(r["bounds"]), r["cloud_cover"], r["product_id"], r["resolution"]) for r in meta if r["year_month"] == "2024-03"} == {((0.0, 1.0), 6.0, "p", 3.0)}
    files = {r["out_file"]: r for r in spark.read.parquet(f"{folder}/files").collect()}
    sizes = {f: (tmp_path / "out" / f).stat().st_size for f in files}
    assert all(files[f]["file_bytes"] == n for f, n in sizes.items()) and not list((tmp_path / "out/data").glob("*.tmp"))
    assert 3 < len(sizes) < 20 and max(sizes.values()) < 3 * target and sorted(sizes.values())[-4] >= target
    back = c.read_consolidated(spark, folder)
    assert {r[0] for r in back.select("row_id").collect()} == kept and back.count() == len(kept)
    # Within a file records are in key order, and the ranges of two files do not overlap.
    spans = []
    for f in files:
        order = [(r["tile_id"], r["year_month"], r["band"], r["time"]) for r in back.where(f"out_file = '{f}'").collect()]
        assert order == sorted(order)
        spans.append((order[0], order[-1]))
    spans.sort()
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_merge_of_runs_keeps_every_record():
    rng = np.random.default_rng(2)
    run = np.repeat(np.arange(9), rng.integers(1, 40, 9))
    ranks = rng.integers(0, 4, (len(run), 3))
    for k in range(8):  # the last run is left out of order
        own = np.flatnonzero(run == k)
        ranks[own] = ranks[own][np.lexsort(ranks[own].T[::-1])]
    order = c.merge_order(ranks, run)
    assert sorted(order.tolist()) == list(range(len(run))) and ranks[order].tolist() == sorted(ranks.tolist())


def test_crowds_of_copies(spark):
    """A record with very many copies: one of each run reaches its range, and all are told apart."""
    rng = random.Random(8)
    rows = [(k, rng.choice(SAME), "2024-03-01", [1, 2], [True]) for k in range(3000)]
    rows += [(10_000 + k, SAME[0], f"2024-03-0{1 + k % 3}", [k % 5], None) for k in range(60)] + [(0, SAME[0], "2024-03-01", [1, 2], [True])]
    df = frame(spark, rows).repartition(7)
    merged = c.merged_runs(df, 4)
    assert merged.count() == len(rows) and merged.where("surplus").count() == 3000 + 60 - 15
    assert {r[0] for r in merged.where("NOT surplus").select("row_id").collect()} >= {0, 10_000}


def test_contents_with_holes_are_told_apart(spark):
    kinds = [(None, None), ([], None), (None, []), ([None], [True]), ([None, 1], [True]), ([1, None], [True]), ([1], [True]), ([1], [None, True]), ([1], [True, None]), ([1], [False, True])]
    df = frame(spark, [(k, SAME[0], "2024-03-01", *kinds[k % len(kinds)]) for k in range(2 * len(kinds))])
    assert rows_of(c.surplus_records(df)) == sorted([(k,) for k in range(len(kinds), 2 * len(kinds))], key=repr)


def test_empty_and_catalogue(spark):
    empty = frame(spark, [])
    assert c.surplus_records(empty).collect() == []
    meta = spark.createDataFrame([("a", 1), ("b", 5), ("c", 1), ("c", 1), ("e", None)], "chunk_path string, num_observations bigint")
    held = frame(spark, [(1, "a", "2024-01-01", [1], [True]), (2, "b", "2024-01-01", [1], [True]), (3, "c", "2024-01-01", [1], [True]), (4, "d", "2024-01-01", [1], [True]), (5, None, None, None, None)])
    state = {r["chunk_path"]: r["state"] for r in c.catalogue_drift(meta, held).collect()}
    assert state == {"a": "right", "b": "stale", "c": "repeated", "d": "unlisted", "e": "empty"}
