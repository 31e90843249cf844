"""All queries against their SQL, and the plans that they must have."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, (bool, int, str, type(None))):
        return v
    return float(v) if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.columns and df.count() >= 0


def plan(spark, sf, name):
    return entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(spark, sf, "filter_tile_band_time")
    assert "In(band, [nir,red])" in p and "GreaterThanOrEqual(time," in p and "pixels" not in p.split("ReadSchema", 1)[1]
    p = plan(spark, sf, "scan_observations")
    assert "ReadSchema: struct<obs_id:bigint,tile_id:string,band:string,time:timestamp,pixels:array<int>" in p


# These join one row, or one row per calendar month, to what they read.
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - {"common_bands", "p1_found", "p1_diverted", "p1_periods", "p1_monthly"}))
def test_no_cross_join(spark, sf, name):
    p = plan(spark, sf, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "ndvi_tile_month", "tile_month_rollup", "bandmath_expr", "cloud_masked_mean"])
def test_stays_in_the_jvm(spark, sf, name):
    p = plan(spark, sf, name)
    assert "Python" not in p and "MapInArrow" not in p


@pytest.mark.parametrize(("name", "exchanges"), [("p2_found", 3), ("p3_found", 1), ("p5_found", 1), ("ndvi_tile_month", 2)])
def test_shuffles(spark, sf, name, exchanges):
    assert plan(spark, sf, name).count("Exchange ") <= exchanges


def test_entry(spark):
    assert entry.entry(spark).count() > 0
