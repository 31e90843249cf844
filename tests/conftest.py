import os
import sys
from datetime import UTC, datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridloom.session import local_session, ship_package  # noqa: E402

OBS = (
    "obs_id bigint, tile_id string, band string, year_month string, time timestamp, pixels array<int>, mask array<boolean>, product_id string, satellite_id string, "
    "resolution float, bounds_wkb binary, num_pixels int, min_value float, max_value float, mean_value float, cloud_cover float, crs string, transform string, source_file string, ingestion_time timestamp"
)
DEFAULTS = {"tile_id": "x0001_y0001", "band": "red", "pixels": [1, 2], "mask": [True, True], "product_id": "p", "satellite_id": "s", "time": "2024-01-10", "ingestion_time": "2024-01-11"}


def utc(text):
    return None if text is None else datetime.fromisoformat(text).replace(tzinfo=UTC)


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def observations(spark):
    """Rows given as dicts of what matters; an extra column whose name clashes with the operators' own is added."""
    names = [c.strip().split()[0] for c in OBS.split(", ")]

    def make(rows, extra=True):
        out = []
        for k, r in enumerate(rows):
            d = {"obs_id": k + 1} | DEFAULTS | r
            out.append(tuple(utc(d.get(c)) if c in ("time", "ingestion_time") else d.get(c) for c in names) + ((k,) * 3 if extra else ()))
        return spark.createDataFrame(out, OBS + (", slot int, status int, shard int" if extra else ""))

    return make


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
