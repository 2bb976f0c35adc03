import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_bars(spark):
    """Numbered bars from lists of (open, high, low, close, volume) per asset."""
    def build(series: dict, hours: int = 4):
        start = dt.datetime(2024, 1, 1)
        rows = [(asset, start + dt.timedelta(hours=hours * i), *map(float, bar), i)
                for asset, bars in series.items() for i, bar in enumerate(bars)]
        return spark.createDataFrame(
            rows, "asset string, ts timestamp_ntz, open double, high double, low double, close double, volume double, pos bigint")
    return build
