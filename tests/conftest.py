import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weekgrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


def day(text):
    return dt.date.fromisoformat(text) if text else None


T0 = day("2024-01-29")  # a Monday


def plus(n):
    return T0 + dt.timedelta(days=n)


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
