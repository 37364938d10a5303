import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from codestrata.operators import skew  # noqa: E402
from codestrata.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "codestrata-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["hot groups", "no hot group"])
def hotness(request, monkeypatch, spark):
    """Run once with every group treated as hot, once with the plain plans."""
    monkeypatch.setattr(skew, "HOT_ROWS", 0 if request.param == "hot groups" else 10**9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


@pytest.fixture
def rows():
    """Collect as a sorted list of tuples, nulls first."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda t: [(v is not None, str(v)) for v in t])

    return collect
