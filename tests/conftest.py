import os
import sys
from datetime import datetime, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import cloudpickle  # noqa: E402

import storyweave  # noqa: E402
from storyweave.session import build_session  # noqa: E402

cloudpickle.register_pickle_by_value(storyweave)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "storyweave-tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def utc(*parts) -> datetime:
    """A naive UTC instant, as Spark returns it."""
    return datetime(*parts)


def epoch(value: datetime) -> float:
    return value.replace(tzinfo=timezone.utc).timestamp()
