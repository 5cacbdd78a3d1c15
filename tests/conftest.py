import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairlab.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[*]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g",
        spark__default__parallelism="8",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def pairs_of(spark):
    def make(rows, label=False):
        return spark.createDataFrame(rows, "left_id string, right_id string" + (", label int" if label else ""))

    return make
