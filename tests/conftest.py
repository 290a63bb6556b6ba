import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewright.session import local_session


# Column expressions at module level need a session while tests are collected.
SESSION = local_session(8, "tests", memory="6g")
SESSION.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def make(spark):
    """Table of text columns in arrival order: make({"a": [...]})."""

    def build(columns: dict[str, list]):
        names = list(columns)
        rows = [(i, *cells) for i, cells in enumerate(zip(*columns.values()))]
        return spark.createDataFrame(rows, "seq bigint, " + ", ".join(f"`{n}` string" for n in names))

    return build
