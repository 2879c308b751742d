from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from run_checks import connect, session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session("4")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark


@pytest.fixture(scope="session")
def duck():
    return connect(SMALL)


@pytest.fixture
def lines(spark, tmp_path):
    """Write text to a file and return its path."""

    def write(text: str, name: str = "log.txt") -> str:
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write
