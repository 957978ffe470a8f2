import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from check_queries import session  # noqa: E402
from hashloom.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = configure(session(4))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture
def frame(spark):
    def build(rows, schema="hash string, value string"):
        return spark.createDataFrame(rows, schema)

    return build


def rows_of(frame):
    return sorted((tuple(row) for row in frame.collect()), key=str)


def hashes_of(frame):
    return sorted(row["hash"] for row in frame.collect())
