import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from voxstars.session import local_session  # noqa: E402
from voxstars.sources.staging import stage  # noqa: E402
from voxstars.sources.tables import reviews_from_tables  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def reviews(spark):
    return stage(reviews_from_tables(spark, FOLDER))


RAW = "Id long, ProductId string, UserId string, HelpfulnessNumerator long, HelpfulnessDenominator long, Score string, Time long, Summary string, Text string"  # noqa: E501


@pytest.fixture
def make(spark):
    """Small review tables from dicts; what a dict leaves out has a plain value."""

    def build(*rows):
        base = dict(
            ProductId="P1", UserId="U1", HelpfulnessNumerator=1, HelpfulnessDenominator=2, Score="5",
            Time=1349049600, Summary="good", Text="nice tea",
        )
        names = [f.split()[0] for f in RAW.split(", ")]
        full = [{"Id": i + 1, **base, **row} for i, row in enumerate(rows)]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], RAW)

    return build
