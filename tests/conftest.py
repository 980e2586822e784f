import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cambium.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus="4", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def rings(spark):
    """Build ring widths from {(site, tree): (first_year, [width, ...])}; None skips a year."""

    def build(series):
        rows = [
            (site, tree, first + i, float(w))
            for (site, tree), (first, widths) in series.items()
            for i, w in enumerate(widths)
            if w is not None
        ]
        return spark.createDataFrame(rows, "rwl string, tree string, year int, width double")

    return build
