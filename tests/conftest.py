import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from carryover.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g", "spark.log.level": "ERROR"})
    yield s
    s.stop()


def rows(df):
    """Rows as a sorted list of tuples in column-name order."""
    cols = sorted(df.columns)
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)
