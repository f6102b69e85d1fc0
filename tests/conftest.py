from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from blocktrace.plans.layout import TASK_ROWS_CONF  # noqa: E402
from blocktrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(params=["whole", "split"])
def layout(request, spark):
    """Run a test with keys kept whole and with hot keys cut into pieces."""
    if request.param == "split":
        spark.conf.set(TASK_ROWS_CONF, "8")
    yield request.param
    spark.conf.unset(TASK_ROWS_CONF)


@pytest.fixture()
def make_trace(spark):
    def build(rows, trace_id="demo"):
        """Rows of (timestamp, lba) or (timestamp, lba, operation), in trace order."""
        full = [(r[0], r[1], 1, r[2] if len(r) > 2 else "W", i, trace_id) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            full, "timestamp long, lba long, size int, operation string, seq long, trace_id string")
    return build
