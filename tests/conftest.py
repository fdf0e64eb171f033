from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tableflow.session import build_session, scratch_path  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[*]", shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture
def scratch(spark, request):
    return lambda name="t": scratch_path(spark, f"test-{request.node.name}-{name}")


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
