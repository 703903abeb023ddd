from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from loanweave.session import local_session

    # The fixtures are tiny: few tasks, and no compiled stages.
    session = local_session("8", shuffle_partitions=2, memory="8g", extra={
        "spark.default.parallelism": "1", "spark.sql.codegen.wholeStage": "false"})
    yield session
    session.stop()
