from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from kpiforge.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="kpiforge-tests")
    yield s
    s.stop()
