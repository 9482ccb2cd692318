from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("LODESTRATA_DRIVER_MEMORY", "4g")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lodestrata.session import session

    own = session("tests", "4")
    own.conf.set("spark.sql.shuffle.partitions", "4")
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()
