"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata/sf0.01"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from massloom.session import session

    shared = str(tmp_path_factory.mktemp("shared"))
    s = session("tests", "local[4]", **{"spark_sql_shuffle_partitions": "4", "spark_ui_enabled": "false", "spark_checkpoint_dir": shared, "spark_sql_warehouse_dir": shared + "/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data_dir():
    if not DATA.exists():
        pytest.skip("no test data")
    return str(DATA)
