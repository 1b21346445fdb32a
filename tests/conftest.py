from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from rasterloom.session import local_session

    s = local_session(4, **{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "4g"})
    yield s
    s.stop()
