from __future__ import annotations

import sys
from pathlib import Path

import pytest
from hypothesis import settings

# a slow machine's first call says nothing about the code
settings.register_profile("here", deadline=None)
settings.load_profile("here")

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import session

    s = session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("sample tables are missing")
    return DATA
