import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for p in (ROOT, ROOT / "tests"):
    if str(p) not in sys.path:
        sys.path.insert(0, str(p))


@pytest.fixture(scope="session")
def spark():
    from tessellum.session import build_session

    session = build_session("local[4]", 4, "tests", "4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
