import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from oracle import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = make_session(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
