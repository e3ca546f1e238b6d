import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from herdsignal.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, partitions=4)
    yield session
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)
