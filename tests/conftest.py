from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cleansheet.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "cleansheet-tests")
    yield session
    session.stop()


@pytest.fixture()
def csv(tmp_path):
    """Write text or bytes as a CSV file and return its path."""

    def write(content, name="data.csv"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return write
