import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from millrace.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, shared=f"file://{tmp_path_factory.mktemp('shared')}")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
