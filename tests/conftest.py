import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from tablewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session("8", "tests", {"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture
def rows():
    """Rows of a DataFrame as tuples, sorted for comparison."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
