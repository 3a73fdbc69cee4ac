import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fairfold.session import local_session  # noqa: E402

# started before the test modules are imported: column expressions need a running session
SESSION = local_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
