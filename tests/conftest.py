import os
import sys
import tempfile

import pytest

# Tests fit small models; the registered queries fit the original sizes.
os.environ.setdefault("TARMAC_MODEL_PRESET", "quick")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = os.environ.get("TARMAC_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tarmac.session import build_session
    s = build_session("local[4]", app="tarmac-tests", shuffle_partitions=8,
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tarmac-wh-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
