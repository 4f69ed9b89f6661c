"""Every report against its SQL over the test tables."""

from pathlib import Path

import pytest

from checks.compare import connect, differences
from checks.oracles import ORACLES
from checks.queries import queries

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are missing")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_report_has_sql():
    assert set(queries()) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(queries()))
def test_report_equals_sql(spark, connection, name):
    assert differences(spark, connection, name, SF_DIR) is None
