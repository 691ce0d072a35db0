import os

import pytest

from logloom import catalog
from tests.oracle import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, name):
    compare(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name])
