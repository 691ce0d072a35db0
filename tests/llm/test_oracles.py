import pytest

from logloom.llm import catalog
from tests.oracle import compare


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, name, sf):
    compare(spark, f"/root/testdata/sf{sf}", catalog.QUERIES[name], catalog.ORACLES[name])


def test_each_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, max(numbers) + 1))
