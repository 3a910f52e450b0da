import pytest

from kinfold.plans import oracles, registry
from tests.oracle import differs


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    if name not in oracles.SQL:
        assert registry.QUERIES[name](spark, sf_dir).count() >= 0
        return
    assert differs(spark, sf_dir, registry.QUERIES[name], oracles.SQL[name]) == ""
