import pytest

from mailweir.llm.queries import QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    df.collect()
