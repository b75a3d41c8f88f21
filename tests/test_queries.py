import pytest

from quillspan import catalog
from tests.oracle import SMALL, assert_same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(spark, catalog.QUERIES[name], catalog.SQL[name])


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["query_id", "place", "doc_id", "score", "fused"]
