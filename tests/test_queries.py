import pytest
from conftest import SF
from mossgraph import catalog
from oracle import both


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    mine, theirs = both(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
