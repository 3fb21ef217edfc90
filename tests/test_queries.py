"""Every registered query gives the rows of its SQL."""

import pytest

from foliate.plans import names_queries, registry, state_queries, text_queries, tree_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, same, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        same(df, registry.ORACLES[name])
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert {r.action for r in __spark_entry__.entry(spark).collect()} == {"CREATE", "UPDATE", "MOVE", "UNCHANGED"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
