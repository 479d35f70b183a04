import pytest
from oracle import same

from veridrift.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name])


#: Queries that SQL can't express; their own tests hold them against NumPy.
NO_SQL = {"paired_bootstrap", "learned_selection"}


def test_every_other_query_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == NO_SQL


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
