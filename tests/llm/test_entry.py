"""The queries of the subpackage and their SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import same  # noqa: E402

from veridrift.llm import queries  # noqa: E402


def test_names():
    import corpus_pipeline

    import __spark_entry__ as entry

    numbers = {int(n[2:].split("_")[0]) for n in queries.queries()}
    assert numbers == set(range(1, 14))
    assert {*queries.queries(), "pipeline"} <= set(entry.queries())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    query = lambda s, d: queries.queries()[name](s, d)
    same(spark, query, queries.oracle_sql()[name])
