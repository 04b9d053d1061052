"""Every registered query against the SQL that states the same result, on the smallest tables."""

import pytest
from check import compare
from conftest import SF

from sphereframe.plans.catalog import all_queries

QUERIES = all_queries()


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_twin(spark, duck, name):
    q = QUERIES[name]
    assert compare(q.run(spark, SF), duck, q.oracle()).startswith("ok")


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["leadtime", "skill", "value"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
