from __future__ import annotations

import pytest

from quorum import catalog
from tests import oracle


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_has_the_rows_of_its_sql(spark, sf, name):
    found = catalog.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    assert oracle.normal(tuple(r) for r in found.select(*columns).collect()) == oracle.rows(catalog.ORACLE_SQL[name], columns, sf)


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.ORACLE_SQL) == set(catalog.QUERIES)
    assert catalog.FLAGSHIP in entry.queries()
