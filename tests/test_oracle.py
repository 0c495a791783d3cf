"""Every core query with SQL gives the rows of that SQL."""

import pytest

from stackwave.plans import catalog_queries, pipeline_queries, problems, signal_queries
from tests.oracle import connect, form

QUERIES = {k: (m.QUERIES[k], m.SQL[k]) for m in (problems, catalog_queries, signal_queries, pipeline_queries) for k in m.SQL}


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, data, name):
    query, sql = QUERIES[name]
    got, want = form(query(spark, data).toPandas()), form(connect(data).execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
