"""Every query on the small tables, against its SQL where there is some."""

import os

import pytest
from test_entry import DATA, duck  # noqa: F401 - the fixture

from loomlog.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):  # noqa: F811
    df = queries.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    sql = queries.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=key) == sorted(want, key=key)
