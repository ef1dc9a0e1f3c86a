"""Queries with a SQL twin against it, on the given tables."""

import os

import pytest

from casework.llm.oracles import ORACLES
from casework.llm.queries import QUERIES
from tests.test_oracles import SF_DIR, TYPES, canonical, duck  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    kinds = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    assert kinds == dict(df.dtypes)
    order = [[d[0] for d in result.description].index(c) for c in columns]
    expected = canonical([[r[i] for i in order] for r in result.fetchall()])
    assert canonical(df.select(*columns).collect()) == expected
