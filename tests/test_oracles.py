"""Every named query against its SQL twin on the same files."""

import decimal
import json
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from casework.plans.library import QUERIES
from casework.plans.oracles import ORACLES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def canonical(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: json.dumps(r, default=str))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = duck.execute(oracle_sql()[name])
    kinds = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    assert kinds == dict(df.dtypes)
    order = [[d[0] for d in result.description].index(c) for c in columns]
    expected = canonical([[r[i] for i in order] for r in result.fetchall()])
    found = canonical(df.select(*columns).collect())
    assert len(found) > 0
    assert found == expected


def test_entry_has_rows(spark):
    assert not entry(spark).isEmpty()
