"""Every registered query against its DuckDB equivalent on the smallest test data, or that it gives rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lodestone.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "timestamp": "TIMESTAMP", "date": "DATE"}
#: Queries that find nothing in the smallest test data, and say the same as their SQL there.
EMPTY = {"d08_regex_rules", "j12_without_errors", "j15_rules_by_content", "j19_intent_groups", "i07_pattern_connections", "m13_pruned_chains"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    assert not isinstance(v, decimal.Decimal)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    assert rows or name in EMPTY
    if name not in registry.ORACLE:
        return
    got = duck.execute(registry.ORACLE[name])
    found = {d[0]: str(d[1]) for d in got.description}
    assert sorted(found) == names
    assert {c: TYPES[t] for c, t in df.dtypes} == found
    at = [list(found).index(c) for c in names]
    assert ordered(rows) == ordered([tuple(plain(r[i]) for i in at) for r in got.fetchall()])
