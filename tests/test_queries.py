"""Every query with SQL against that SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from loadscape.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(cols, data):
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 5) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(clean(r[c]) for c in cols) for r in data), key=lambda r: tuple(map(str, r)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    expected = [dict(zip(cols, r)) for r in found.fetchall()]
    assert rows(sorted(cols), [r.asDict() for r in df.collect()]) == rows(sorted(cols), expected)
