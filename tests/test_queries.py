"""Every core query that has SQL against it on the smallest tables."""

import math
import os

import pytest

from verdictlake.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cursor.fetchall())
