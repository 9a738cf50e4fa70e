import duckdb
import pytest

import __spark_entry__ as entry
from framewright import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5)
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    res = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=str)
    assert sorted(names) == cols and got == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
