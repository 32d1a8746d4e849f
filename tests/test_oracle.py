"""Every registered query of the engine against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from concord.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert not {"CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInArrow"} & set(df._jdf.queryExecution().executedPlan().toString().replace("(", " ").split())
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    got = sorted(tuple(plain(r[i]) for i in order) for r in df.collect())
    expected = duck.sql(catalogue.ORACLE_SQL[name])
    columns = expected.columns
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert sorted(columns) == sorted(df.columns)
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in expected.fetchall())
