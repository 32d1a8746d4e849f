"""The hybrid ranking by bounds, against its SQL on odd tables, and what it shuffles."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from concord.operators import retrieval
from concord.plans import retrieval_queries as queries


def write(folder, n, vector, text):
    duckdb.sql(f"COPY (SELECT i AS doc_id, t AS text FROM (SELECT unnest({list(range(n))}) AS i, unnest({[text(i) for i in range(n)]}) AS t)) TO '{folder}/documents.parquet'")
    duckdb.sql(f"COPY (SELECT i AS vec_id, e::FLOAT[] AS embedding FROM (SELECT unnest({list(range(n))}) AS i, unnest({[vector(i) for i in range(n)]}::FLOAT[][]) AS e)) TO '{folder}/embeddings.parquet'")
    return str(folder)


def compared(spark, folder, name="r5_r6_hybrid"):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    expected = c.sql(queries.ORACLE_SQL[name]).fetchall()
    got = [tuple(r) for r in queries.QUERIES[name](spark, folder).collect()]
    key = lambda rows: sorted((r[0], r[1], r[2], round(r[3], 6), round(r[4], 6)) for r in rows)
    return key(got), key(expected)


def words(rng, n, of=400):
    return " ".join(f"w{int(of * rng.random() ** 3)}" for _ in range(n))


@pytest.mark.parametrize("kind", ["spread", "copies", "equal", "short", "few", "common", "long"])
def test_same_rows(spark, tmp_path, kind):
    rng = random.Random(7)
    n = 4 if kind == "few" else 260
    width = 70 if kind == "long" else 1 if kind == "short" else 8
    few = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(3)]
    made = {"copies": lambda i: few[i % 3], "equal": lambda i: few[0]}
    texts = {"common": lambda i: "every text has these words", "copies": lambda i: ["", "alpha beta beta", "alpha gamma"][i % 3]}
    folder = write(tmp_path, n, made.get(kind, lambda i: [rng.gauss(0, 1) for _ in range(width)]), texts.get(kind, lambda i: words(rng, 5 + i % 30) + f" own{i}"))
    got, expected = compared(spark, folder)
    assert got == expected and got


def test_batches(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    folder = write(tmp_path, 300, lambda i: [rng.gauss(0, 1) for _ in range(8)], lambda i: words(rng, 20) + f" own{i}")
    monkeypatch.setattr(queries, "BATCH", 2)
    got, expected = compared(spark, folder)
    assert got == expected and len(got) == 30


def shuffled(plan):
    """Rows that each exchange of a plan that has run wrote."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    if name == "InMemoryTableScanExec":
        return shuffled(plan.relation().cachedPlan())
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if name == "ShuffleExchangeExec" else []
    below = plan.children()
    return own + [x for i in range(below.size()) for x in shuffled(below.apply(i))]


def test_few_pairs_are_shuffled(spark, tmp_path):
    """Before, all 2,000 x 40 pairs were."""
    rng = random.Random(5)
    folder = write(tmp_path, 2000, lambda i: [rng.gauss(0, 1) for _ in range(8)], lambda i: words(rng, 12, 3000) + f" own{i}")
    df = queries.QUERIES["r5_r6_hybrid"](spark, folder)
    assert len(df.collect()) == 200
    rows = shuffled(df._jdf.queryExecution().executedPlan())
    assert rows and max(rows) < 40_000


def test_context_of_few_pairs(spark, tmp_path):
    rng = random.Random(6)
    folder = write(tmp_path, 1000, lambda i: [rng.gauss(0, 1) for _ in range(8)], lambda i: words(rng, 12, 3000) + f" own{i}")
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES["r8_context"](spark, folder)
    assert sorted(map(tuple, df.collect())) == sorted(c.sql(queries.ORACLE_SQL["r8_context"]).fetchall())
    assert max(shuffled(df._jdf.queryExecution().executedPlan())) < 15_000


def test_distances_are_the_same_sums(spark):
    rng = random.Random(1)
    rows = [(i, None if i == 3 else [None if i == 4 and k == 2 else rng.gauss(0, 1) for k in range(5 if i == 5 else 6)]) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    pairs = df.select(F.col("id").alias("query_id"), F.col("e").alias("q")).crossJoin(df)
    plain = pairs.select("query_id", "id", retrieval.l2(F.col("q"), F.col("e")).alias("distance"))
    ready = retrieval.padded(df, "e", 6)
    fast = retrieval.apart(ready.crossJoin(ready.select(F.col("id").alias("query_id"), F.col("e").alias("q"), F.col("e_length").alias("q_length"))), 6).select("query_id", "id", "distance")
    assert sorted(map(tuple, fast.collect()), key=lambda r: r[:2]) == sorted(map(tuple, plain.collect()), key=lambda r: r[:2])
