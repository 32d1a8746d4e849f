"""Registered queries see all of their input."""

import re

from concord.operators import numeric
from concord.plans import catalogue, common

SF = "/root/testdata/sf0.001"


def test_sections_hold_whole_texts(spark):
    rows = common.sql(spark, SF, common.WHOLE_PARAGRAPHS, "documents").withColumnRenamed("text", "made").join(common.table(spark, SF, "documents"), "doc_id").where("doc_id % 5 = 0").collect()
    bare = lambda s: re.sub(r"\s", "", s)
    assert any(len(r.text) > 2100 for r in rows)
    for r in rows:
        assert bare(re.sub(r"(?:^|\n)(?:1\. Intake |2\. Storage |2\.1 Release |3 Review:\n)", "", r.made)) == bare(r.text)


def test_chunks_reach_the_end_of_long_texts(spark):
    long = common.table(spark, SF, "documents").where("doc_id % 5 = 0 and n_chars > 4000").select("doc_id", "n_chars")
    total = catalogue.QUERIES["t5_t7_chunks_whole"](spark, SF).groupBy("doc_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    rows = long.join(total, "doc_id").collect()
    assert rows and all(r.n > 0.9 * r.n_chars for r in rows)


def test_every_statement_is_resolved(spark):
    rows = catalogue.QUERIES["g2_j10_resolve_all"](spark, SF).collect()
    assert len(rows) == common.sql(spark, SF, common.STATEMENTS, "customer", "nation").count()
    assert {r.quote_id % 24 for r in rows} == set(range(24))


def test_numeric_claims_are_found_once(spark):
    df = catalogue.QUERIES["j3_numeric_contradictions"](spark, "/root/testdata/sf0.01")
    assert df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_numeric_claims_search_two_word_patterns_once(spark):
    df = catalogue.QUERIES["x5_x11_numeric_claims"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(p) for p in (numeric.BIGRAM, numeric.ACRONYM_BIGRAM, "Annual cloud spending reached")] == [1, 1, 1]


def test_numeric_anchors_and_claims_of_odd_texts(spark):
    texts = [
        None, "", "APAC\tspending and Cloud\n  costs of the Nordic-Retail markets reached 5.5 bn USD in 2023 (12,000,000 users).", "Glass markets, Cross-border fees and total spending cost the market shares $5 T overall worldwide.",
        "business prices and classes pricess reached 40% of hiring costs, 30 p.p. or 1,000 thousand roles.",
    ]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, id long, text string")
    found = {r.id: r.a for r in df.where("length(text) > 0").select("id", numeric.anchors(df.text).alias("a")).collect()}
    assert found == {
        2: ["apac", "apac spending", "cloud", "cloud cost", "nordic-retail", "nordic-retail market", "usd"], 3: ["cross-border", "cross-border fee", "gla", "gla market", "total spending"],
        4: ["busine", "busine price", "hiring cost", "thousand", "thousand role"],
    }
    rows = {(r.id, r.value, r.unit): (sorted(r.topics), sorted(r.scopes), r.years) for r in numeric.claims(df).collect()}
    assert rows == {
        (2, 5.5e9, "usd"): (["apac", "cloud"], [], [2023]), (2, 1.2e7, "count:user"): (["apac", "cloud"], [], [2023]), (3, 5e12, "usd"): ([], ["overall", "total", "worldwide"], []),
        (4, 40.0, "percent"): ([], [], []), (4, 30.0, "percentage_points"): ([], [], []), (4, 1e6, "count:role"): ([], [], []),
    }
