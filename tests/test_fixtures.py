"""Small literal inputs with results derived by hand from the operators' rules."""

import pytest
from pyspark.sql import functions as F

from concord.functions import responses, text as tx
from concord.operators import chunking, claims, gates, graph, numeric, pairs, reconcile, reports, retrieval, visual, votes
from concord.sources import pages, store
from concord.streaming import ingest


def one(spark, **columns):
    """A one-row table of literals; ``value(df, column)`` evaluates an expression on it."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))


def value(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_running_lines(spark):
    rows = [("d", n, f"Plant Manual Page {n}\nbody {'abcd'[n - 1]}\n\n{n}") for n in range(1, 5)]
    df = spark.createDataFrame(rows, "doc string, page_no int, page_text string")
    assert [tuple(r) for r in chunking.running_lines(df).collect()] == [("d", "Plant Manual Page N", 4)]
    assert {r.page_text for r in chunking.strip_pages(df).collect()} == {f"body {c}\n" for c in "abcd"}
    assert chunking.running_lines(df.where("page_no <= 2")).count() == 0
    assert chunking.strip_pages(df.where("page_no = 1")).first().page_text == "Plant Manual Page 1\nbody a\n"


def test_paragraph_fold(spark):
    p = ["a" * 50, "b" * 60, "c" * 30]
    df = one(spark, t="\n\n".join(p), u="\n\n".join(["a" * 50, "b" * 50]))
    assert value(df, chunking.fold_paragraphs(F.col("t"), 80, 100, "\n")) == [p[1] + "\n" + p[2]]
    assert [len(x) for x in value(df, chunking.fold_paragraphs(F.col("u"), 80, 100, "\n"))] == [101]


def test_chunks(spark):
    long = "\n\n".join(c * 900 for c in "ab")
    df = spark.createDataFrame([(1, "1. One " + "x" * 60 + "\n2. Two " + "y" * 60), (2, long), (3, "1. A " + "x" * 40 + "\n2. B " + "y" * 40 + "\n3. C " + "z" * 40), (4, ""), (5, None)], "doc_id long, text string")
    rows = {}
    for r in chunking.chunk(df).collect():
        rows.setdefault(r.doc_id, {})[r.ord] = r.text
    assert set(rows) == {2, 3} and len(rows[3]) == 3  # two headings are too few, and the fallback finds less than it needs
    assert rows[2][1] == "a" * 200 + " … " + "b" * 900


def test_statements(spark):
    df = one(spark, t="2.1 Access Rules\nAll staff must badge in at the\nmain gate. Visitors may not enter alone! Purpose: this line is meta.\nShort one.")
    assert value(df, tx.statements(F.col("t"))) == ["All staff must badge in at the main gate.", "Visitors may not enter alone!"]
    assert value(df, tx.sentences(F.col("t"))) == ["2.1 Access Rules All staff must badge in at the main gate.", "Visitors may not enter alone!", "Purpose: this line is meta."]


PAIRS = {
    "a": ("Visitors must wear a badge inside the plant.", "Visitors must not wear a badge inside the plant.", "claim", ["one_sided_negation", "modal_flip"], "all_passed", True),
    "b": ("The portal is open to suppliers.", "The portal is closed to suppliers.", "narrative", ["antonym_pair"], "role", False),
    "c": ("Plant output rose to 120 tonnes and 35% of capacity.", "Plant output fell to 90 tonnes and 35% of capacity.", "claim", ["antonym_pair", "numeric_delta"], "all_passed", True),
    "d": ("Regional revenue reached $40 million in 2023.", "Regional revenue reached $52 million in 2023.", "claim", ["numeric_delta"], "claim", True),
    "e": ("Regional revenue reached $40 million in 2023.", "Regional revenue reached $52 million in 2024.", "claim", ["numeric_delta"], "claim", False),
    "f": ("The permit takes effect in March.", "The permit takes effect in June.", "narrative", ["date_conflict"], "role", False),
}


@pytest.mark.parametrize("case", PAIRS)
def test_gates(spark, case):
    a, b, role, signals, stage, keep = PAIRS[case]
    df = spark.createDataFrame([(1, 0, 1, a, b)], "chunk_id long, i int, j int, a string, b string")
    gated = gates.with_gate(df).withColumn("role_a", gates.role(F.col("a"))["role"]).withColumn("role_b", gates.role(F.col("b"))["role"])
    row = gated.first()
    assert (row.role_a, row.role_b) == (role, role) and row.signals == signals
    if case == "c":
        assert (row.numeric.a, row.numeric.b, round(row.numeric.gap, 4)) == (120.0, 35.0, 0.7083)
    if case == "f":
        assert row.date == ["mar", "jun"]
    statements = spark.createDataFrame([(1, 0, a), (1, 1, b)], "chunk_id long, stmt_idx int, statement string")
    out = claims.precision_gate(gated, claims.claim_rows(statements, "chunk_id", "stmt_idx")).first()
    assert (out.stage, out.keep) == (stage, keep)


def test_claims(spark):
    df = spark.createDataFrame([(0, "AWS holds 31%, followed by Azure at 25%."), (1, "About 1,200 cloud-related roles stay unfilled for 3 months."), (2, "Nothing here."), (3, None)], "k long, statement string")
    got = [(r.k, r.value, r.unit, r.entity, r.population) for r in claims.claim_rows(df, "k").orderBy("k", "ord").collect()]
    assert got == [(0, 31.0, "pct", "aws", ""), (0, 25.0, "pct", "azure", ""), (1, 3.0, "months", "", "cloud_roles")]  # no unit follows 1,200


@pytest.mark.parametrize("a, b, universe, relation", [(100, 101, [], "rounding"), (60, 25, [25, 20, 15], "sum_of_parts_a_contains_b"), (336, 42, [800], "share_of_whole"), (94, 29, [], None), (60, 25, [30, 31, 20, 15], None)])
def test_reconciliation(spark, a, b, universe, relation):
    df = spark.createDataFrame([(float(a), float(b), [float(x) for x in universe])], "a double, b double, u array<double>")
    assert value(df, reconcile.reconcile_pair(F.col("a"), F.col("b"), F.col("u"))) == relation


def test_arithmetic(spark):
    df = one(spark, s=100.0, e=121.0, y=2, g=10.0)
    assert value(df, reconcile.growth_matches(F.col("s"), F.col("e"), F.col("y"), F.col("g")))
    assert value(df, reconcile.delta_matches(F.col("s"), F.col("e"), F.lit(21.0)))
    df = spark.createDataFrame([(68.0, [31.0, 25.0, 12.0])], "t double, u array<double>")
    assert value(df, reconcile.parts_of(F.col("t"), F.col("u"))) == [31.0, 25.0, 12.0]


A, B = "Annual cloud spending reached $4.2 billion in 2024 across Nordic Retail.", "Nordic Retail reported cloud spending of $3.1 billion during 2024."


@pytest.mark.parametrize("texts, expected", [([(1, A), (2, B)], [(0.2619, "High", 97)]), ([(1, A), (1, B)], []), ([(1, A), (2, B.replace("2024", "2025"))], []), ([(1, A), (2, "Collectively, " + B)], []), ([(1, A + " Key findings: none at all so far."), (2, B)], [])])
def test_numeric_contradictions(spark, texts, expected):
    df = spark.createDataFrame([(1, i, t) for i, t in texts], "doc_id long, id long, text string")
    got = [(round(r.gap, 4), r.severity, r.confidence) for r in numeric.contradictions(numeric.claims(df)).collect()]
    assert got == expected


def test_scale_letters_need_an_end(spark):
    df = one(spark, t="Sales of 42 tonnes, $5M and 7 trn units and 300 Millers.")
    assert [(v.value, v.unit) for v in value(df, numeric.values(F.col("t")))] == [(5e6, "usd"), (7e12, "scale_only")]


def test_bm25_and_ranks(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma gamma"), (3, "delta")], "id long, text string")
    score = lambda q: {r.id: round(r.score, 6) for r in retrieval.bm25(spark.createDataFrame([(0, q)], "query_id long, query_text string"), df, "id", "text").collect()}
    assert score("gamma alpha") == {1: 0.063853, 2: 0.680834} and score("gamma gamma") == {2: 1.257417}
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "id long, e array<double>")
    q = v.where("id = 1").select(F.col("id").alias("query_id"), F.col("e").alias("q"))
    dense = retrieval.dense_scores(retrieval.distances(q, v))
    assert [round(r.dense, 3) for r in dense.orderBy("id").collect()] == [1.0, 0.667, 0.333]
    assert [(r.id, r["rank"]) for r in retrieval.nearest(q, v, 5).orderBy("rank").collect()] == [(2, 1), (3, 2)]


def test_scores(spark):
    df = spark.createDataFrame([(3.0, 0.0, 1.0), (3.0, 0.0, 3.0)], "c double, e double, n double")
    rows = df.withColumn("s", pairs.logit_score(F.col("c"), F.col("e"), F.col("n"))).withColumn("k", pairs.confidence(F.col("s"))).collect()
    assert [(round(r.s, 4), r.k) for r in rows] == [(0.7474, 74), (0.2499, 24)]


def test_votes(spark):
    rows = [(1, 72, "YES", "YES"), (2, 72, "YES", "NO"), (3, 72, "NO", "NO"), (4, 72, None, None), (5, 65, "YES", "NO"), (6, 90, "NO", "NO"), (7, 59, "NO", "NO")]
    records = spark.createDataFrame([(o, c, None, f"a{o}", f"b{o}") for o, c, *_ in rows], "ord long, confidence int, llm_verified boolean, a string, b string")
    given = spark.createDataFrame([(f"a{o}", f"b{o}", v.count("YES"), v.count("NO")) for o, _, *v in rows if v[0]], "key_a string, key_b string, yes int, no int")
    assert {r.ord: r.confidence for r in votes.verify(records, given).collect()} == {1: 75, 2: 62, 4: 72, 5: 60, 6: 90, 7: 59}
    runs = spark.createDataFrame([(1, 0, True, "x"), (1, 1, True, "y"), (1, 2, False, "z")], "pair_id long, run int, is_contradiction boolean, result string")
    assert tuple(votes.self_consistency(runs).first()) == (1, True, 0.67, "2/3", "x")


def test_graph(spark):
    edges = spark.createDataFrame([("d", 1, "A", "B", 80), ("d", 2, "B", "C", 70), ("d", 3, "C", "A", 60), ("d", 4, "A", "A", 90)], "doc_name string, edge_ord long, src string, dst string, confidence int").withColumn("severity", F.lit("High"))
    assert graph.chains(edges).count() == 8 and graph.chains(edges).agg(F.max("depth")).first()[0] == 3
    found = graph.loops(edges)
    assert found.count() == 7 and found.agg(F.min("size")).first()[0] == 3
    starts = spark.createDataFrame([("d", "B")], "doc_name string, first string")
    assert sorted((r.section, r.hops, r.propagation_score) for r in graph.risk(edges, starts).collect()) == [("A", 2, 29.0), ("A", 3, 19.0), ("C", 1, 70.0)]
    sections = spark.createDataFrame([("d", x) for x in "ABC"], "doc_name string, section string")
    assert tuple(graph.summary(sections, edges).first()) == ("d", 3, 4, 72.9)


def test_quotes_find_their_statement(spark):
    s = spark.createDataFrame([("d", 1, 0, "No."), ("d", 1, 1, "Badges are worn."), ("d", 2, 0, "Badges are worn. Always.")], "doc_name string, chunk_id int, stmt_idx int, statement string")
    q = spark.createDataFrame([("d", 1, "No."), ("d", 2, "adges are wor"), ("d", 3, "Badges are worn. A"), ("d", 4, "absent")], "doc_name string, quote_id int, quote string")
    assert sorted((r.quote_id, r.chunk_id, r.stmt_idx) for r in graph.resolve(q, s).collect()) == [(1, 1, 0), (2, 1, 1), (3, 2, 0)]


def test_parameters(spark):
    text = '```json\n{"top_k": 99, "alpha": -1, "min_chunk": 10, "max_chunk": 9999, "min_confidence": 10}\n```'
    df = one(spark, t=text, s="x" * 100, bad="{oops")
    p = value(df, responses.parameters(F.col("t"), F.col("s")))
    assert (p.top_k, p.alpha, p.min_chunk, p.max_chunk, p.min_confidence, p.api_delay) == (8, 0.0, 50, 2000, 60, 2.0)
    assert value(df, responses.parameters(F.col("bad"), F.col("s"))).top_k == 5 and value(df, responses.chart(F.col("bad"), F.lit(1), F.lit(True))) is None
    chart = value(one(spark, t='```\n{"title": "T", "data_points": [{"label": "q1", "value": 3}]}\n```'), responses.chart(F.col("t"), F.lit(2), F.lit(False)))
    assert (chart.chart_type, chart.title, chart.confidence, chart.data_points[0].label) == ("other", "T", 0.5, "q1")


def test_response_defaults(spark):
    df = one(spark, t="nothing of the kind", m="CONTRADICTION FOUND:\nType: scope\nExplanation: one\n---\nCONTRADICTION FOUND:\nExplanation: two")
    t = F.col("t")
    assert [value(df, c) for c in (responses.confidence(t), responses.severity(t), responses.contradiction_type(t), responses.source(t), responses.is_valid(t), responses.visual(t))] == [None, "Low", "Direct", "CROSS", False, None]
    assert len(value(df, responses.blocks(F.col("m")))) == 2 and value(df, responses.visual(F.col("m"))).confidence == 60
    assert value(df, responses.latin1(F.lit("a—b “c” … •"))) == 'a-b "c" ... -'


def test_charts(spark):
    point = lambda *xs: [(x, "1") for x in xs]
    rows = [("d", 1, 0, "bar", "Out", point("a"), False), ("d", 2, 0, "bar", "OUT ", point("b"), True), ("d", 3, 0, "bar", "", point("q1", "q2", "q3", "q4"), False), ("d", 4, 0, "bar", "", point("q1", "q2", "q3"), True), ("d", 5, 1, "bar", "Out", point("a"), True), ("d", 6, 0, "bar", "", point("q1", "q2", "z"), True), ("d", 7, 0, "bar", "Out", point("a"), False)]
    df = spark.createDataFrame(rows, "doc_name string, ord long, page_number int, chart_type string, title string, data_points array<struct<label:string,value:string>>, embedded boolean")
    assert sorted(r.ord for r in visual.without_duplicates(df).collect()) == [1, 3, 5, 6, 7]
    many = spark.createDataFrame([("d", 1, 0, "bar", "", point(*(f"p{i}" for i in range(16))), "", "", "", "")], "doc_name string, ord long, page_number int, chart_type string, title string, data_points array<struct<label:string,value:string>>, x_axis_label string, y_axis_label string, trends string, key_findings string")
    chunk = visual.chart_chunks(many).first()
    assert (chunk.id, chunk.label, chunk.heading) == (10001, "Chart-1 (p.1)", "Chart on page 1") and "p14: 1" in chunk.text and "p15" not in chunk.text


def test_section_pairs_and_append(spark):
    rows = [(1, "A", "B", 70), (2, "B", "A", 80), (3, "C", "C (same section)", 60), (4, "C", "C (same section)", 60)]
    df = spark.createDataFrame(rows, "ord long, target string, related string, confidence int")
    best = pairs.one_per_section_pair(df)
    assert sorted((r.ord, r.first_seen) for r in best.collect()) == [(2, 1), (3, 3)]
    numbers = spark.createDataFrame([(9, "B", "A", 97), (10, "A", "B", 97)], "ord long, target string, related string, confidence int")
    assert sorted(r.ord for r in pairs.append_new(best.drop("first_seen"), numbers).collect()) == [2, 3, 10]


def test_reports_on_empty_records(spark):
    df = spark.createDataFrame([], "doc_name string, ord long, target string, related string, confidence int, severity string, type string")
    assert [f(df).count() for f in (reports.severity_counts, reports.type_counts, reports.confidence_histogram, reports.section_risk, reports.text_report)] == [0] * 5


def test_store(spark, tmp_path):
    path = str(tmp_path / "chunks")
    assert store.read_chunks(spark, path) is None
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "doc_name string, id int, text string")
    store.write_chunks(df, path)
    store.write_chunks(df.where("doc_name = 'b'").withColumn("text", F.lit("new")), path)
    assert [r.text for r in store.read_chunks(spark, path, "a").collect()] == ["x", "y"]
    assert [r.text for r in store.read_chunks(spark, path, "b").collect()] == ["new"]
    assert store.read_chunks(spark, path, "a", version="9") is None and store.read_chunks(spark, path, "zz") is None
    assert [r.doc_name for r in store.list_documents(spark, path).collect()] == ["a", "b"]
    assert store.delete_document(spark, path, "a") and not store.delete_document(spark, path, "a")
    assert store.read_chunks(spark, path, "a") is None


def test_images(spark):
    df = spark.createDataFrame([(1, 1, 7, 200, 200, "m"), (1, 2, 8, 200, 200, "m"), (2, 1, 9, 100, 400, "n"), (2, 2, 10, 2000, 200, "o")] + [(p, 9, 1, 300, 300, "logo") for p in range(3)], "page int, ordinal int, xref int, width int, height int, digest string")
    assert [r.xref for r in pages.content_images(df).collect()] == [7]


def test_stand_ins_for_models(spark):
    asked = spark.createDataFrame([("k1", 1), ("k2", 2)], "request_key string, n int")
    given = spark.createDataFrame([("k1", "yes")], "request_key string, response string")
    assert {r.n: r.response for r in votes.answered(asked, given).collect()} == {1: "yes", 2: "NO CONTRADICTION FOUND"}
    row = votes.hashed_embedding(spark.createDataFrame([("alpha beta",)], "text string")).first()
    assert abs(sum(x * x for x in row.embedding) - 1) < 1e-9


def test_streamed_statements(spark, tmp_path):
    spark.createDataFrame([(1, "This is one long statement. Too short."), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    query = ingest.statements(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("streamed").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.sql("SELECT doc_id, stmt_idx, statement FROM streamed").collect()] == [(1, 0, "This is one long statement.")]


def test_numeric_rows_are_compared_inside_their_document(spark):
    """The same pair of another document deletes nothing; a record of a section with itself counts without its suffix."""
    schema = "doc string, target string, related string"
    known = spark.createDataFrame([("d1", "Section 3", "Section 7"), ("d1", "Section 2", "Section 2 (same section)")], schema)
    numeric = spark.createDataFrame([("d1", "Section 3", "Section 7"), ("d2", "Section 3", "Section 7"), ("d1", "Section 2", "Section 2"), ("d1", "Section 7", "Section 3")], schema)
    added = {tuple(r) for r in pairs.append_new(known, numeric, ("doc",)).collect()} - {tuple(r) for r in known.collect()}
    assert added == {("d2", "Section 3", "Section 7"), ("d1", "Section 7", "Section 3")}


def test_gate_reconciles_the_first_contradiction(spark):
    """P14 with M5: numbers of the document that add up clear a contradiction, others don't; without a universe it stays."""
    texts = ["Public cloud spend reached $60 million in 2023.", "Public cloud spend reached $25 million in 2023."]
    statements = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "chunk_id int, stmt_idx int, statement string")
    rows = claims.claim_rows(statements, "chunk_id", "stmt_idx")
    pair = "chunk_id int, i int, j int, role_a string, role_b string, passed boolean, u array<double>"
    reasons = []
    for numbers in ([20.0, 15.0], [7.0, 9.0]):
        given = spark.createDataFrame([(0, 0, 1, "claim", "claim", True, numbers)], pair)
        reasons.append(claims.precision_gate(given, rows, universe="u").first().reason)
    reasons.append(claims.precision_gate(given, rows).first().reason)
    assert reasons == ["arithmetic_reconciled: sum_of_parts_a_contains_b", "claim_contradiction", "claim_contradiction"]
