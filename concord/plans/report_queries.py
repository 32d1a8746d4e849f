"""Queries of the pair pipeline, votes, responses, charts and reports (J1, J2, J6, J7, A*, X20-X28, S2, S6, S8, P21, P22)."""

from __future__ import annotations

import re as _re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import responses
from ..operators import claims, gates, pairs, reconcile, reports, visual, votes
from ..sources import pages, store
from .claim_queries import CLAIMS_SQL, _close, _parts, _share
from .claim_queries import _rows as claim_rows
from .common import STATEMENTS, duck, sql, table
from .gate_queries import GATE_SQL, _any, pair_roles, q, with_features
from .graph_queries import SECTIONS, WRITES
from .text_queries import CONCEPTS_SQL, KEYWORDS_SQL

# ---- pair pipeline: logits of a pair are a formula of its places, in place of a trained scorer


def _scored(df: DataFrame) -> DataFrame:
    n = lambda e: F.expr(e).cast("double")
    c, e, u = n("1.0D + ((i * 5 + j * 3 + chunk_id) % 7) * 0.5D"), n("((i + j) % 3) * 0.4D"), n("((i * 2 + chunk_id) % 4) * 0.3D")
    return df.withColumn("score", F.round(pairs.logit_score(c, e, u), 9))


def _ruled(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """The pairs that the whole precision gate (roles, claims, polarity) keeps, with their scores."""
    narrow = gates.with_gate(df).select("doc_id", "chunk_id", "other", "i", "j", F.col("role").alias("role_a"), F.col("role").alias("role_b"), "a", "b", "passed")
    kept = claims.precision_gate(narrow, claim_rows(spark, sf_dir), other="other").where("keep")
    return _scored(kept).select("doc_id", "chunk_id", "other", "i", "j", "a", "b", "score")


def _intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, pair_roles(spark, sf_dir).where(F.arrays_overlap("fa.keywords", "fb.keywords")).withColumn("other", F.col("chunk_id")))


def _cross_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_features(spark, sf_dir)
    chunks = s.select("doc_id", "chunk_id").distinct()
    related = chunks.select("doc_id", "chunk_id", F.explode(F.array(F.col("chunk_id") + 1, F.col("chunk_id") + 2)).alias("other"))
    return pairs.cross_pairs(s, related)


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, _cross_pairs(spark, sf_dir))


def p14_reconciler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The precision gate across chunks, with each document's numbers as the universe that may reconcile a contradiction of claims."""
    numbers = claims.universe(sql(spark, sf_dir, STATEMENTS, "customer", "nation"), "doc_id", "statement")
    narrow = gates.with_gate(_cross_pairs(spark, sf_dir)).select("doc_id", "chunk_id", "other", "i", "j", F.col("role").alias("role_a"), F.col("role").alias("role_b"), "passed")
    found = claims.precision_gate(narrow.join(numbers, "doc_id", "left"), claim_rows(spark, sf_dir), other="other", universe="universe")
    return found.select("chunk_id", "other", "i", "j", "keep", "stage", "reason", F.round("gap", 6).alias("gap"))


def j1_j2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = [pairs.top_candidates(x, ["doc_id", "chunk_id"], ["i", "other", "j"]) for x in (_intra(spark, sf_dir), _cross(spark, sf_dir))]
    return tops[0].unionByName(tops[1]).select("doc_id", "chunk_id", "other", "i", "j", "score", "place")


def a3_a5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.records(_intra(spark, sf_dir), _cross(spark, sf_dir)).select("doc_id", "ord", "first_seen", "target", "related", "confidence", "severity", "type")


def a6_clean_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = sql(spark, sf_dir, STATEMENTS, "customer", "nation").select("doc_id", "chunk_id").distinct()
    return pairs.clean_chunks(chunks, _intra(spark, sf_dir).where("score >= 0.93"))


_SOFT = "exp(c - greatest(c, e, n)) / (exp(c - greatest(c, e, n)) + exp(e - greatest(c, e, n)) + exp(n - greatest(c, e, n))) * (1 - exp(n - greatest(c, e, n)) / (exp(c - greatest(c, e, n)) + exp(e - greatest(c, e, n)) + exp(n - greatest(c, e, n))))"
_SCORED = f"SELECT doc_id, chunk_id, other, i, j, a, b, round({_SOFT}, 9) AS score FROM (SELECT *, 1.0::DOUBLE + ((i * 5 + j * 3 + chunk_id) % 7) * 0.5::DOUBLE AS c, ((i + j) % 3) * 0.4::DOUBLE AS e, ((i * 2 + chunk_id) % 4) * 0.3::DOUBLE AS n FROM {{0}})"
_SHARED_KW = f"len(list_intersect(list_distinct({KEYWORDS_SQL.format('a')}), list_distinct({KEYWORDS_SQL.format('b')})))"
_CROSS_GATE = (
    GATE_SQL[GATE_SQL.index("pairs AS") :]
    .replace("x.chunk_id = y.chunk_id AND x.stmt_idx < y.stmt_idx", "x.doc_id = y.doc_id AND y.chunk_id IN (x.chunk_id + 1, x.chunk_id + 2)")
    .replace("x.stmt_idx AS i, y.stmt_idx AS j", "y.chunk_id AS other, x.stmt_idx AS i, y.chunk_id * 24 + y.stmt_idx AS j")
)
for _name in ("pairs", "toks", "sig", "deltas", "gate", "gated"):
    _CROSS_GATE = _re.sub(rf"\b{_name} AS \(", f"x{_name} AS (", _CROSS_GATE)
    _CROSS_GATE = _re.sub(rf"(FROM|JOIN) {_name}\b", rf"\1 x{_name}", _CROSS_GATE)
#: The precision gate over the pairs of both kinds.
_RULED = """every AS (SELECT chunk_id, chunk_id AS other, i, j, signals FROM gated UNION ALL SELECT chunk_id, other, i, j % 24, signals FROM xgated),
cmp AS (SELECT p.chunk_id, p.other, p.i, p.j, count(*) AS n, bool_or(CASE WHEN a.value = 0 AND b.value = 0 THEN false ELSE abs(a.value - b.value) / greatest(abs(a.value), abs(b.value)) > 0.03::DOUBLE END) AS contra FROM every p JOIN claims a ON a.chunk_id = p.chunk_id AND a.stmt_idx = p.i
 JOIN claims b ON b.chunk_id = p.other AND b.stmt_idx = p.j AND a.metric = b.metric AND a.entity = b.entity AND a.unit = b.unit AND (a.year IS NULL OR b.year IS NULL OR a.year = b.year) AND (a.population = '' OR b.population = '' OR a.population = b.population) GROUP BY ALL),
having_ AS (SELECT DISTINCT chunk_id, stmt_idx FROM claims),
ruled AS (SELECT p.chunk_id, p.other, p.i, p.j FROM every p LEFT JOIN cmp USING (chunk_id, other, i, j) LEFT JOIN having_ ha ON ha.chunk_id = p.chunk_id AND ha.stmt_idx = p.i LEFT JOIN having_ hb ON hb.chunk_id = p.other AND hb.stmt_idx = p.j
 WHERE CASE WHEN coalesce(contra, false) THEN true WHEN ha.stmt_idx IS NOT NULL AND hb.stmt_idx IS NOT NULL AND n IS NULL THEN false ELSE signals <> '' END)"""
CAND_SQL = f"""{GATE_SQL}, {_CROSS_GATE}, {CLAIMS_SQL}, {_RULED}, intra AS ({_SCORED.format(f"(SELECT * FROM (SELECT *, chunk_id AS other FROM gated) SEMI JOIN ruled USING (chunk_id, other, i, j) WHERE {_SHARED_KW} >= 1)")}),
cross_ AS ({_SCORED.format(f"(SELECT * FROM (SELECT * REPLACE (j % 24 AS j) FROM xgated) SEMI JOIN ruled USING (chunk_id, other, i, j) WHERE {_SHARED_KW} >= 2)")}),
tops AS (SELECT * FROM (SELECT *, 0 AS is_cross, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY score DESC, i, other, j) AS place FROM intra WHERE score >= 0.40) WHERE place <= 10
 UNION ALL SELECT * FROM (SELECT *, 1, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY score DESC, i, other, j) AS place FROM cross_ WHERE score >= 0.40) WHERE place <= 10)"""
_COMPARABLE = "a.metric = b.metric AND a.entity = b.entity AND a.unit = b.unit AND (a.year IS NULL OR b.year IS NULL OR a.year = b.year) AND (a.population = '' OR b.population = '' OR a.population = b.population)"
_ALL_MASKS = ", ".join(f"({i}, [{', '.join(str(x + 1) for x in s)}])" for i, s in enumerate(reconcile.subsets()))
RECONCILER_SQL = f"""WITH {GATE_SQL}, {_CROSS_GATE}, {CLAIMS_SQL}, px AS (SELECT doc_id, chunk_id, other, i, j % 24 AS j, signals FROM xgated WHERE {_SHARED_KW} >= 2),
firsts AS (SELECT p.doc_id, p.chunk_id, p.other, p.i, p.j, count(*) AS n, arg_min({{'g': g, 'a': va, 'b': vb}}, [oa, ob]) FILTER (g > 0.03::DOUBLE) AS f FROM (SELECT p.*, a.value AS va, b.value AS vb, CAST(a.ord AS BIGINT) AS oa, CAST(b.ord AS BIGINT) AS ob, CASE WHEN a.value = 0 AND b.value = 0 THEN 0.0::DOUBLE ELSE abs(a.value - b.value) / greatest(abs(a.value), abs(b.value)) END AS g
 FROM px p JOIN claims a ON a.chunk_id = p.chunk_id AND a.stmt_idx = p.i JOIN claims b ON b.chunk_id = p.other AND b.stmt_idx = p.j AND {_COMPARABLE}) p GROUP BY ALL),
numbers AS (SELECT doc_id, list_sort(list(DISTINCT v)) AS u FROM (SELECT doc_id, TRY_CAST(trim(regexp_replace(t, '[$%,]', '', 'g')) AS DOUBLE) AS v FROM (SELECT doc_id, unnest(regexp_extract_all(statement, {q(gates.NUMBER_OR_PERCENT)})) AS t FROM ({duck(STATEMENTS)})))
 WHERE abs(v) >= 1 AND NOT (v BETWEEN 1900 AND 2099 AND v = floor(v)) GROUP BY doc_id),
n AS (SELECT concat_ws('/', chunk_id, other, i, j) AS id, f.a AS a, f.b AS b, u FROM firsts JOIN numbers USING (doc_id) WHERE f IS NOT NULL),
masks(m, ix) AS (VALUES {_ALL_MASKS}), {_parts("a", "list_append(u, b)", "sa")}, {_parts("b", "list_append(u, a)", "sb")},
sh AS (SELECT id, bool_or({_share("a", "b")} OR {_share("b", "a")}) AS share FROM (SELECT id, a, b, unnest(u) AS w FROM n) GROUP BY id),
rel AS (SELECT n.id, CASE WHEN {_close("a", "b", 0.02)} THEN 'rounding' WHEN list_contains(sa.p, b) THEN 'sum_of_parts_a_contains_b' WHEN list_contains(sb.p, a) THEN 'sum_of_parts_b_contains_a' WHEN share THEN 'share_of_whole' END AS relation FROM n LEFT JOIN sa USING (id) LEFT JOIN sb USING (id) LEFT JOIN sh USING (id)),
having_ AS (SELECT DISTINCT chunk_id, stmt_idx FROM claims),
staged AS (SELECT p.chunk_id, p.other, p.i, p.j, f.f.g AS gap, CASE WHEN relation IS NOT NULL THEN 'arithmetic_reconciled: ' || relation WHEN f.f IS NOT NULL THEN 'claim_contradiction' WHEN ha.stmt_idx IS NOT NULL AND hb.stmt_idx IS NOT NULL AND f.n IS NULL THEN 'no_comparable_claims' WHEN p.signals = '' THEN 'no_polarity_signal' ELSE 'gates_passed' END AS reason
 FROM px p LEFT JOIN firsts f USING (chunk_id, other, i, j) LEFT JOIN rel ON rel.id = concat_ws('/', p.chunk_id, p.other, p.i, p.j) LEFT JOIN having_ ha ON ha.chunk_id = p.chunk_id AND ha.stmt_idx = p.i LEFT JOIN having_ hb ON hb.chunk_id = p.other AND hb.stmt_idx = p.j)
SELECT chunk_id, other, i, j, reason IN ('claim_contradiction', 'gates_passed') AS keep, CASE reason WHEN 'claim_contradiction' THEN 'claim' WHEN 'no_comparable_claims' THEN 'claim' WHEN 'no_polarity_signal' THEN 'negation_gate' WHEN 'gates_passed' THEN 'all_passed' ELSE 'reconciler' END AS stage, reason,
 CASE WHEN reason = 'claim_contradiction' THEN round(gap, 6) END AS gap FROM staged"""
_KEY = r"regexp_replace(lower({0}), '\s+', ' ', 'g')"
_DIG = r"list_sort(list_distinct(regexp_extract_all(lower({0}), '\d+')))"
_TYPE = rf"""CASE WHEN regexp_matches(c, '\d+[%$]?\s') AND len({_DIG.format("a")}) > 0 AND len({_DIG.format("b")}) > 0 AND {_DIG.format("a")} <> {_DIG.format("b")} THEN 'Numerical' WHEN {_any("c", gates.TEMPORAL)} THEN 'Temporal'
 WHEN {_any("lower(a)", gates.SCOPE)} AND {_any("lower(b)", gates.SCOPE)} AND (contains(lower(a), 'not ') OR contains(lower(b), 'not ') OR contains(c, 'prohibited') OR contains(c, 'never')) THEN 'Scope' WHEN {_any("c", gates.EXCEPTION)} THEN 'Exception-based' WHEN contains(c, 'when ') OR contains(c, 'provided ') THEN 'Conditional' ELSE 'Direct' END"""
RECORDS_SQL = f"""WITH {CAND_SQL}, uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, is_cross, least({_KEY.format("a")}, {_KEY.format("b")}), greatest({_KEY.format("a")}, {_KEY.format("b")}) ORDER BY score DESC, chunk_id, i, other, j) AS p2 FROM tops) WHERE p2 = 1),
conf AS (SELECT *, floor(score * 100)::INTEGER AS confidence, lower(a) || ' ' || lower(b) AS c FROM uniq), kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, is_cross, score DESC, i, other, j) AS ord FROM conf WHERE confidence >= 60 AND len(list_intersect(list_distinct({CONCEPTS_SQL.format("a")}), list_distinct({CONCEPTS_SQL.format("b")}))) >= 2),
rec AS (SELECT doc_id, ord, 'Section ' || chunk_id AS target, CASE WHEN is_cross = 0 THEN 'Section ' || chunk_id || ' (same section)' ELSE 'Section ' || other END AS related, confidence, CASE WHEN confidence >= 85 THEN 'High' WHEN confidence >= 70 THEN 'Medium' ELSE 'Low' END AS severity, {_TYPE} AS type,
 least('Section ' || chunk_id, 'Section ' || other) AS k1, greatest('Section ' || chunk_id, 'Section ' || other) AS k2 FROM kept)
SELECT doc_id, ord, first_seen, target, related, confidence, severity, type FROM (SELECT *, min(ord) OVER (PARTITION BY doc_id, k1, k2) AS first_seen, row_number() OVER (PARTITION BY doc_id, k1, k2 ORDER BY confidence DESC, ord) AS best FROM rec) WHERE best = 1"""

# ---- votes: three runs for each order, from its lines

VOTES = "SELECT l_orderkey AS pair_id, l_linenumber AS run, l_quantity > 25 AS is_contradiction, concat('run ', l_linenumber) AS result FROM {lineitem} WHERE l_linenumber <= 3"
VERIFY = "SELECT o_orderkey AS ord, CAST(50 + o_orderkey % 50 AS INTEGER) AS confidence, o_orderkey % 11 = 0 AS llm_verified, concat('claim ', o_custkey % 90) AS a, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('denial ', o_custkey % 70) END AS b FROM {orders}"
PAIR_VOTES = "SELECT DISTINCT concat('claim ', o_custkey % 90) AS key_a, concat('denial ', o_custkey % 70) AS key_b, (o_custkey % 630) % 3 AS yes, CASE WHEN (o_custkey % 630) % 7 = 0 THEN 0 ELSE 2 - (o_custkey % 630) % 3 END AS no FROM {orders} WHERE o_custkey % 5 <> 0"


def a9_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.self_consistency(sql(spark, sf_dir, VOTES, "lineitem"))


def a10_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.verify(sql(spark, sf_dir, VERIFY, "orders"), sql(spark, sf_dir, PAIR_VOTES, "orders")).select("ord", "confidence", "llm_verified")


# ---- responses

RESPONSES = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 = 0 THEN 'NO CONTRADICTION FOUND' ELSE concat('CONTRADICTION FOUND:', chr(10), 'Source: ', CASE WHEN s_suppkey % 2 = 0 THEN 'INTRA' ELSE 'cross' END, chr(10), 'Type: ', CASE WHEN s_suppkey % 3 = 0 THEN 'Temporal' ELSE 'Numerical' END, chr(10),
'Target Section: Section ', s_suppkey % 9, chr(10), 'Conflicting Section: Section ', s_suppkey % 7, CASE WHEN s_suppkey % 4 = 0 THEN ' (same section)' ELSE '' END, chr(10), 'Statement A (Section ', s_suppkey % 9, '): "Rate is ', s_suppkey, '%."', chr(10), 'Statement B: "Rate is ', s_suppkey + 9, '%."', chr(10),
'Chart Reference: Chart-', s_suppkey % 5, chr(10), 'Text Section: Section 3', chr(10), 'Chart Claim: up ', s_suppkey, chr(10), 'Text Claim: down', chr(10), 'Explanation: They differ', chr(10), 'by nine.', chr(10), 'Severity: ', CASE WHEN s_suppkey % 5 = 0 THEN 'high' ELSE 'Medium' END, chr(10),
CASE WHEN s_suppkey % 8 = 1 THEN '' ELSE concat('Confidence: ', s_suppkey * 3 % 140) END, chr(10), '---', chr(10), 'CONTRADICTION FOUND:', chr(10), 'Explanation: second') END AS text FROM {supplier}"""


def x23_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return sql(spark, sf_dir, RESPONSES, "supplier").select(
        "id", responses.is_valid(t).alias("valid"), F.size(responses.blocks(t)).alias("n_blocks"), responses.confidence(t).alias("confidence"), responses.severity(t).alias("severity"), responses.contradiction_type(t).alias("type"), responses.source(t).alias("source"),
        responses.quoted(t, "A").alias("quoted_a"), responses.quoted(t, "B").alias("quoted_b"), responses.field(t, "Explanation").alias("explanation"), responses.field(t, "Conflicting Section").alias("conflicting"),
    )


def x25_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sql(spark, sf_dir, RESPONSES, "supplier").select(F.col("id").alias("chart_id"), (F.col("id") % 2 == 0).alias("multi_hop"), responses.visual(F.col("text")).alias("v"))
    return visual.visual_records(df)


def x28_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sql(spark, sf_dir, RESPONSES, "supplier").withColumn("r", responses.report_row(F.col("text"), F.concat(F.lit("Section "), (F.col("id") % 9).cast("string")), F.lit(None).cast("string")))
    return df.select("id", "r.source", "r.pair", "r.statement_a", "r.statement_b", responses.latin1(F.col("r.explanation")).alias("explanation"))


def _first(pattern: str, other: str = "NULL") -> str:
    return f"coalesce(nullif(regexp_extract(text, {q(pattern)}, 1), ''), {other})"


_CONF = r"CASE WHEN regexp_matches(text, 'Confidence:\s*\d') THEN least(100, greatest(0, TRY_CAST(regexp_extract(text, 'Confidence:\s*(\d+)', 1) AS INTEGER))) END"
_SEV = f"upper(left({_first('(?i)Severity:' + chr(92) + 's*(High|Medium|Low)', q('Low'))}, 1)) || lower(substr({_first('(?i)Severity:' + chr(92) + 's*(High|Medium|Low)', q('Low'))}, 2))"


def _field(name: str) -> str:
    """A field ends where the line of the next one begins; in the made responses that is the next line with a colon."""
    nxt = {"Explanation": "Severity:", "Conflicting Section": "Statement A", "Source": "Type:", "Statement A": "Statement B", "Statement B": "Explanation:"}[name]
    return rf"""regexp_replace(regexp_replace(CASE WHEN contains(text, '{name}') THEN split_part(regexp_replace(text, '(?s)^.*?{name}(?:\s*\([^)]*\))?\s*:\s*', ''), chr(10) || '{nxt}', 1) ELSE '' END, '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g')"""


# ---- charts

CHARTS = """SELECT concat('doc', p_partkey % 20) AS doc_name, p_partkey AS ord, p_partkey % 4 AS page_number, CASE WHEN p_size % 2 = 0 THEN 'bar' ELSE 'pie' END AS chart_type, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('Output ', p_size % 4) END AS title,
CASE WHEN p_size % 3 = 0 THEN 'year' ELSE '' END AS x_axis_label, '' AS y_axis_label, p_size % 12 AS shift, p_partkey % 2 = 1 AS embedded, 'up' AS trends, CAST(NULL AS VARCHAR(9)) AS key_findings FROM {part}"""


def _charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda i: F.concat(F.lit("q"), (i + F.col("shift")).cast("string"))
    points = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.struct(label(i).alias("label"), i.cast("string").alias("value")))
    return sql(spark, sf_dir, CHARTS, "part").withColumn("data_points", points)


def x20_chart_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.chart_chunks(_charts(spark, sf_dir)).select("doc_name", "id", "label", "display", "heading", "page_number", F.md5("text").alias("digest"))


def a20_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = visual.without_duplicates(_charts(spark, sf_dir))
    seen = unique.select("doc_name", "page_number").distinct().where("page_number != 3")
    return visual.first_charts(unique, seen).select("doc_name", "ord")


def j6_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4").select(F.col("l_orderkey").alias("chart_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("Section "), F.col("l_partkey").cast("string")).alias("label"), (F.col("l_quantity") > 35).alias("is_chart"))
    return visual.related_text(hits).withColumn("secondary", F.array_join("secondary", ","))


# ---- reports

SECTION_IDS = f"SELECT doc_name, section, row_number() OVER (PARTITION BY doc_name ORDER BY section) AS id FROM ({SECTIONS}) AS s"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, WRITES, "supplier").select("doc_name", F.col("edge_ord").alias("ord"), F.col("src").alias("target"), F.col("dst").alias("related"), "confidence", "severity", "type")


def a14_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.heatmap_matrix(_records(spark, sf_dir), sql(spark, sf_dir, SECTION_IDS, "supplier"), 12)


def a18_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_statistics(table(spark, sf_dir, "documents").select(F.col("source").alias("doc_name"), "text"))


def j7_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).where("ord % 2 = 0").select("doc_name", "target", "related", "confidence")
    n = _records(spark, sf_dir).where("ord % 2 = 1").select("doc_name", "target", "related", "confidence")
    return pairs.append_new(r, n, ("doc_name",))


def s2_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("xref"), (F.col("l_suppkey") * 40).alias("width"), (F.col("l_quantity") * 9).cast("int").alias("height"), F.md5(F.concat_ws("-", F.col("l_suppkey").cast("string"), (F.col("l_quantity") * 9).cast("int").cast("string"))).alias("digest"))
    return pages.content_images(rows, most_listings=30).select("page", "ordinal", "xref", "digest")


def s6_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_name")).distinct().withColumn("doc_key", store.doc_key(F.col("doc_name")))


PARAMS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'no json' ELSE concat(CASE WHEN c_custkey % 2 = 0 THEN concat('```json', chr(10)) ELSE '' END, '{{{{"top_k": ', c_custkey % 12, ', "alpha": ', c_custkey % 3, '.5, "max_chunk": ', c_custkey % 3000, ', "min_confidence": ', c_custkey % 120, CASE WHEN c_custkey % 3 = 0 THEN ', "reasoning": "long reports"' ELSE '' END, '}}}}',
CASE WHEN c_custkey % 2 = 0 THEN concat(chr(10), '```') ELSE '' END) END AS text, CASE WHEN c_custkey % 7 = 0 THEN 'short' ELSE repeat('sample ', 20) END AS sample FROM {customer}"""


def p22_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, PARAMS, "customer").select("id", responses.parameters(F.col("text"), F.col("sample")).alias("p")).select("id", "p.*")


def _recs() -> str:
    return f"recs AS (SELECT doc_name, edge_ord AS ord, src AS target, dst AS related, confidence, severity, type, replace(dst, ' (same section)', '') AS other FROM ({duck(WRITES)})), sections AS ({duck(SECTION_IDS)})"


_RANK = "CASE severity WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END"
_PLACE = f"row_number() OVER (PARTITION BY doc_name ORDER BY {_RANK}, confidence DESC, ord)"

QUERIES = {
    "j1_j2_a1_a2_candidates": j1_j2_candidates, "a3_a4_a5_records": a3_a5_records, "a6_clean_chunks": a6_clean_chunks, "a9_self_consistency": a9_consistency, "a10_verifier": a10_verifier,
    "x23_x24_x26_x27_responses": x23_responses, "x25_a22_visual_records": x25_visual, "x28_report_rows": x28_report_rows, "x20_x21_chart_chunks": x20_chart_chunks, "a20_a21_charts": a20_charts, "j6_related_text": j6_related,
    "a7_heatmap_cells": lambda s, d: pairs.heatmap(_records(s, d).withColumnRenamed("doc_name", "doc_id")), "a8_top_records": lambda s, d: pairs.top_by_confidence(_records(s, d).withColumnRenamed("doc_name", "doc_id")).select("doc_id", "ord", "place"),
    "a11_severity_counts": lambda s, d: reports.severity_counts(_records(s, d)), "a12_type_counts": lambda s, d: reports.type_counts(_records(s, d)), "a13_histogram": lambda s, d: reports.confidence_histogram(_records(s, d)), "a14_heatmap_matrix": a14_heatmap,
    "a15_section_risk": lambda s, d: reports.section_risk(_records(s, d)), "a16_network": lambda s, d: reports.network(_records(s, d), sql(s, d, SECTION_IDS, "supplier")), "a17_cross_modal": lambda s, d: reports.cross_modal(_records(s, d)), "a18_statistics": a18_statistics,
    "a19_ordered": lambda s, d: reports.ordered(_records(s, d)).select("doc_name", "ord", "place"), "p21_filters": lambda s, d: reports.filtered(_records(s, d), ["High", "Low"], ["Direct"]).select("doc_name", "ord"), "s8_text_report": lambda s, d: reports.text_report(_records(s, d)),
    "p14_m5_reconciler": p14_reconciler, "j7_append_new": j7_append, "s2_images": s2_images, "s6_keys": s6_keys, "p22_x22_parameters": p22_parameters,
}
ORACLE_SQL = {
    "j1_j2_a1_a2_candidates": f"WITH {CAND_SQL} SELECT doc_id, chunk_id, other, i, j, score, place FROM tops",
    "a3_a4_a5_records": RECORDS_SQL,
    "a6_clean_chunks": f"WITH {CAND_SQL} SELECT doc_id, count(*) AS clean FROM (SELECT DISTINCT doc_id, chunk_id FROM ({duck(STATEMENTS)})) c WHERE NOT EXISTS (SELECT 1 FROM intra i WHERE i.doc_id = c.doc_id AND i.chunk_id = c.chunk_id AND score >= 0.93) GROUP BY 1",
    "a9_self_consistency": f"""SELECT pair_id, y >= 2 AS is_contradiction, round_even(greatest(y, n - y) / n, 2) AS stability, greatest(y, n - y) || '/' || n AS agreement, coalesce(CASE WHEN y >= 2 THEN fy ELSE fn END, 'NO CONTRADICTION FOUND') AS best_result FROM (SELECT pair_id, count(*) FILTER (is_contradiction) AS y, count(*) AS n, min_by(result, run) FILTER (is_contradiction) AS fy, min_by(result, run) FILTER (NOT is_contradiction) AS fn FROM ({duck(VOTES)}) GROUP BY 1)""",
    "a10_verifier": f"""WITH r AS ({duck(VERIFY)}), v AS (SELECT key_a, key_b, max(yes) AS yes, max(no) AS no FROM ({duck(PAIR_VOTES)}) GROUP BY ALL), j AS (SELECT r.*, yes, coalesce(yes + no > 0, false) AS judged FROM r LEFT JOIN v ON confidence BETWEEN 60 AND 85 AND NOT llm_verified AND a <> '' AND b <> '' AND key_a = a AND key_b = b)
SELECT ord, (CASE WHEN judged AND yes >= 2 THEN least(99, confidence + 3) WHEN judged THEN greatest(60, confidence - 10) ELSE confidence END)::INTEGER AS confidence, CASE WHEN judged THEN yes >= 2 ELSE llm_verified END AS llm_verified FROM j WHERE NOT judged OR yes > 0""",
    "x23_x24_x26_x27_responses": f"""SELECT id, NOT contains(text, 'NO CONTRADICTION FOUND') AND contains(text, 'Type:') AND contains(text, 'Severity:') AND contains(text, 'Confidence:') AS valid, (CASE WHEN contains(text, 'CONTRADICTION FOUND:') THEN 2 ELSE 0 END)::INTEGER AS n_blocks, {_CONF} AS confidence, {_SEV} AS severity,
 {_first('(?i)Type:' + chr(92) + 's*(Direct|Conditional|Exception-based|Numerical|Temporal|Definitional|Scope)', q('Direct'))} AS type, upper({_first('(?i)Source:' + chr(92) + 's*(INTRA|CROSS)', q('CROSS'))}) AS source, regexp_extract(text, 'Statement A[^"]*"([^"]+)"', 1) AS quoted_a, regexp_extract(text, 'Statement B[^"]*"([^"]+)"', 1) AS quoted_b, {_field("Explanation")} AS explanation, {_field("Conflicting Section")} AS conflicting FROM ({duck(RESPONSES)})""",
    "x25_a22_visual_records": f"""SELECT * FROM (SELECT id AS chart_id, CASE WHEN id % 2 = 0 THEN 'Multi-hop-Visual-' ELSE 'Visual-' END || {_first('(?i)Type:' + chr(92) + 's*(Numerical|Trend|Scope|Categorical|Temporal|Omission)', q('Numerical'))} AS type, {_SEV} AS severity, coalesce({_CONF}, 60) AS confidence, trim(regexp_extract(text, 'Chart Claim:\\s*(.+?)(?:\\n|$)', 1)) AS chart_claim,
 trim(regexp_extract(text, 'Text Claim:\\s*(.+?)(?:\\n|$)', 1)) AS text_claim, '' AS hop_chain, true AS is_visual, id % 2 = 0 AS is_multi_hop FROM ({duck(RESPONSES)}) WHERE contains(text, 'CONTRADICTION FOUND')) WHERE confidence >= 60""",
    "x28_report_rows": f"""SELECT id, s AS source, CASE WHEN contains(lower(c), 'same section') OR s = 'INTRA' THEN t || ' (intra-section)' ELSE t || '  vs  ' || c END AS pair, a AS statement_a, b AS statement_b, e AS explanation FROM (SELECT id, 'Section ' || (id % 9) AS t, upper(coalesce(nullif({_field("Source")}, ''), 'CROSS')) AS s, {_field("Conflicting Section")} AS c, {_field("Statement A")} AS a, {_field("Statement B")} AS b, {_field("Explanation")} AS e FROM ({duck(RESPONSES)}))""",
    "x20_x21_chart_chunks": f"""SELECT doc_name, (10000 + i)::INTEGER AS id, 'Chart-' || i || ' (p.' || (page_number + 1) || ')' AS label, CASE WHEN title <> '' THEN 'Chart-' || i || ': ' || left(title, 35) ELSE 'Chart-' || i || ' (p.' || (page_number + 1) || ')' END AS display, CASE WHEN title <> '' THEN title ELSE 'Chart on page ' || (page_number + 1) END AS heading, page_number + 1 AS page_number,
 md5('[CHART on Page ' || page_number || ']' || CASE WHEN title <> '' THEN chr(10) || 'Chart Title: ' || title ELSE '' END || chr(10) || 'Chart Type: ' || chart_type || CASE WHEN x_axis_label <> '' THEN chr(10) || 'Axes: X-axis: ' || x_axis_label ELSE '' END || chr(10) || 'Data Points: ' || array_to_string(list_transform(range(1, 16), lambda k: 'q' || (k + shift) || ': ' || k), '; ') || chr(10) || 'Trend: up') AS digest
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY ord) AS i FROM ({duck(CHARTS)}))""",
    "a20_a21_charts": f"""WITH RECURSIVE c AS (SELECT *, list_transform(range(1, 17), lambda k: 'q' || (k + shift)) AS labels, row_number() OVER (PARTITION BY doc_name, page_number, chart_type ORDER BY ord) AS n FROM ({duck(CHARTS)})),
fold AS (SELECT doc_name, page_number, chart_type, 1::BIGINT AS n, [{{'ord': ord, 'title': title, 'labels': labels}}] AS kept FROM c WHERE n = 1 UNION ALL
 SELECT f.doc_name, f.page_number, f.chart_type, f.n + 1, CASE WHEN c.embedded AND len(list_filter(f.kept, lambda o: (o.title <> '' AND lower(o.title) = lower(c.title)) OR len(list_intersect(o.labels, c.labels)) / len(list_distinct(list_concat(o.labels, c.labels))) > 0.7::DOUBLE)) > 0 THEN f.kept ELSE list_append(f.kept, {{'ord': c.ord, 'title': c.title, 'labels': c.labels}}) END
 FROM fold f JOIN c ON c.doc_name = f.doc_name AND c.page_number = f.page_number AND c.chart_type = f.chart_type AND c.n = f.n + 1),
last AS (SELECT doc_name, page_number, chart_type, arg_max(kept, n) AS kept FROM fold GROUP BY ALL), u AS (SELECT doc_name, page_number, unnest(list_transform(kept, lambda o: o.ord)) AS ord FROM last)
SELECT doc_name, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY ord) AS place FROM u WHERE page_number <> 3) WHERE place <= 30""",
    "j6_related_text": "SELECT chart_id, l[1] AS primary, array_to_string(l[2:], ',') AS secondary, len(l) >= 2 AS multi_hop FROM (SELECT l_orderkey AS chart_id, list('Section ' || l_partkey ORDER BY l_linenumber, 'Section ' || l_partkey) AS l FROM lineitem WHERE l_linenumber <= 4 AND NOT l_quantity > 35 GROUP BY 1)",
    "a7_heatmap_cells": f"WITH {_recs()} SELECT doc_name AS doc_id, target, related, max_by(confidence, ord) AS confidence FROM recs GROUP BY ALL",
    "a8_top_records": f"WITH {_recs()} SELECT * FROM (SELECT doc_name AS doc_id, ord, row_number() OVER (PARTITION BY doc_name ORDER BY confidence DESC, ord) AS place FROM recs) WHERE place <= 3",
    "a11_severity_counts": f"WITH {_recs()} SELECT d.doc_name, s AS severity, count(r.ord) AS n FROM (SELECT DISTINCT doc_name FROM recs) d CROSS JOIN (VALUES ('High'), ('Medium'), ('Low')) v(s) LEFT JOIN recs r ON r.doc_name = d.doc_name AND r.severity = s GROUP BY ALL",
    "a12_type_counts": f"WITH {_recs()} SELECT doc_name, type, count(*) AS n FROM recs GROUP BY ALL",
    "a13_histogram": f"WITH {_recs()} SELECT doc_name, (least(9, floor(confidence / 10)) * 10)::BIGINT AS bin, count(*) AS n FROM recs GROUP BY ALL",
    "a14_heatmap_matrix": f"WITH {_recs()}, cells AS (SELECT doc_name, target AS x, other AS y, confidence, ord FROM recs UNION ALL SELECT doc_name, other, target, confidence, ord FROM recs) SELECT doc_name, x, y, max_by(confidence, ord) AS confidence FROM cells WHERE (doc_name, x) IN (SELECT (doc_name, section) FROM sections WHERE id <= 12) AND (doc_name, y) IN (SELECT (doc_name, section) FROM sections WHERE id <= 12) GROUP BY ALL",
    "a15_section_risk": f"WITH {_recs()} SELECT doc_name, target, round_even(sum(CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END * confidence / 100), 2) AS risk FROM recs GROUP BY ALL",
    "a16_network": f"WITH {_recs()} SELECT doc_name, target, other, max_by(confidence, ord) AS weight, max_by(severity, ord) AS severity, greatest(1.0::DOUBLE, max_by(confidence, ord) / 25) AS width FROM recs WHERE (doc_name, other) IN (SELECT (doc_name, section) FROM sections) GROUP BY ALL",
    "a17_cross_modal": f"WITH {_recs()} SELECT doc_name, node, count(*) AS n, CASE WHEN starts_with(node, 'Chart-') THEN 'chart' ELSE 'text' END AS node_type FROM (SELECT doc_name, target AS node FROM recs UNION ALL SELECT doc_name, other FROM recs) GROUP BY ALL",
    "a18_statistics": "SELECT source AS doc_name, count(*) AS n, floor(avg(length(text)))::BIGINT AS mean_length, count(*) * 5 AS retrievals, (count(*) * (count(*) - 1) // 2) AS pairs FROM documents GROUP BY 1",
    "a19_ordered": f"WITH {_recs()} SELECT doc_name, ord, {_PLACE} AS place FROM recs",
    "p21_filters": f"WITH {_recs()} SELECT doc_name, ord FROM recs WHERE severity IN ('High', 'Low') AND type = 'Direct'",
    "s8_text_report": f"WITH {_recs()}, p AS (SELECT *, {_PLACE} AS place FROM recs) SELECT doc_name, string_agg(place || '. [' || severity || '] ' || target || ' vs ' || other || ' (' || type || ', ' || confidence || '%)', chr(10) ORDER BY place) AS report FROM p GROUP BY 1",
    "p14_m5_reconciler": RECONCILER_SQL, "j7_append_new": f"WITH {_recs()} SELECT doc_name, target, related, confidence FROM recs WHERE ord % 2 = 0 UNION ALL SELECT doc_name, target, related, confidence FROM recs WHERE ord % 2 = 1 AND (doc_name, target, related) NOT IN (SELECT (doc_name, target, replace(related, ' (same section)', '')) FROM recs WHERE ord % 2 = 0)",
    "s2_images": """WITH i AS (SELECT l_orderkey AS page, l_linenumber AS ordinal, l_partkey AS xref, l_suppkey * 40 AS width, CAST(floor(l_quantity * 9) AS INTEGER) AS height, md5(l_suppkey || '-' || CAST(floor(l_quantity * 9) AS INTEGER)) AS digest FROM lineitem), c AS (SELECT xref FROM i GROUP BY 1 HAVING count(*) >= 30)
SELECT page, ordinal, xref, digest FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page, ordinal) AS place FROM i WHERE xref NOT IN (SELECT xref FROM c) AND least(width, height) >= 150 AND greatest(width, height) <= 8.0::DOUBLE * least(width, height)) WHERE place = 1""",
    "s6_keys": "SELECT DISTINCT source AS doc_name, 'doc_' || left(md5(source), 12) AS doc_key FROM documents",
    "p22_x22_parameters": """SELECT id, CASE WHEN u THEN greatest(2, least(8, id % 12)) ELSE 5 END::INTEGER AS top_k, CASE WHEN u THEN least(1.0::DOUBLE, id % 3 + 0.5::DOUBLE) ELSE 0.5::DOUBLE END AS alpha, 150 AS min_chunk, CASE WHEN u THEN greatest(300, least(2000, id % 3000)) ELSE 1000 END::INTEGER AS max_chunk, CASE WHEN u THEN greatest(60, least(95, id % 120)) ELSE 70 END::INTEGER AS min_confidence, 2.0::DOUBLE AS api_delay,
 CASE WHEN u AND id % 3 = 0 THEN 'long reports' ELSE 'Default parameters applied.' END AS reasoning FROM (SELECT c_custkey AS id, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS u FROM customer)""",
}
