"""Queries of roles and pair gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..operators import gates
from .common import PAIRS, STATEMENTS, duck, spread, sql, table
from .text_queries import CONCEPTS_SQL, KEYWORDS_SQL, strip


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _number_sql(t: str) -> str:
    return f"TRY_CAST(trim(regexp_replace({t}, '[$%,]', '', 'g')) AS DOUBLE)"


BACKBONE = f"""(regexp_matches(s, {q(gates.PERCENT)}) OR regexp_matches(s, {q(gates.CURRENCY)}) OR regexp_matches(s, {q(gates.GROWTH)}) OR len(regexp_extract_all(s, {q(gates.NUMBER)})) >= 2
 OR len(list_filter(regexp_extract_all(s, {q(gates.NUMBER)}), lambda t: abs({_number_sql("t")}) >= 100 AND NOT regexp_full_match(trim(t), '(19|20)\\d{{2}}'))) > 0)"""
ROLE_SQL = f"""CASE WHEN s = '' THEN 'boilerplate|1.0|empty' WHEN regexp_matches(s, {q(gates.CAPTION)}) THEN 'caption|0.98|caption_prefix' WHEN regexp_matches(s, {q(gates.CONTENTS_ROW)}) THEN 'caption|0.92|toc_dotleader'
 WHEN regexp_matches(s, {q(gates.BOILERPLATE)}) THEN 'boilerplate|0.9|boilerplate_cue' WHEN regexp_matches(s, {q(gates.METADATA)}) THEN 'metadata|0.85|metadata_cue' WHEN regexp_matches(s, {q(gates.DEFINITION)}) THEN 'definition|0.9|definition_cue'
 WHEN regexp_matches(s, {q(gates.RECOMMENDATION)}) THEN 'recommendation|0.85|imperative_start' WHEN regexp_matches(s, {q(gates.OBLIGATION)}) THEN 'claim|0.8|modal_obligation'
 WHEN regexp_matches(s, {q(gates.HEDGE)}) AND NOT {BACKBONE} THEN 'narrative|0.85|narrative_hedge' WHEN regexp_matches(s, {q(gates.HEDGE)}) THEN 'claim|0.75|narrative_hedge numeric_backbone'
 WHEN {BACKBONE} THEN 'claim|0.75|numeric_backbone' ELSE 'narrative|0.55|no_numeric_no_imperative' END"""
ROLES = f"roles AS (SELECT doc_id, chunk_id, stmt_idx, statement, {ROLE_SQL} AS r FROM (SELECT *, {strip('statement')} AS s FROM ({duck(STATEMENTS)})))"


def p1_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = gates.role(F.col("statement"))
    return sql(spark, sf_dir, STATEMENTS, "customer", "nation").withColumn("r", r).select("doc_id", "chunk_id", "stmt_idx", F.col("r.role").alias("role"), F.col("r.score").alias("score"), F.concat_ws(" ", "r.reasons").alias("reasons"))


def with_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, STATEMENTS, "customer", "nation").withColumn("role", gates.role(F.col("statement"))["role"])


def with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that can contradict others, with what the gates need of them."""
    return with_roles(spark, sf_dir).where(F.col("role").isin("claim", "definition")).withColumn("f", gates.features(F.col("statement")))


def pair_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose roles agree: roles are an equi-join key, so pairs of other roles are never built."""
    s = with_features(spark, sf_dir)
    a = s.select("doc_id", "chunk_id", "role", F.col("stmt_idx").alias("i"), F.col("statement").alias("a"), F.col("f").alias("fa"))
    b = s.select("chunk_id", "role", F.col("stmt_idx").alias("j"), F.col("statement").alias("b"), F.col("f").alias("fb"))
    return a.join(b, ["chunk_id", "role"]).where("i < j")


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of statements of a chunk with both roles, found per statement."""
    s = with_roles(spark, sf_dir)
    a = s.select("doc_id", "chunk_id", F.col("stmt_idx").alias("i"), F.col("statement").alias("a"), F.col("role").alias("role_a"))
    return a.join(s.select("chunk_id", F.col("stmt_idx").alias("j"), F.col("statement").alias("b"), F.col("role").alias("role_b")), "chunk_id").where("i < j")


def p4_role_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = gates.compatible(F.col("role_a"), F.col("role_b"))
    return all_pairs(spark, sf_dir).groupBy("doc_id", kept.alias("kept"), F.when(~kept, F.concat_ws(" ↔ ", "role_a", "role_b")).alias("reason")).agg(F.count("*").alias("n"))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.with_gate(pair_roles(spark, sf_dir))


def p11_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.coalesce(F.array_join(c, "/"), F.lit(""))
    return gated(spark, sf_dir).select(
        "chunk_id", "i", "j", "passed", F.array_join("signals", ",").alias("signals"), F.coalesce("neg_side", F.lit("")).alias("neg_side"), joined("antonym").alias("antonym"), joined("modal").alias("modal"),
        F.col("numeric.a").alias("num_a"), F.col("numeric.b").alias("num_b"), F.round("numeric.gap", 4).alias("gap"), joined("date").alias("date"),
    )


def _ladder(pairs: list[tuple[str, str]], test: str) -> str:
    arms = [f"WHEN {test.format(side='a', w=q(p))} AND {test.format(side='b', w=q(r))} THEN {q(p + '/' + r)}" for x, y in pairs for p, r in ((x, y), (y, x))]
    return "CASE " + " ".join(arms) + " ELSE '' END"


def _months(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({x}, {q(gates.MONTH)}), lambda m: lower(left(m, 3))))"


_CONTENT = f"list_distinct(list_filter(t{{0}}, lambda w: length(w) > 2 AND NOT list_contains([{lx.sql_list(lx.NEGATIONS + lx.FUNCTION_WORDS)}], w)))"
GATE_SQL = f"""{ROLES}, pairs AS (SELECT x.doc_id, x.chunk_id, x.stmt_idx AS i, y.stmt_idx AS j, x.statement AS a, y.statement AS b, string_split(x.r, '|')[1] AS role FROM roles x JOIN roles y ON x.chunk_id = y.chunk_id AND x.stmt_idx < y.stmt_idx AND string_split(x.r, '|')[1] = string_split(y.r, '|')[1] AND string_split(x.r, '|')[1] IN ('claim', 'definition')),
toks AS (SELECT *, list_transform(regexp_extract_all(a, '[A-Za-z'']+'), lambda t: lower(t)) AS ta, list_transform(regexp_extract_all(b, '[A-Za-z'']+'), lambda t: lower(t)) AS tb,
 list_filter(list_transform(regexp_extract_all(a, {q(gates.NUMBER_OR_PERCENT)}), lambda t: {_number_sql("t")}), lambda v: v <> 0) AS na, list_filter(list_transform(regexp_extract_all(b, {q(gates.NUMBER_OR_PERCENT)}), lambda t: {_number_sql("t")}), lambda v: v <> 0) AS nb,
 {_months("a")} AS ma, {_months("b")} AS mb FROM pairs),
sig AS (SELECT *, len(list_filter(ta, lambda w: list_contains([{lx.sql_list(lx.NEGATIONS)}], w))) > 0 AS neg_a, len(list_filter(tb, lambda w: list_contains([{lx.sql_list(lx.NEGATIONS)}], w))) > 0 AS neg_b, len(list_intersect({_CONTENT.format("a")}, {_CONTENT.format("b")})) AS shared,
 {_ladder(lx.ANTONYMS, "list_contains(t{side}, {w})")} AS antonym, {_ladder(lx.MODALS, "contains(lower({side}), {w})")} AS modal,
 CASE WHEN len(ma) > 0 AND len(mb) > 0 AND list_sort(ma) <> list_sort(mb) AND regexp_matches(a, {q(gates.DATE_CUE)}) AND regexp_matches(b, {q(gates.DATE_CUE)})
 THEN coalesce(list_min(list_filter(ma, lambda m: NOT list_contains(mb, m))), list_min(ma)) || '/' || coalesce(list_min(list_filter(mb, lambda m: NOT list_contains(ma, m))), list_min(mb)) ELSE '' END AS date FROM toks),
deltas AS (SELECT chunk_id, i, j, x, y, gap FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, i, j ORDER BY gap DESC, p, r) AS place FROM (
  SELECT chunk_id, i, j, na[p] AS x, nb[r] AS y, p, r, abs(na[p] - nb[r]) / greatest(abs(na[p]), abs(nb[r])) AS gap FROM sig, unnest(range(1, len(na) + 1)) AS u(p), unnest(range(1, len(nb) + 1)) AS v(r)
  WHERE shared >= 1 AND greatest(abs(na[p]), abs(nb[r])) / greatest(1e-9::DOUBLE, least(abs(na[p]), abs(nb[r]))) <= 10) WHERE gap > 0.03::DOUBLE) WHERE place = 1),
gate AS (SELECT s.*, d.x AS num_a, d.y AS num_b, d.gap, CASE WHEN neg_a <> neg_b AND shared >= 2 THEN CASE WHEN neg_a THEN 'a' ELSE 'b' END ELSE '' END AS neg_side FROM sig s LEFT JOIN deltas d USING (chunk_id, i, j)),
gated AS (SELECT *, array_to_string(list_filter([CASE WHEN neg_side <> '' THEN 'one_sided_negation' END, CASE WHEN antonym <> '' THEN 'antonym_pair' END, CASE WHEN modal <> '' THEN 'modal_flip' END, CASE WHEN num_a IS NOT NULL THEN 'numeric_delta' END, CASE WHEN date <> '' THEN 'date_conflict' END], lambda x: x IS NOT NULL), ',') AS signals FROM gate)"""


def p5_p15_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of statements of a chunk. Keywords and concepts are found once for each statement, which both sides read from one exchange."""
    own = sql(spark, sf_dir, STATEMENTS, "customer", "nation").select("chunk_id", "stmt_idx", "statement", tx.keywords(F.col("statement")).alias("keywords"), tx.concept_tokens(F.col("statement")).alias("concepts")).repartition("chunk_id")
    side = lambda x, place: own.select("chunk_id", F.col("stmt_idx").alias(place), F.col("statement").alias(x), F.col("keywords").alias(f"keywords_{x}"), F.col("concepts").alias(f"concepts_{x}"))
    pairs = side("a", "i").join(side("b", "j"), "chunk_id").where("i < j")
    common = lambda c: F.size(F.array_intersect(f"{c}_a", f"{c}_b")).alias(c)
    return pairs.select("chunk_id", "i", "j", common("keywords"), common("concepts"), gates.contradiction_type(F.col("a"), F.col("b")).alias("type"))


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


_DIG = r"list_sort(list_distinct(regexp_extract_all({0}, '\d+')))"
P5_SQL = rf"""SELECT chunk_id, i, j, len(list_intersect(list_distinct({KEYWORDS_SQL.format("a")}), list_distinct({KEYWORDS_SQL.format("b")})))::INTEGER AS keywords, len(list_intersect(list_distinct({CONCEPTS_SQL.format("a")}), list_distinct({CONCEPTS_SQL.format("b")})))::INTEGER AS concepts,
 CASE WHEN regexp_matches(c, '\d+[%$]?\s') AND len({_DIG.format("la")}) > 0 AND len({_DIG.format("lb")}) > 0 AND {_DIG.format("la")} <> {_DIG.format("lb")} THEN 'Numerical' WHEN {_any("c", gates.TEMPORAL)} THEN 'Temporal'
 WHEN {_any("la", gates.SCOPE)} AND {_any("lb", gates.SCOPE)} AND (contains(la, 'not ') OR contains(lb, 'not ') OR contains(c, 'prohibited') OR contains(c, 'never')) THEN 'Scope'
 WHEN {_any("c", gates.EXCEPTION)} THEN 'Exception-based' WHEN contains(c, 'when ') OR contains(c, 'provided ') THEN 'Conditional' ELSE 'Direct' END AS type
FROM (SELECT *, lower(a) AS la, lower(b) AS lb, lower(a) || ' ' || lower(b) AS c FROM ({duck(PAIRS)}))"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' statements, paired inside each document where they share keywords and one of them is negated, by severity.

    The keyword overlap is an equi-join on (document, keyword) and a count, not a product of statements.
    """
    from ..operators.pairs import lexical_conflicts

    return lexical_conflicts(spread(table(spark, sf_dir, "documents")))


FLAG_SQL = f"""WITH st AS ({{statements}}), kw AS (SELECT doc_id, stmt_idx, unnest(list_distinct({KEYWORDS_SQL.format("statement")})) AS k FROM st),
neg AS (SELECT doc_id, stmt_idx, len(list_filter(list_transform(regexp_extract_all(statement, '[A-Za-z'']+'), lambda t: lower(t)), lambda w: list_contains([{lx.sql_list(lx.NEGATIONS)}], w))) > 0 AS neg FROM st),
pairs AS (SELECT a.doc_id, a.stmt_idx AS i, b.stmt_idx AS j, count(*) AS n FROM kw a JOIN kw b ON a.doc_id = b.doc_id AND a.k = b.k JOIN neg na ON na.doc_id = a.doc_id AND na.stmt_idx = a.stmt_idx JOIN neg nb ON nb.doc_id = b.doc_id AND nb.stmt_idx = b.stmt_idx
 WHERE na.neg AND NOT nb.neg GROUP BY ALL HAVING count(*) >= 2),
conf AS (SELECT *, least(100, 50 + 10 * n) AS confidence FROM pairs)
SELECT CASE WHEN confidence >= 85 THEN 'High' WHEN confidence >= 70 THEN 'Medium' ELSE 'Low' END AS severity, count(*) AS n_pairs, count(DISTINCT doc_id) AS n_documents, max(n) AS most_shared FROM conf GROUP BY 1"""


def _flag_sql() -> str:
    from .text_queries import STATEMENTS_SQL

    return FLAG_SQL.replace("{statements}", STATEMENTS_SQL)


QUERIES = {"flagship_conflicts": flagship, "p1_p2_roles": p1_roles, "p3_p4_role_pairs": p4_role_pairs, "p6_p11_gate": p11_gate, "p5_p15_p16_overlap": p5_p15_overlap}
ORACLE_SQL = {
    "flagship_conflicts": _flag_sql(),
    "p1_p2_roles": f"WITH {ROLES} SELECT doc_id, chunk_id, stmt_idx, string_split(r, '|')[1] AS role, CAST(string_split(r, '|')[2] AS DOUBLE) AS score, string_split(r, '|')[3] AS reasons FROM roles",
    "p3_p4_role_pairs": f"WITH {ROLES}, p AS (SELECT x.doc_id, string_split(x.r, '|')[1] AS ra, string_split(y.r, '|')[1] AS rb FROM roles x JOIN roles y ON x.chunk_id = y.chunk_id AND x.stmt_idx < y.stmt_idx) SELECT doc_id, ra = rb AND ra IN ('claim', 'definition') AS kept, CASE WHEN NOT (ra = rb AND ra IN ('claim', 'definition')) THEN ra || ' ↔ ' || rb END AS reason, count(*) AS n FROM p GROUP BY ALL",
    "p6_p11_gate": f"WITH {GATE_SQL} SELECT chunk_id, i, j, signals <> '' AS passed, signals, neg_side, antonym, modal, num_a, num_b, round(gap, 4) AS gap, date FROM gated",
    "p5_p15_p16_overlap": P5_SQL,
}
