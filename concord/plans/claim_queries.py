"""Queries of claims, the precision gate and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims, gates, reconcile
from .common import PAIRS, STATEMENTS, duck, sql
from .gate_queries import GATE_SQL, all_pairs, pair_roles, q


def _values(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"({i}, {q(a)}, {q(b)})" for i, (a, b) in enumerate(pairs))


def _case(pairs: list[tuple[str, str]], test: str, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test.format(q(a))} THEN {q(b)}" for a, b in pairs) + f" ELSE {other} END"


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.claim_rows(sql(spark, sf_dir, STATEMENTS, "customer", "nation"), "chunk_id", "stmt_idx")


def x12_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir)


_TAIL = " ".join(f"WHEN regexp_matches(tail, {q(chr(92) + 'b' + claims._escaped(a) + chr(92) + 'b')}) THEN {q(b)}" for a, b in claims.UNITS)
_POPULATION = "''"
for _lit, _canon in claims.POPULATIONS:
    _POPULATION = f"(SELECT CASE WHEN contains(low, {q(_lit)}) AND {len(_lit)} > length(p) THEN {q(_canon)} ELSE p END FROM (SELECT {_POPULATION} AS p))"
_METRIC = _case(
    claims.METRICS,
    "contains(low, {0})",
    f"CASE WHEN unit = 'pct' THEN CASE WHEN {_any('low', ['run', 'use', 'deploy', 'adopt', 'operate'])} THEN 'adoption_rate' WHEN {_any('low', ['cite', 'name', 'report', 'concern'])} THEN 'citation_rate' WHEN {_any('low', ['share', 'of global', 'of the market'])} THEN 'share' ELSE 'percentage' END"
    f" WHEN unit IN ('USD_B', 'USD_T', 'USD_M', 'USD') THEN CASE WHEN {_any('low', ['save', 'saving'])} THEN 'cost_savings' WHEN {_any('low', ['revenue', 'sales'])} THEN 'revenue' ELSE 'market_size' END WHEN unit IN ('months', 'years') THEN 'duration' WHEN unit = 'pp' THEN 'percentage_point_gap' ELSE 'unknown' END",
)
CLAIMS_SQL = rf"""st AS ({duck(STATEMENTS)}), marked AS (SELECT chunk_id, stmt_idx, statement AS s, lower(statement) AS low, string_split(replace(regexp_replace(statement, {q(claims.AMOUNT)}, chr(1) || '\0' || chr(2), 'g'), chr(2), chr(1)), chr(1)) AS parts FROM st),
spans AS (SELECT chunk_id, stmt_idx, s, low, k AS ord, parts[2 * k + 2] AS raw, length(array_to_string(parts[1:2 * k + 1], '')) AS a, length(array_to_string(parts[1:2 * k + 2], '')) AS e FROM marked, unnest(range(0, len(parts) // 2)) AS r(k)),
nums AS (SELECT *, CAST(replace(regexp_extract(raw, {q(claims.AMOUNT)}, 2), ',', '') AS DOUBLE) * CASE WHEN regexp_extract(raw, {q(claims.AMOUNT)}, 1) = '' THEN 1 ELSE -1 END AS value, lower(regexp_extract(raw, {q(claims.AMOUNT)}, 3)) AS word,
 lower(substr(s, greatest(1, a - 19), least(20, a))) AS lft, lower(substr(s, e + 1, 20)) AS rgt, lower(substr(s, e + 1, 25)) AS tail, substr(low, 1, a) AS head, substr(low, e + 1) AS rest, substr(s, greatest(1, a - 59), e - greatest(0, a - 60)) AS win FROM spans WHERE NOT regexp_full_match(trim(raw), '(19|20)\d{{2}}')),
united AS (SELECT * FROM (SELECT *, coalesce({_case(claims.UNITS, "word = {0}")}, CASE WHEN {_any("lft", claims.NUMBER_CUES)} OR {_any("rgt", claims.NUMBER_CUES)} THEN CASE {_TAIL} END END) AS unit FROM nums) WHERE unit IS NOT NULL),
ent(eo, lit, canon) AS (VALUES {_values(claims.ENTITIES)}),
ents AS (SELECT chunk_id, stmt_idx, ord, max_by(canon, [CAST(1 - strpos(reverse(head), reverse(lit)) AS BIGINT), -eo]) FILTER (contains(head, lit)) AS prev, max(1 - strpos(reverse(head), reverse(lit))) FILTER (contains(head, lit)) AS prev_gap,
 min_by(canon, [CAST(strpos(rest, lit) AS BIGINT), eo]) FILTER (contains(rest, lit)) AS nxt, min(strpos(rest, lit) - 1) FILTER (contains(rest, lit)) AS next_gap, max_by(canon, [CAST(length(lit) AS BIGINT), -eo]) FILTER (contains(low, lit)) AS longest FROM united, ent GROUP BY ALL),
bound AS (SELECT u.*, CASE WHEN regexp_matches(win, {q(claims.AGGREGATE)}) THEN CASE WHEN {" + ".join(f"contains(low, {q(p)})::INT" for p in claims.PROVIDERS)} >= 2 THEN 'top3_hyperscalers' ELSE 'aggregate' END
 WHEN -prev_gap < 60 THEN prev WHEN next_gap < 25 THEN nxt ELSE coalesce(longest, '') END AS entity, {_METRIC} AS metric, {_POPULATION} AS population, TRY_CAST(regexp_extract(s, {q(claims.YEAR)}) AS INTEGER) AS year, {_case([(x, x) for x in claims.QUALIFIERS], "contains(low, {0})", "''")} AS qualifier FROM united u JOIN ents USING (chunk_id, stmt_idx, ord)),
claims AS (SELECT chunk_id, stmt_idx, ord::INTEGER AS ord, value, unit, metric, entity, population, year, qualifier, least(0.95::DOUBLE, 0.4::DOUBLE + CASE WHEN entity <> '' THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN metric <> 'unknown' THEN 0.2::DOUBLE ELSE 0 END + 0.15::DOUBLE + CASE WHEN population <> '' THEN 0.10::DOUBLE ELSE 0 END) AS confidence FROM bound)"""


def p12_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = claims.contradicting_claims(_rows(spark, sf_dir), "chunk_id")
    return found.select("chunk_id", "metric", "entity", "unit", "stmt_idx_a", "ord_a", "stmt_idx_b", "ord_b", F.round("gap", 6).alias("gap"), (F.col("gap") > 0.03).alias("contradict"))


COMPARED = """compared AS (SELECT a.chunk_id, a.metric, a.entity, a.unit, a.stmt_idx AS stmt_idx_a, a.ord AS ord_a, b.stmt_idx AS stmt_idx_b, b.ord AS ord_b, CASE WHEN a.value = 0 AND b.value = 0 THEN 0.0::DOUBLE ELSE abs(a.value - b.value) / greatest(abs(a.value), abs(b.value)) END AS g
 FROM claims a JOIN claims b ON a.chunk_id = b.chunk_id AND a.metric = b.metric AND a.entity = b.entity AND a.unit = b.unit AND a.stmt_idx < b.stmt_idx AND (a.year IS NULL OR b.year IS NULL OR a.year = b.year) AND (a.population = '' OR b.population = '' OR a.population = b.population))"""


def p14_precision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a chunk: roles on all, polarity gates only where the roles agree."""
    pairs = all_pairs(spark, sf_dir)
    agree = gates.compatible(F.col("role_a"), F.col("role_b"))
    kept = gates.with_gate(pair_roles(spark, sf_dir)).select("doc_id", "chunk_id", "i", "j", F.col("role").alias("role_a"), F.col("role").alias("role_b"), "passed")
    df = claims.precision_gate(kept, _rows(spark, sf_dir)).select("chunk_id", "i", "j", "keep", "stage", "reason", F.round("gap", 6).alias("gap"))
    rest = pairs.where(~agree).select("chunk_id", "i", "j", F.lit(False).alias("keep"), F.lit("role").alias("stage"), F.lit("role_mismatch").alias("reason"), F.lit(None).cast("double").alias("gap"))
    return df.unionByName(rest)


P14_SQL = f"""WITH {GATE_SQL}, {CLAIMS_SQL}, {COMPARED}, firsts AS (SELECT chunk_id, stmt_idx_a AS i, stmt_idx_b AS j, count(*) AS n, min_by(g, [CAST(ord_a AS BIGINT), ord_b]) FILTER (g > 0.03::DOUBLE) AS gap FROM compared GROUP BY ALL),
having_ AS (SELECT DISTINCT chunk_id, stmt_idx FROM claims), allpairs AS ({duck(PAIRS)})
SELECT p.chunk_id, p.i, p.j, CASE WHEN g.i IS NULL THEN false WHEN f.gap IS NOT NULL THEN true WHEN ha.stmt_idx IS NOT NULL AND hb.stmt_idx IS NOT NULL AND f.n IS NULL THEN false ELSE g.signals <> '' END AS keep,
 CASE WHEN g.i IS NULL THEN 'role' WHEN f.gap IS NOT NULL THEN 'claim' WHEN ha.stmt_idx IS NOT NULL AND hb.stmt_idx IS NOT NULL AND f.n IS NULL THEN 'claim' WHEN g.signals = '' THEN 'negation_gate' ELSE 'all_passed' END AS stage,
 CASE WHEN g.i IS NULL THEN 'role_mismatch' WHEN f.gap IS NOT NULL THEN 'claim_contradiction' WHEN ha.stmt_idx IS NOT NULL AND hb.stmt_idx IS NOT NULL AND f.n IS NULL THEN 'no_comparable_claims' WHEN g.signals = '' THEN 'no_polarity_signal' ELSE 'gates_passed' END AS reason,
 CASE WHEN g.i IS NOT NULL THEN round(f.gap, 6) END AS gap
FROM allpairs p LEFT JOIN gated g USING (chunk_id, i, j) LEFT JOIN firsts f ON f.chunk_id = p.chunk_id AND f.i = p.i AND f.j = p.j LEFT JOIN having_ ha ON ha.chunk_id = p.chunk_id AND ha.stmt_idx = p.i LEFT JOIN having_ hb ON hb.chunk_id = p.chunk_id AND hb.stmt_idx = p.j"""


def x18_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = claims.universe(sql(spark, sf_dir, STATEMENTS, "customer", "nation"), "doc_id", "statement")
    return found.select("doc_id", F.size("universe").alias("n"), F.aggregate("universe", F.lit(0.0), lambda t, v: t + v).alias("total"), F.element_at("universe", 1).alias("least"))


X18_SQL = f"""SELECT doc_id, count(*)::INTEGER AS n, sum(v) AS total, min(v) AS least FROM (SELECT DISTINCT doc_id, TRY_CAST(trim(regexp_replace(t, '[$%,]', '', 'g')) AS DOUBLE) AS v FROM (SELECT doc_id, unnest(regexp_extract_all(statement, {q(gates.NUMBER_OR_PERCENT)})) AS t FROM ({duck(STATEMENTS)})))
WHERE abs(v) >= 1 AND NOT (v BETWEEN 1900 AND 2099 AND v = floor(v)) GROUP BY doc_id"""

#: For each part: two numbers, and a universe of numbers around them.
NUMBERS = """SELECT p_partkey AS id, CAST(p_size * 10 + p_partkey % 7 AS DOUBLE) AS a, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size * 10 WHEN 1 THEN 20 + p_partkey % 50 WHEN 2 THEN p_size * 4 ELSE 3 + p_partkey % 40 END AS DOUBLE) AS b,
CAST(p_size * 6 AS DOUBLE) AS u1, CAST(p_partkey % 97 + 5 AS DOUBLE) AS u2, CAST(p_size * 3 AS DOUBLE) AS u3, CAST((p_partkey % 13) * 100 AS DOUBLE) AS u4, CAST(p_partkey % 11 AS DOUBLE) AS years FROM {part}"""


def m_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sql(spark, sf_dir, NUMBERS, "part").withColumn("u", F.array("u1", "u2", "u3", "u4"))
    a, b = F.col("a"), F.col("b")
    return df.select(
        "id", F.coalesce(reconcile.reconcile_pair(a, b, F.col("u")), F.lit("none")).alias("relation"), F.coalesce(F.array_join(F.transform(reconcile.parts_of(a, F.col("u")), lambda v: v.cast("int").cast("string")), "+"), F.lit("")).alias("parts"),
        reconcile.growth_matches(b, a, F.col("years"), F.lit(12.0)).alias("growth"), reconcile.delta_matches(b, a, F.col("u3")).alias("delta"), reconcile.close(a, b).alias("close"),
    )


def _close(a: str, b: str, relative: float = 0.03, absolute: float = 0.05) -> str:
    return f"(abs({a} - {b}) <= greatest({relative}::DOUBLE * greatest(abs({a}), abs({b})), {absolute}::DOUBLE))"


_MASKS = ", ".join(f"({i}, [{', '.join(str(x + 1) for x in s)}])" for i, s in enumerate(s for s in reconcile.subsets(5)))


def _parts(target: str, universe: str, name: str) -> str:
    cand = f"list_filter({universe}, lambda v: v > 0 AND v < {target} * 1.2::DOUBLE)[1:10]"
    return f"{name} AS (SELECT id, arg_min(p, m) AS p FROM (SELECT id, {target} AS t, m, list_transform(ix, lambda i: c[i]) AS p FROM (SELECT *, {cand} AS c FROM n) , masks WHERE list_max(ix) <= len(c)) WHERE {_close('list_sum(p)', 't')} GROUP BY id)"


def _share(part: str, percent: str) -> str:
    return f"({percent} > 0 AND w > 0 AND {percent} < 100 AND NOT ({part} < 100 AND {part} < {percent} * 5) AND {_close(f'w * ({percent} / 100.0::DOUBLE)', part)})"


M_SQL = f"""WITH masks(m, ix) AS (VALUES {_MASKS}), n AS (SELECT *, [u1, u2, u3, u4] AS u FROM ({duck(NUMBERS)})), {_parts("a", "list_append(u, b)", "sa")}, {_parts("b", "list_append(u, a)", "sb")}, {_parts("a", "u", "own")},
sh AS (SELECT id, bool_or({_share("a", "b")} OR {_share("b", "a")}) AS share FROM (SELECT id, a, b, unnest(u) AS w FROM n) GROUP BY id)
SELECT n.id, CASE WHEN {_close("a", "b", 0.02)} THEN 'rounding' WHEN list_contains(sa.p, b) THEN 'sum_of_parts_a_contains_b' WHEN list_contains(sb.p, a) THEN 'sum_of_parts_b_contains_a' WHEN share THEN 'share_of_whole' ELSE 'none' END AS relation,
 coalesce(array_to_string(list_transform(own.p, lambda v: CAST(CAST(v AS INTEGER) AS VARCHAR)), '+'), '') AS parts, a > 0 AND b > 0 AND years > 0 AND {_close("((pow(a / b, 1.0::DOUBLE / CASE WHEN years > 0 THEN years ELSE 1 END) - 1.0::DOUBLE) * 100.0::DOUBLE)", "12.0::DOUBLE", 0.05, 0.2)} AS growth, {_close("(a - b)", "u3")} AS delta, {_close("a", "b")} AS close
FROM n LEFT JOIN sa ON sa.id = n.id LEFT JOIN sb ON sb.id = n.id LEFT JOIN own ON own.id = n.id LEFT JOIN sh ON sh.id = n.id"""

QUERIES = {"x12_x17_claims": x12_claims, "p12_p13_j4_comparable": p12_comparable, "p14_precision_gate": p14_precision_gate, "x18_universe": x18_universe, "m1_m6_reconcile": m_reconcile}
ORACLE_SQL = {
    "x12_x17_claims": f"WITH {CLAIMS_SQL} SELECT * FROM claims",
    "p12_p13_j4_comparable": f"WITH {CLAIMS_SQL}, {COMPARED} SELECT * EXCLUDE (g), round(g, 6) AS gap, g > 0.03::DOUBLE AS contradict FROM compared",
    "p14_precision_gate": P14_SQL, "x18_universe": X18_SQL, "m1_m6_reconcile": M_SQL,
}
