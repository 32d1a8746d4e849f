"""Queries of the property graph (G*, X19, J8-J11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from .common import STATEMENTS, duck, sql
from .gate_queries import q

#: Writes of contradictions between sections: twenty sections to a document, two writes from each, some within one section.
WRITES = """SELECT concat('doc', CAST(floor(s_suppkey / 20) AS BIGINT)) AS doc_name, s_suppkey * 2 + w AS edge_ord, concat('Section ', s_suppkey % 20) AS src,
CASE WHEN w = 0 THEN concat('Section ', (s_suppkey * 7 + 3) % 20) WHEN s_suppkey % 5 = 0 THEN concat('Section ', s_suppkey % 20, ' (same section)') ELSE concat('Section ', (s_suppkey * 3 + 1) % 12) END AS dst,
60 + (s_suppkey * 13 + w * 7) % 40 AS confidence, CASE WHEN (s_suppkey + w) % 3 = 0 THEN 'High' WHEN (s_suppkey + w) % 3 = 1 THEN 'Medium' ELSE 'Low' END AS severity, CASE WHEN s_suppkey % 2 = 0 THEN 'Numerical' ELSE 'Direct' END AS type
FROM {supplier} CROSS JOIN (SELECT 0 AS w UNION ALL SELECT 1 AS w) AS t"""
SECTIONS = "SELECT DISTINCT concat('doc', CAST(floor(s_suppkey / 20) AS BIGINT)) AS doc_name, concat('Section ', s_suppkey % 20) AS section FROM {supplier}"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.last_written(sql(spark, sf_dir, WRITES, "supplier"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, SECTIONS, "supplier")


EDGES_SQL = f"""writes AS (SELECT doc_name, edge_ord, src, replace(dst, ' (same section)', '') AS dst, confidence, severity, type FROM ({duck(WRITES)})), edges AS (SELECT doc_name, src, dst, max(edge_ord) AS edge_ord, max_by(confidence, edge_ord) AS confidence, max_by(severity, edge_ord) AS severity, max_by(type, edge_ord) AS type FROM writes GROUP BY ALL),
sections AS ({duck(SECTIONS)}), ways AS (SELECT doc_name, src AS section, dst AS other, edge_ord, confidence, severity FROM edges UNION ALL SELECT doc_name, dst, src, edge_ord, confidence, severity FROM edges WHERE src <> dst)"""
WALKS_SQL = """walks AS (SELECT doc_name, src AS first, dst AS last, [src, dst] AS path, [edge_ord] AS used, [confidence] AS confs FROM edges {start} UNION ALL
 SELECT w.doc_name, w.first, e.dst, list_append(w.path, e.dst), list_append(w.used, e.edge_ord), list_append(w.confs, e.confidence) FROM walks w JOIN edges e ON e.doc_name = w.doc_name AND e.src = w.last WHERE len(w.used) < {most} AND NOT list_contains(w.used, e.edge_ord))"""


def _walks(most: int, start: str = "") -> str:
    return f"WITH RECURSIVE {EDGES_SQL}, " + WALKS_SQL.format(most=most, start=start)


def g3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.section_totals(sql(spark, sf_dir, WRITES, "supplier")).withColumn("types", F.array_join("types", ","))


def g13_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = sections(spark, sf_dir).where("section = 'Section 1'").select("doc_name", F.col("section").alias("first"))
    return graph.risk(edges(spark, sf_dir), starts)


def g17_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected(edges(spark, sf_dir))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, STATEMENTS, "customer", "nation")
    return rows.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"), F.concat(F.lit("Section "), (F.col("chunk_id") % 20).cast("string")).alias("src"), "statement", F.explode(graph.entities(F.col("statement"))).alias("entity"))


def x19_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).groupBy("doc_name", "src", "entity").agg(F.count("*").alias("n"))


def g7_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_clusters(_mentions(spark, sf_dir), edges(spark, sf_dir)).withColumn("samples", F.array_join("samples", "|"))


def g9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = sql(spark, sf_dir, STATEMENTS, "customer", "nation").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"))
    return graph.stats(sections(spark, sf_dir), statements, _mentions(spark, sf_dir), edges(spark, sf_dir))


def g15_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that lead from each document to the next, for all documents at once."""
    e = edges(spark, sf_dir).withColumn("other_doc", F.when(F.col("edge_ord") % 4 == 0, "doc1").otherwise(F.col("doc_name")))
    return graph.compare(e, "doc0", "doc1")


def g2_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of all statements, cut to 200 characters, back to the first statement that contains their first 80."""
    rows = sql(spark, sf_dir, STATEMENTS, "customer", "nation").withColumn("doc_name", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    quotes = rows.select("doc_name", (F.col("chunk_id") * 24 + F.col("stmt_idx")).alias("quote_id"), F.substring("statement", 1, 200).alias("quote"))
    return graph.resolve(quotes, rows.select("doc_name", "chunk_id", "stmt_idx", "statement")).select("doc_name", "quote_id", "chunk_id", "stmt_idx")


MENTIONS_SQL = f"mentions AS (SELECT 'doc' || doc_id AS doc_name, 'Section ' || (chunk_id % 20) AS src, statement, entity FROM (SELECT *, unnest(list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(statement), {q(p)}) THEN {q(n)} END' for p, n in graph.ENTITIES)}], lambda x: x IS NOT NULL)) AS entity FROM ({duck(STATEMENTS)})))"

QUERIES = {
    "g3_section_totals": g3_totals, "g4_last_written": edges, "g6_open_triangles": lambda s, d: graph.open_triangles(edges(s, d)), "g7_entity_clusters": g7_clusters, "g8_g17_nodes": lambda s, d: graph.nodes(sections(s, d), edges(s, d)), "g9_stats": g9_stats,
    "g10_chains": lambda s, d: graph.chains(edges(s, d)), "g11_loops": lambda s, d: graph.loops(edges(s, d)), "g12_hotspots": lambda s, d: graph.hotspots(edges(s, d)).withColumn("avg_confidence", F.round("avg_confidence", 6)), "g13_transitive_risk": g13_risk,
    "g14_summary": lambda s, d: graph.summary(sections(s, d), edges(s, d)), "g15_compare": g15_compare, "g16_documents": lambda s, d: sections(s, d).select("doc_name").distinct().where("doc_name != ''"), "g17_undirected": g17_edges, "x19_mentions": x19_mentions, "g2_j10_resolve_all": g2_resolve,
}
ORACLE_SQL = {
    "g3_section_totals": f"WITH {EDGES_SQL} SELECT doc_name, src, dst, count(*) AS n, max(confidence) / 100.0::DOUBLE AS max_score, string_agg(type, ',' ORDER BY edge_ord) AS types FROM writes GROUP BY ALL",
    "g4_last_written": f"WITH {EDGES_SQL} SELECT * FROM edges",
    "g6_open_triangles": f"WITH {EDGES_SQL} SELECT x.doc_name, x.src AS a, x.dst AS b, y.dst AS c, x.confidence AS ab, y.confidence AS bc FROM edges x JOIN edges y ON x.doc_name = y.doc_name AND x.dst = y.src WHERE x.src <> y.dst AND x.edge_ord <> y.edge_ord AND NOT EXISTS (SELECT 1 FROM edges z WHERE z.doc_name = x.doc_name AND ((z.src = x.src AND z.dst = y.dst) OR (z.src = y.dst AND z.dst = x.src)))",
    "g7_entity_clusters": f"WITH {EDGES_SQL}, {MENTIONS_SQL} SELECT doc_name, entity, count(*) AS n, array_to_string(list_sort(list_distinct(list(statement)))[1:3], '|') AS samples FROM mentions JOIN edges USING (doc_name, src) GROUP BY ALL",
    "g8_g17_nodes": f"WITH {EDGES_SQL} SELECT doc_name, section, count(DISTINCT edge_ord) AS degree, coalesce(max(CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 END), 0)::INTEGER AS worst, 14 + 6 * count(DISTINCT edge_ord) AS size FROM sections LEFT JOIN ways USING (doc_name, section) GROUP BY ALL",
    "g9_stats": f"""WITH {EDGES_SQL}, {MENTIONS_SQL}, c AS (SELECT doc_name, count(*) AS sections FROM sections GROUP BY 1) SELECT doc_name, sections, coalesce(s.n, 0) AS statements, coalesce(m.e, 0) AS entities, coalesce(m.n, 0) AS mention_edges, coalesce(x.n, 0) AS contradiction_edges
 FROM c LEFT JOIN (SELECT 'doc' || doc_id AS doc_name, count(*) AS n FROM ({duck(STATEMENTS)}) GROUP BY 1) s USING (doc_name) LEFT JOIN (SELECT doc_name, count(*) AS n, count(DISTINCT entity) AS e FROM mentions GROUP BY 1) m USING (doc_name) LEFT JOIN (SELECT doc_name, count(*) AS n FROM edges GROUP BY 1) x USING (doc_name)""",
    "g10_chains": f"{_walks(5)} SELECT * FROM (SELECT doc_name, array_to_string(path, '>') AS chain, len(used)::INTEGER AS depth, least(100, list_min(confs)) AS min_confidence, array_to_string(used, ',') AS edges, row_number() OVER (PARTITION BY doc_name ORDER BY len(used) DESC, least(100, list_min(confs)) DESC, array_to_string(path, '>'), array_to_string(used, ',')) AS place FROM walks WHERE len(used) >= 2 AND first <> last) WHERE place <= 30",
    "g11_loops": f"{_walks(6)} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY size, loop) AS place FROM (SELECT DISTINCT doc_name, array_to_string(path, '>') AS loop, len(used)::INTEGER AS size FROM walks WHERE len(used) >= 2 AND first = last)) WHERE place <= 10",
    "g12_hotspots": f"WITH {EDGES_SQL} SELECT * REPLACE (round(avg_confidence, 6) AS avg_confidence) FROM (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY degree DESC, section) AS place FROM (SELECT doc_name, section, count(*) AS degree, array_to_string(list_sort(list_distinct(list(other))), ',') AS conflicts_with, avg(confidence) AS avg_confidence FROM ways GROUP BY ALL)) WHERE place <= 10",
    "g13_transitive_risk": f"{_walks(4, chr(87) + 'HERE src = ' + chr(39) + 'Section 1' + chr(39))} SELECT doc_name, last AS section, len(used)::INTEGER AS hops, round(list_reduce(list_transform(confs, lambda c: c / 100.0::DOUBLE), lambda x, y: x * y) * pow(0.7::DOUBLE, len(used) - 1) * 100) AS propagation_score, array_to_string(path, '>') AS path FROM walks WHERE first <> last",
    "g14_summary": f"WITH {EDGES_SQL} SELECT doc_name, count(DISTINCT section) AS sections, count(DISTINCT edge_ord) AS edges, coalesce(round_even(avg(confidence), 1), 0.0::DOUBLE) AS avg_confidence FROM sections LEFT JOIN ways USING (doc_name, section) GROUP BY 1",
    "g15_compare": f"WITH {EDGES_SQL} SELECT src, dst, severity, confidence, type FROM edges WHERE doc_name = 'doc0' AND edge_ord % 4 = 0",
    "g16_documents": f"WITH {EDGES_SQL} SELECT DISTINCT doc_name FROM sections WHERE doc_name <> ''",
    "g17_undirected": f"WITH {EDGES_SQL} SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY doc_name, least(src, dst), greatest(src, dst) ORDER BY confidence DESC, edge_ord) AS place FROM edges) WHERE place = 1",
    "x19_mentions": f"WITH {MENTIONS_SQL} SELECT doc_name, src, entity, count(*) AS n FROM mentions GROUP BY ALL",
    "g2_j10_resolve_all": f"WITH s AS (SELECT 'doc' || doc_id AS doc_name, chunk_id, stmt_idx, statement FROM ({duck(STATEMENTS)})) SELECT doc_name, quote_id, chunk_id, stmt_idx FROM (SELECT a.doc_name, a.chunk_id * 24 + a.stmt_idx AS quote_id, b.chunk_id, b.stmt_idx, row_number() OVER (PARTITION BY a.doc_name, a.chunk_id, a.stmt_idx ORDER BY b.chunk_id, b.stmt_idx) AS place FROM s a JOIN s b ON a.doc_name = b.doc_name AND contains(b.statement, left(a.statement, 80))) WHERE place = 1",
}
