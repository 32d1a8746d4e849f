"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..operators import retrieval
from .common import spread, table

SYSTEM = "Answer from the given sections only."
#: Queries of which the terms are broadcast together.
BATCH = 2500


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    return v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("e").alias("q")), v


def r2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(*_vectors(spark, sf_dir), 5).select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def r3_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for each benchmark passage."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    scores = retrieval.normalised(retrieval.bm25(queries, spread(table(spark, sf_dir, "documents")), "doc_id", "text")).withColumn("bm25", F.round("bm25", 6))
    place = F.row_number().over(retrieval.Window.partitionBy("query_id").orderBy(F.desc("bm25"), "doc_id"))
    return scores.withColumn("rank", place).where("rank <= 5").select("query_id", "rank", "doc_id", "bm25")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, vectors = _vectors(spark, sf_dir)
    texts = spread(table(spark, sf_dir, "documents")).join(vectors, F.col("doc_id") == F.col("id")).select("id", "text", "e")
    asked = queries.join(texts, F.col("query_id") == F.col("id"))
    asked = asked.select("query_id", F.col("text").alias("query_text"), "q")
    most = vectors.agg(F.max(F.size("e")).alias("width"), F.count_if(F.col("id") % 50 == 0).alias("n")).first()
    return retrieval.hybrid(asked, texts, 5, max(most["width"] or 0, 0), max(1, -(-most["n"] // BATCH)))


def r6_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("query_id", "rank", "id", F.round("dense", 6).alias("dense"), F.round("bm25", 6).alias("bm25"))


def r8_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.broadcast(_hybrid(spark, sf_dir)).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")), "id")
    hits = hits.select("query_id", "rank", F.concat(F.lit("Section "), F.col("id").cast("string")).alias("label"), F.col("t").alias("text"))
    return retrieval.answer_context(hits).select("query_id", F.md5("context").alias("digest"), F.array_join("sources", ",").alias("sources"))


def r9_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.message_list(table(spark, sf_dir, "conversations"), SYSTEM)


_TOKENS = rf"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: length(t) > 1 AND NOT list_contains([{lx.sql_list(lx.BM25_STOPWORDS)}], t))"


def _bm25_sql(texts: str, queries: str) -> str:
    return f"""dtok AS (SELECT id, {_TOKENS} AS w FROM {texts}), sz AS (SELECT count(*) AS n, avg(len(w)) AS mean_length FROM dtok), post AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS term FROM dtok) GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post, sz GROUP BY term, n), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qtok AS (SELECT query_id, term, count(*) AS times FROM (SELECT id AS query_id, unnest({_TOKENS}) AS term FROM {queries}) GROUP BY ALL),
lex AS (SELECT query_id, id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))) AS score FROM post JOIN idf USING (term) JOIN qtok USING (term), sz GROUP BY ALL),
norm AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE score END AS bm25 FROM lex)"""


_HYBRID = f"""texts AS (SELECT doc_id AS id, text, CAST(embedding AS DOUBLE[]) AS e FROM documents JOIN embeddings ON doc_id = vec_id), asked AS (SELECT * FROM texts WHERE id % 50 = 0), {_bm25_sql("texts", "asked")},
dense AS (SELECT q.id AS query_id, t.id, (count(*) OVER (PARTITION BY q.id) - (row_number() OVER (PARTITION BY q.id ORDER BY sqrt(list_sum(list_transform(list_zip(q.e, t.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), t.id) - 1)) / count(*) OVER (PARTITION BY q.id) AS dense FROM asked q, texts t),
hyb AS (SELECT query_id, id, dense, coalesce(bm25, 0) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY 0.5::DOUBLE * dense + 0.5::DOUBLE * coalesce(bm25, 0) DESC, id) AS rank FROM dense LEFT JOIN norm USING (query_id, id) WHERE id <> query_id)"""

QUERIES = {"r2_nearest": r2_nearest, "r3_r4_r7_bm25": r3_bm25, "r5_r6_hybrid": r6_hybrid, "r8_context": r8_context, "r9_messages": r9_messages}
ORACLE_SQL = {
    "r2_nearest": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT q.id AS query_id, v.id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM v q, v WHERE q.id % 50 = 0 AND v.id <> q.id)
SELECT query_id, rank::INTEGER AS rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 5""",
    "r3_r4_r7_bm25": f"WITH docs AS (SELECT doc_id AS id, text FROM documents), items AS (SELECT item_id AS id, text FROM benchmark), {_bm25_sql('docs', 'items')}, r AS (SELECT query_id, id AS doc_id, round(bm25, 6) AS bm25 FROM norm) SELECT query_id, rank::INTEGER AS rank, doc_id, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM r) WHERE rank <= 5",
    "r5_r6_hybrid": f"WITH {_HYBRID} SELECT query_id, rank::INTEGER AS rank, id, round(dense, 6) AS dense, round(bm25, 6) AS bm25 FROM hyb WHERE rank <= 5",
    "r8_context": f"WITH {_HYBRID} SELECT query_id, md5(string_agg('[Section ' || id || ']:' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest, string_agg('Section ' || id, ',' ORDER BY rank) AS sources FROM hyb JOIN (SELECT id, text FROM texts) USING (id) WHERE rank <= 5 GROUP BY query_id",
    "r9_messages": f"SELECT DISTINCT conv_id, 0::BIGINT AS position, 'system' AS role, '{SYSTEM}' AS text FROM conversations UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn), role, text FROM conversations",
}
