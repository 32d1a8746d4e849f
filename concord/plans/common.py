"""Inputs of the queries: the tables, and texts made from them by SQL that both engines run alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` (a plain scan) in at least as many partitions as there are cores.

    Regular expressions cost far more than reading, so a table of few row groups would keep most cores idle; a table of as many
    splits as cores, which any large one is, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


#: Tables from which texts are made or read.
SPREAD = ("customer", "orders", "part", "documents")


def sql(spark: SparkSession, sf_dir: str, query: str, *names: str) -> DataFrame:
    """``query`` over tables, given by name in braces."""
    return spark.sql(query.format(**{n: "{" + n + "}" for n in names}), **{n: spread(table(spark, sf_dir, n)) if n in SPREAD else table(spark, sf_dir, n) for n in names})


#: Pages of one document for each source, with a running header and page numbers.
PAGES = "SELECT source AS doc, doc_id AS page_no, concat('Plant Manual Page ', CAST(doc_id % 90 + 1 AS VARCHAR(9)), chr(10), text, chr(10), CAST(doc_id % 900 AS VARCHAR(9))) AS page_text FROM {documents}"
#: Documents whose sentences are paragraphs, every fifth with numbered headings; the last section holds all text from character 2,001 on.
WHOLE_PARAGRAPHS = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat('1. Intake ', substr(text, 1, 400), chr(10), '2. Storage ', substr(text, 401, 700), chr(10), '2.1 Release ', substr(text, 1101, 900), chr(10), '3 Review:', chr(10), replace(substr(text, 2001), '. ', concat('.', chr(10), chr(10))))
ELSE replace(text, '. ', concat('.', chr(10), chr(10))) END AS text FROM {documents}"""
#: Statements of all kinds that the rules know, made from customers; 24 to a chunk, 240 to a document.
STATEMENTS = """SELECT CAST(floor(c_custkey / 240) AS BIGINT) AS doc_id, CAST(floor(c_custkey / 24) AS BIGINT) AS chunk_id, c_custkey % 24 AS stmt_idx,
CASE c_custkey % 24
 WHEN 0 THEN concat('Public cloud adoption in ', n_name, ' reached ', CAST(20 + c_custkey % 61 AS VARCHAR(9)), '% of enterprises in 2023.')
 WHEN 1 THEN concat('Public cloud adoption in Europe reached ', CAST(20 + c_custkey % 53 AS VARCHAR(9)), '% of respondents in ', CAST(2021 + c_custkey % 3 AS VARCHAR(9)), '.')
 WHEN 2 THEN concat('Public cloud adoption in Europe reached ', CAST(20 + c_custkey % 47 AS VARCHAR(9)), '% of respondents in ', CAST(2021 + c_custkey % 3 AS VARCHAR(9)), '.')
 WHEN 3 THEN concat('Visitors must wear a badge inside plant ', CAST(c_custkey % 7 AS VARCHAR(9)), '.')
 WHEN 4 THEN concat('Visitors must not wear a badge inside plant ', CAST(c_custkey % 7 AS VARCHAR(9)), '.')
 WHEN 5 THEN concat('Plant output rose to ', CAST(100 + c_custkey % 31 AS VARCHAR(9)), ' tonnes and 35% of capacity.')
 WHEN 6 THEN concat('Plant output fell to ', CAST(90 + c_custkey % 17 AS VARCHAR(9)), ' tonnes and 35% of capacity.')
 WHEN 7 THEN concat('Regional revenue reached $', CAST(40 + c_custkey % 13 AS VARCHAR(9)), ' million in 2023.')
 WHEN 8 THEN concat('Regional revenue reached $', CAST(52 + c_custkey % 11 AS VARCHAR(9)), ' million in ', CAST(2022 + c_custkey % 2 AS VARCHAR(9)), '.')
 WHEN 9 THEN concat('The permit for ', n_name, ' must take effect in March.')
 WHEN 10 THEN concat('The permit for ', n_name, ' must take effect in June.')
 WHEN 11 THEN concat('Figure ', CAST(c_custkey % 9 AS VARCHAR(9)), ' shows the output of ', n_name, '.')
 WHEN 12 THEN concat('We recommend that ', n_name, ' invest in edge cloud sites.')
 WHEN 13 THEN concat('Survey of ', CAST(1000 + c_custkey AS VARCHAR(9)), ' enterprise respondents in ', n_name, '.')
 WHEN 14 THEN concat('Capacity is defined as the ', lower(c_mktsegment), ' share of ', n_name, '.')
 WHEN 15 THEN concat('In summary, ', n_name, ' represents a shift in demand.')
 WHEN 16 THEN concat('AWS holds 31%, followed by Azure at ', CAST(20 + c_custkey % 9 AS VARCHAR(9)), '% and Google Cloud at 11%.')
 WHEN 17 THEN concat('Collectively, AWS and Azure hold ', CAST(60 + c_custkey % 9 AS VARCHAR(9)), ' percent of global cloud spend.')
 WHEN 18 THEN concat('Access to sensitive data is prohibited for contractors in ', n_name, '.')
 WHEN 19 THEN concat('Access to sensitive data is allowed for contractors in ', n_name, '.')
 WHEN 20 THEN concat('Deployment takes at least ', CAST(2 + c_custkey % 7 AS VARCHAR(9)), ' months for ', n_name, '.')
 WHEN 21 THEN concat('All rights reserved by the ', lower(c_mktsegment), ' office.')
 WHEN 22 THEN concat('Managers may approve remote work unless audits are open in ', n_name, '.')
 ELSE concat('About ', CAST(1 + c_custkey % 5 AS VARCHAR(9)), ',', CAST(100 + c_custkey % 800 AS VARCHAR(9)), ' cloud-related roles stay unfilled, a ', CAST(c_custkey % 40 AS VARCHAR(9)), '.5 percent share.')
END AS statement
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""
#: Pairs of statements of a chunk.
PAIRS = f"WITH s AS ({STATEMENTS}) SELECT a.doc_id, a.chunk_id, a.stmt_idx AS i, b.stmt_idx AS j, a.statement AS a, b.statement AS b FROM s a JOIN s b ON a.chunk_id = b.chunk_id AND a.stmt_idx < b.stmt_idx"


def duck(query: str) -> str:
    """The query as DuckDB reads it: tables go by their plain names."""
    import re

    return re.sub(r"\{(\w+)\}", r"\1", query)
