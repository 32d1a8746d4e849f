"""The chunk store: versioned Parquet by document (S4-S6), and reads that degrade to empty."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_VERSION = "8"


def doc_key(doc_name: Column) -> Column:
    """The document's key in the store."""
    return F.concat(F.lit("doc_"), F.substring(F.md5(doc_name), 1, 12))


def write_chunks(chunks: DataFrame, path: str, version: str = CHUNK_VERSION) -> None:
    """Replaces exactly the documents that are in ``chunks`` (column doc_name); others stay."""
    df = chunks.withColumn("doc_key", doc_key(F.col("doc_name"))).withColumn("chunk_version", F.lit(version))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_key").parquet(path)


def read_chunks(spark: SparkSession, path: str, doc_name: str | None = None, version: str = CHUNK_VERSION) -> DataFrame | None:
    """Chunks of the current version in order; None where there is no store, no chunk of the document, or an older version."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    if doc_name is not None:
        df = df.where(F.col("doc_key") == doc_key(F.lit(doc_name)))
    df = df.where(F.col("chunk_version") == version)
    return None if df.isEmpty() else df.orderBy("doc_name", "id")


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """S6, G16."""
    return spark.read.parquet(path).select("doc_name").distinct().where("doc_name != ''").orderBy("doc_name")


def delete_document(spark: SparkSession, path: str, doc_name: str) -> bool:
    """Removes the document's partition; False if there is none."""
    key = spark.range(1).select(doc_key(F.lit(doc_name))).first()[0]
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/doc_key={key}")
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    """What a source that cannot be reached stands for."""
    return spark.createDataFrame([], schema)
