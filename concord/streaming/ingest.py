"""An extension beyond the batch operators: documents that arrive as files, cut to statements as they come.

The step is narrow (no state, no shuffle), so any sink and trigger will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.chunking import statement_rows


def statements(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return statement_rows(spark.readStream.schema(schema).parquet(path), "doc_id")
