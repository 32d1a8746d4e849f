"""Reports over contradiction records (A11-A19, S8, P21). Records: doc_name, ord, target, related, confidence, severity, type, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEVERITIES = ("High", "Medium", "Low")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.lit(list(SEVERITIES)), severity), F.lit(0)), F.lit(4))


def severity_counts(records: DataFrame) -> DataFrame:
    """All three severities for every document, absent ones with 0."""
    grid = records.select("doc_name").distinct().select("doc_name", F.explode(F.lit(list(SEVERITIES))).alias("severity"))
    counted = records.groupBy("doc_name", "severity").agg(F.count("*").alias("n"))
    return grid.join(counted, ["doc_name", "severity"], "left").fillna(0, ["n"])


def type_counts(records: DataFrame) -> DataFrame:
    """A12."""
    return records.groupBy("doc_name", "type").agg(F.count("*").alias("n"))


def confidence_histogram(records: DataFrame, width: int = 10) -> DataFrame:
    """Bins from 0 to 100; 100 falls into the last."""
    bin_ = F.least(F.lit(100 // width - 1), F.floor(F.col("confidence") / width)) * width
    return records.groupBy("doc_name", bin_.alias("bin")).agg(F.count("*").alias("n"))


def plain(related: Column) -> Column:
    return F.regexp_replace(related, r" \(same section\)", "")


def heatmap_matrix(records: DataFrame, sections: DataFrame, most: int = 30) -> DataFrame:
    """A symmetric matrix in long form over each document's first sections; the last record decides a cell."""
    first = sections.withColumn("place", F.row_number().over(Window.partitionBy("doc_name").orderBy("id"))).where(F.col("place") <= most).select("doc_name", "section")
    a = records.select("doc_name", F.col("target").alias("x"), plain(F.col("related")).alias("y"), "confidence", "ord")
    cells = a.unionByName(a.select("doc_name", F.col("y").alias("x"), F.col("x").alias("y"), "confidence", "ord")).groupBy("doc_name", "x", "y").agg(F.max_by("confidence", "ord").alias("confidence"))
    return cells.join(first.withColumnRenamed("section", "x"), ["doc_name", "x"], "left_semi").join(first.withColumnRenamed("section", "y"), ["doc_name", "y"], "left_semi")


def section_risk(records: DataFrame) -> DataFrame:
    """A15."""
    weight = 4 - F.least(F.lit(3), severity_rank(F.col("severity")))
    return records.groupBy("doc_name", "target").agg(F.bround(F.sum(weight * F.col("confidence") / 100), 2).alias("risk"))


def network(records: DataFrame, sections: DataFrame) -> DataFrame:
    """Edges between known sections, the last record's values, and how wide they are drawn."""
    known = sections.select("doc_name", F.col("section").alias("other"))
    own = records.withColumn("other", plain(F.col("related"))).join(known, ["doc_name", "other"], "left_semi")
    last = own.groupBy("doc_name", "target", "other").agg(F.max_by("confidence", "ord").alias("weight"), F.max_by("severity", "ord").alias("severity"))
    return last.withColumn("width", F.greatest(F.lit(1.0), F.col("weight") / 25))


def cross_modal(records: DataFrame) -> DataFrame:
    """Sections and charts of records as nodes with their kind and number of records."""
    ends = records.select("doc_name", F.col("target").alias("node")).unionByName(records.select("doc_name", plain(F.col("related")).alias("node")))
    kind = F.when(F.col("node").startswith("Chart-"), "chart").otherwise("text")
    return ends.groupBy("doc_name", "node").agg(F.count("*").alias("n")).withColumn("node_type", kind)


def run_statistics(chunks: DataFrame, top_k: int = 5) -> DataFrame:
    """Chunks (doc_name, text): number, mean length, retrievals, pairs."""
    n = F.count("*")
    return chunks.groupBy("doc_name").agg(n.alias("n"), F.floor(F.avg(F.length("text"))).alias("mean_length"), (n * top_k).alias("retrievals"), F.floor(n * (n - 1) / 2).alias("pairs"))


def ordered(records: DataFrame) -> DataFrame:
    """Places by severity, then confidence, then first seen."""
    return records.withColumn("place", F.row_number().over(Window.partitionBy("doc_name").orderBy(severity_rank(F.col("severity")), F.desc("confidence"), "ord")))


def filtered(records: DataFrame, severities: list[str], types: list[str]) -> DataFrame:
    """Empty lists filter nothing."""
    keep = (F.col("severity").isin(severities) if severities else F.lit(True)) & (F.col("type").isin(types) if types else F.lit(True))
    return records.where(keep)


def text_report(records: DataFrame) -> DataFrame:
    """One text per document, a line per record in A19's order."""
    line = F.format_string("%d. [%s] %s vs %s (%s, %d%%)", "place", "severity", "target", plain(F.col("related")), "type", "confidence")
    rows = ordered(records).withColumn("line", line)
    return rows.groupBy("doc_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("report"))
