"""Charts as chunks, their duplicates, and visual findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST_CHART_ID = 10001
MOST_POINTS, MOST_CHARTS = 15, 30


def _some(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def chart_text(page: str = "page_number") -> Column:
    """A text of a chart (title, type, axes, up to 15 points, trend, finding), one line each, absent ones left out."""
    axes = F.concat_ws(", ", F.when(_some("x_axis_label"), F.concat(F.lit("X-axis: "), "x_axis_label")), F.when(_some("y_axis_label"), F.concat(F.lit("Y-axis: "), "y_axis_label")))
    points = F.array_join(F.transform(F.slice("data_points", 1, MOST_POINTS), lambda p: F.concat(F.coalesce(p["label"], F.lit("?")), F.lit(": "), F.coalesce(p["value"], F.lit("?")))), "; ")
    return F.concat_ws(
        "\n", F.concat(F.lit("[CHART on Page "), F.col(page).cast("string"), F.lit("]")), F.when(_some("title"), F.concat(F.lit("Chart Title: "), "title")), F.concat(F.lit("Chart Type: "), "chart_type"), F.when(axes != "", F.concat(F.lit("Axes: "), axes)),
        F.when(F.size("data_points") > 0, F.concat(F.lit("Data Points: "), points)), F.when(_some("trends"), F.concat(F.lit("Trend: "), "trends")), F.when(_some("key_findings"), F.concat(F.lit("Key Finding: "), "key_findings")),
    )


def chart_chunks(charts: DataFrame) -> DataFrame:
    """Charts (doc_name, ord, page_number from 0, ...) as chunks with ids from 10001."""
    i = F.row_number().over(Window.partitionBy("doc_name").orderBy("ord"))
    df = charts.withColumn("i", i).withColumn("page", F.col("page_number") + 1)
    label = F.concat(F.lit("Chart-"), F.col("i").cast("string"), F.lit(" (p."), F.col("page").cast("string"), F.lit(")"))
    display = F.when(_some("title"), F.concat(F.lit("Chart-"), F.col("i").cast("string"), F.lit(": "), F.substring("title", 1, 35))).otherwise(label)
    heading = F.when(_some("title"), F.col("title")).otherwise(F.concat(F.lit("Chart on page "), F.col("page").cast("string")))
    return df.select("doc_name", (F.col("i") + FIRST_CHART_ID - 1).alias("id"), label.alias("label"), display.alias("display"), heading.alias("heading"), chart_text().alias("text"), F.lit(True).alias("is_chart"), "chart_type", F.col("page").alias("page_number"))


def without_duplicates(charts: DataFrame, least_overlap: float = 0.7) -> DataFrame:
    """Charts (doc_name, ord, page_number, chart_type, title, data_points, embedded) without embedded ones that repeat a kept one.

    Charts are compared in order, so only charts that stay can make a later one a duplicate: a fold over the charts of one page
    and type, which the source bounds (``MOST_CHARTS`` of a document).
    """
    row = F.struct("ord", F.lower(F.trim("title")).alias("title"), F.array_distinct(F.transform("data_points", lambda p: F.lower(F.coalesce(p["label"], F.lit(""))))).alias("labels"), "embedded")
    pages = charts.groupBy("doc_name", "page_number", "chart_type").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def same(a: Column, b: Column) -> Column:
        title = (F.coalesce(a["title"], F.lit("")) != "") & (a["title"] == b["title"])
        both = (F.size(a["labels"]) > 0) & (F.size(b["labels"]) > 0)
        overlap = F.size(F.array_intersect(a["labels"], b["labels"])) / F.greatest(F.lit(1), F.size(F.array_union(a["labels"], b["labels"])))
        return F.coalesce(title, F.lit(False)) | (both & (overlap > least_overlap))

    empty = F.filter("rows", lambda r: F.lit(False))
    kept = F.aggregate("rows", empty, lambda out, r: F.when(r["embedded"] & F.exists(out, lambda o: same(o, r)), out).otherwise(F.array_append(out, r)))
    return charts.join(pages.select("doc_name", F.explode(F.transform(kept, lambda r: r["ord"])).alias("ord")), ["doc_name", "ord"], "left_semi")


def first_charts(charts: DataFrame, pages: DataFrame, most: int = MOST_CHARTS) -> DataFrame:
    """At most ``most`` charts of a document, of pages (doc_name, page_number) on which the cheap scan saw any."""
    seen = charts.join(pages, ["doc_name", "page_number"], "left_semi")
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("doc_name").orderBy("ord"))).where(F.col("place") <= most).drop("place")


def related_text(hits: DataFrame) -> DataFrame:
    """Hits (chart_id, rank, label, is_chart) to the primary text of each chart and, if there are two texts, the others."""
    texts = hits.where(~F.col("is_chart"))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"])
    df = texts.groupBy("chart_id").agg(labels.alias("labels"))
    return df.select("chart_id", F.element_at("labels", 1).alias("primary"), F.slice("labels", 2, 100).alias("secondary"), (F.size("labels") >= 2).alias("multi_hop"))


def visual_records(findings: DataFrame, least_confidence: int = 60) -> DataFrame:
    """Findings (chart_id, multi_hop, v: what responses.visual gives) as records."""
    kept = findings.where(F.col("v").isNotNull() & (F.col("v.confidence") >= least_confidence))
    prefix = F.when(F.col("multi_hop"), "Multi-hop-Visual-").otherwise("Visual-")
    return kept.select("chart_id", F.concat(prefix, "v.type").alias("type"), "v.severity", "v.confidence", "v.chart_claim", "v.text_claim", "v.hop_chain", F.lit(True).alias("is_visual"), F.col("multi_hop").alias("is_multi_hop"))
