"""Pages to chunks to statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def running_lines(pages: DataFrame, least: int = 3, ratio: float = 0.30) -> DataFrame:
    """(doc, key) of lines that recur at the top or bottom of enough pages. ``pages``: doc, page_no, page_text."""
    lines = pages.select("doc", "page_no", F.posexplode(F.split("page_text", "\n")).alias("i", "line")).where(F.col("line").rlike(r"\S"))
    place = Window.partitionBy("doc", "page_no")
    edge = lines.withColumn("top", F.row_number().over(place.orderBy("i"))).withColumn("bottom", F.row_number().over(place.orderBy(F.desc("i")))).where("top <= 3 or bottom <= 3")
    keys = edge.select("doc", "page_no", tx.normalise_line(F.col("line")).alias("key")).where(F.length("key").between(3, 120)).distinct()
    size = pages.groupBy("doc").agg(F.count("*").alias("n_pages"))
    counted = keys.groupBy("doc", "key").agg(F.count("*").alias("n")).join(size, "doc")
    return counted.where((F.col("n_pages") >= least) & (F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("n_pages") * ratio)))).select("doc", "key", "n")


def strip_pages(pages: DataFrame) -> DataFrame:
    """Pages without running lines and page-number lines; blank lines stay."""
    lines = pages.select("doc", "page_no", F.posexplode(F.split("page_text", "\n")).alias("i", "line")).withColumn("key", tx.normalise_line(F.col("line")))
    running = running_lines(pages).select("doc", "key", F.lit(True).alias("running"))
    kept = lines.join(running, ["doc", "key"], "left").where(F.col("running").isNull() & ~F.col("line").rlike(tx.NOISE_LINE))
    joined = kept.groupBy("doc", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("page_text"))
    return pages.select("doc", "page_no").join(joined, ["doc", "page_no"], "left").select("doc", "page_no", F.coalesce("page_text", F.lit("")).alias("page_text"))


def unify_breaks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n{3,}", "\n\n")


def fold_paragraphs(text: Column, least: int, most: int, separator: str) -> Column:
    """T6 and T7's fold: paragraphs gather in a buffer while its length plus the next one's (separator not counted) is within
    ``most``; a full buffer below ``least`` is dropped; a longer paragraph stays whole."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), tx.strip), lambda p: p != "")
    start = F.struct(F.lit("").alias("buffer"), F.array().cast("array<string>").alias("out"))

    def flushed(acc: Column) -> Column:
        return F.when(F.length(acc["buffer"]) >= least, F.array_append(acc["out"], acc["buffer"])).otherwise(acc["out"])

    def step(acc: Column, p: Column) -> Column:
        longer = F.struct(tx.strip(F.concat(acc["buffer"], F.lit(separator), p)).alias("buffer"), acc["out"].alias("out"))
        full = F.struct(p.alias("buffer"), flushed(acc).alias("out"))
        return F.when(F.length(acc["buffer"]) + F.length(p) <= most, longer).otherwise(full)

    return F.aggregate(paragraphs, start, step, flushed)


def heading_chunks(text: Column, most: int = 1000) -> Column:
    """T5: parts that begin with numbered headings; an empty list if there are fewer than three chunks."""
    parts = F.filter(F.transform(F.split(unify_breaks(text), r"\n(?=\d+[.\d]*\s+[A-Z])"), tx.strip), lambda p: p != "")
    nested = F.transform(parts, lambda p: F.when(F.length(p) > most, fold_paragraphs(p, 80, most, "\n")).otherwise(F.when(F.length(p) >= 40, F.array(p)).otherwise(F.array().cast("array<string>"))))
    chunks = F.flatten(nested)
    return F.when(F.size(chunks) >= 3, chunks).otherwise(F.array().cast("array<string>"))


def chunk(documents: DataFrame, least: int = 150, most: int = 1000, overlap: int = 200) -> DataFrame:
    """T5 with T7 as its fallback: (doc_id, ord, text), ord from 0. ``documents``: doc_id, text."""
    df = documents.select("doc_id", F.col("text").alias("whole")).withColumn("headed", heading_chunks(F.col("whole")))
    df = df.withColumn("raw", F.when(F.size("headed") > 0, F.col("headed")).otherwise(fold_paragraphs(unify_breaks(F.col("whole")), least, most, " ")))
    tail = lambda s: tx.strip(F.substring(s, F.greatest(F.lit(1), F.length(s) - overlap + 1), F.lit(overlap)))
    lapped = F.transform("raw", lambda c, i: F.when(i == 0, c).otherwise(F.concat(tail(F.get("raw", i - 1)), F.lit(" … "), c)))
    return df.select("doc_id", F.posexplode(F.when(F.size("headed") > 0, F.col("raw")).otherwise(lapped)).alias("ord", "text"))


def label(chunks: DataFrame, drop_low_information: bool = True) -> DataFrame:
    """Dense ids after T8, labels, headings. Rows (doc_id, id, label, display, heading, text)."""
    kept = chunks.where(~tx.low_information(F.col("text"))) if drop_low_information else chunks
    kept = kept.withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).withColumn("found", tx.heading(F.col("text")))
    name = F.concat(F.lit("Section "), F.col("id").cast("string"))
    display = F.when(F.col("found").isNotNull(), F.concat(name, F.lit(": "), F.substring("found", 1, 40))).otherwise(name)
    return kept.select("doc_id", "id", name.alias("label"), display.alias("display"), F.coalesce("found", name).alias("heading"), "text")


def statement_rows(chunks: DataFrame, *keys: str) -> DataFrame:
    """T10 as rows: keys, stmt_idx, statement."""
    return chunks.select(*keys, F.posexplode(tx.statements(F.col("text"))).alias("stmt_idx", "statement"))
