"""Pair pipeline: candidate pairs, scores, top lists, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as lx
from ..functions import text as tx
from . import chunking, gates


def lexical_conflicts(documents: DataFrame, least_shared: int = 2) -> DataFrame:
    """Pairs of a negated and an unnegated statement of a document that share keywords, counted by severity.

    Only statements of documents with a negation are exploded to keywords, and the pairing is an equi-join on keyword.
    """
    rows = chunking.statement_rows(documents, "doc_id").withColumn("negated", F.arrays_overlap(tx.polarity_tokens(F.col("statement")), F.lit(lx.NEGATIONS)))
    words = rows.select("doc_id", "stmt_idx", "negated", F.explode(F.array_distinct(tx.keywords(F.col("statement")))).alias("word"))
    a = words.where("negated").select("doc_id", "word", F.col("stmt_idx").alias("i"))
    b = words.where("not negated").select("doc_id", "word", F.col("stmt_idx").alias("j"))
    pairs = a.join(b, ["doc_id", "word"]).groupBy("doc_id", "i", "j").agg(F.count("*").alias("n")).where(F.col("n") >= least_shared)
    scored = pairs.withColumn("severity", gates.severity(F.least(F.lit(100), 50 + 10 * F.col("n"))))
    return scored.groupBy("severity").agg(F.count("*").alias("n_pairs"), F.countDistinct("doc_id").alias("n_documents"), F.max("n").alias("most_shared"))


def logit_score(c: Column, e: Column, n: Column) -> Column:
    """A1: p(contradiction) * (1 - p(neutral)) of a softmax over three logits."""
    top = F.greatest(c, e, n)
    pc, pe, pn = F.exp(c - top), F.exp(e - top), F.exp(n - top)
    return pc / (pc + pe + pn) * (1 - pn / (pc + pe + pn))


def top_candidates(scored: DataFrame, keys: list[str], order: list[str], threshold: float = 0.40, most: int = 10) -> DataFrame:
    """A2: the best candidates of each chunk that reach the threshold; ties by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), *order))
    return scored.where(F.col("score") >= threshold).withColumn("place", place).where(F.col("place") <= most)


def deduplicate(candidates: DataFrame, order: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """A3: one row per (document and) unordered pair of normalised statements (columns a, b), the best score, the first of equals."""
    ka, kb = tx.pair_key(F.col("a")), tx.pair_key(F.col("b"))
    keyed = candidates.withColumn("ka", F.least(ka, kb)).withColumn("kb", F.greatest(ka, kb))
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy(*within, "ka", "kb").orderBy(F.desc("score"), *order))).where("place = 1").drop("place", "ka", "kb")


def confidence(score: Column) -> Column:
    """A4: per cent, cut off."""
    return F.floor(score * 100).cast("int")


def one_per_section_pair(records: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """A5: of rows (ord, target, related, confidence, ...) the most confident of each unordered pair of sections, in the order in
    which the pairs were first seen; a section with itself counts as one pair."""
    other = F.regexp_replace("related", r" \(same section\)", "")
    w = Window.partitionBy(*within, F.least("target", other), F.greatest("target", other))
    best = F.row_number().over(w.orderBy(F.desc("confidence"), "ord"))
    return records.withColumn("first_seen", F.min("ord").over(w)).withColumn("place", best).where("place = 1").drop("place")


def append_new(records: DataFrame, numeric: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``records`` and those numeric rows whose (target, related) is not among them, in this direction only, each document (``within``)
    by itself. A record of a section with itself counts without its suffix."""
    taken = records.select(*within, "target", F.regexp_replace("related", r" \(same section\)", "").alias("related")).distinct()
    return records.unionByName(numeric.join(taken, [*within, "target", "related"], "left_anti"), allowMissingColumns=True)


def cross_pairs(statements: DataFrame, related: DataFrame, least_shared: int = 2) -> DataFrame:
    """Statements of a chunk with those of its related chunks, same role, enough shared keywords.

    ``statements``: doc_id, chunk_id, stmt_idx, role, statement, f (``gates.features``); ``related``: doc_id, chunk_id, other. Both joins are on equal keys.
    """
    a = statements.select("doc_id", "chunk_id", "role", F.col("stmt_idx").alias("i"), F.col("statement").alias("a"), F.col("f").alias("fa"))
    b = statements.select("doc_id", F.col("chunk_id").alias("other"), "role", F.col("stmt_idx").alias("j"), F.col("statement").alias("b"), F.col("f").alias("fb"))
    joined = related.join(a, ["doc_id", "chunk_id"]).join(b, ["doc_id", "other", "role"])
    return joined.where(F.size(F.array_intersect("fa.keywords", "fb.keywords")) >= least_shared)


def records(intra: DataFrame, cross: DataFrame, least_confidence: int = 60) -> DataFrame:
    """A2-A5 with P15-P17 over scored pairs (doc_id, chunk_id, other, i, j, a, b, score): the records of each document in order."""
    order = ["i", "other", "j"]
    tops = [deduplicate(top_candidates(x, ["doc_id", "chunk_id"], order), ["chunk_id", *order], ("doc_id",)).withColumn("is_cross", F.lit(c)) for x, c in ((intra, 0), (cross, 1))]
    both = tops[0].unionByName(tops[1]).withColumn("confidence", confidence(F.col("score")))
    kept = both.where((F.col("confidence") >= least_confidence) & (gates.shared_concepts(F.col("a"), F.col("b")) >= 2))
    kept = kept.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id", "is_cross", F.desc("score"), *order)))
    name = lambda c: F.concat(F.lit("Section "), F.col(c).cast("string"))
    related = F.when(F.col("is_cross") == 0, F.concat(name("chunk_id"), F.lit(" (same section)"))).otherwise(name("other"))
    full = kept.select("doc_id", "ord", name("chunk_id").alias("target"), related.alias("related"), "a", "b", "confidence", gates.severity(F.col("confidence")).alias("severity"), gates.contradiction_type(F.col("a"), F.col("b")).alias("type"))
    return one_per_section_pair(full, ("doc_id",))


def heatmap(rows: DataFrame) -> DataFrame:
    """The last confidence written to each (target, related)."""
    return rows.groupBy("doc_id", "target", "related").agg(F.max_by("confidence", "ord").alias("confidence"))


def clean_chunks(chunks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per document the number of chunks (doc_id, chunk_id) without any candidate."""
    return chunks.join(candidates.select("doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("clean"))


def top_by_confidence(rows: DataFrame, n: int = 3) -> DataFrame:
    """Each document's n most confident records, the first of equals."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "ord"))).where(F.col("place") <= n)
