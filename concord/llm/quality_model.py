"""Document quality by histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver from the statistics (``FEATURES`` numbers each) of at most ``TRAIN_DOCS`` labelled
documents, those of smallest hash of doc_id; scoring traverses the flattened trees in numpy, over every whole
text. Labels, lang, source and doc_id are no features.

Odd input: null texts count as empty; empty texts get a score like any other; labels that are null or not 0 or 1 are
not learnt from; without any usable label every score is one half; repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import batch_map, bound_arrow_batches, texts_of
from .docstats import SPACE, SYMBOL_BYTES, Stats, stats

TRAIN_DOCS = 20_000
HELD_OUT = (5, 0)
THRESHOLD = 0.3
PUNCTUATION = np.frombuffer(b"!?;:,.", np.uint8)
FEATURES = (
    "log_words", "mean_word", "symbols_per_word", "pipes_per_word", "bang_per_word", "stops_per_word", "digits_per_char", "upper_per_letter", "words_per_line", "dup_line_share", "repeat_word_share",
    "distinct_word_share", "top_word_share", "adjacent_equal_share", "last_byte_symbol_share", "longest_word", "space_share", "other_ascii_share", "high_byte_share", "byte_entropy", "capital_word_share", "short_word_share", "log_lines",
)


def features(text: str) -> list[float]:
    s: Stats = stats(text)
    n, counts = max(1, s.n_words), s.bytes_.astype(float)
    total = max(1.0, counts.sum())
    lengths = np.fromiter(map(len, s.words), np.int64, s.n_words) if s.words else np.zeros(1, np.int64)
    last = np.frombuffer(b"".join([w[-1:] for w in s.words]), np.uint8)
    first = np.frombuffer(b"".join([w[:1] for w in s.words]), np.uint8)
    _, per_word = np.unique(s.hashes, return_counts=True) if s.words else (None, np.zeros(1))
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    share = counts[counts > 0] / total
    word_bytes = max(1.0, float(lengths.sum()))
    return [
        float(np.log1p(s.n_words)), float(lengths.mean()), s.n_symbols / n, counts[ord("|")] / n, counts[ord("!")] / n, counts[PUNCTUATION].sum() / n, counts[48:58].sum() / word_bytes, upper / max(1.0, upper + lower), n / max(1, s.n_lines), s.n_dup_lines / max(1, s.n_lines), s.n_repeat_words / n,
        len(per_word) / n, float(per_word.max()) / n, float((s.hashes[1:] == s.hashes[:-1]).mean()) if s.n_words > 1 else 0.0, float(np.isin(last, SYMBOL_BYTES).mean()) if s.words else 0.0, float(lengths.max()), counts[SPACE].sum() / total, (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / word_bytes, counts[128:].sum() / total, float(-(share * np.log(share)).sum()), float(((first >= 65) & (first < 91)).mean()) if s.words else 0.0, float((lengths <= 2).mean()), float(np.log1p(s.n_lines)),
    ]


def labelled(documents: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int], most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents outside the held-out part; the labels' side is broadcast, as it is bounded.

    Of rows with one doc_id that with the smallest text counts.
    """
    key = F.col("doc_id").cast("long")
    part = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(held_out[0]))
    own = labels.select(key.alias("q_id"), F.col(label).cast("int").alias("q_label"), part.alias("q_part")).where(F.col("q_id").isNotNull() & F.col("q_label").isin(0, 1))
    if held_out[0] > 1:
        own = own.where(F.col("q_part") != held_out[1])
    own = own.groupBy("q_id").agg(F.max("q_label").alias("q_label")).orderBy(F.xxhash64("q_id"), "q_id").limit(most)
    return documents.select(key.alias("q_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "q_id").groupBy("q_id").agg(F.min("text").alias("text"), F.first("q_label").alias("q_label")).select("text", "q_label")


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCS, held_out: tuple[int, int] = HELD_OUT) -> gbt.Trees:
    bound_arrow_batches(documents.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([features(t) for t in texts_of(batch.column(0))], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = labelled(documents, labels, label, held_out, most).mapInArrow(batch_map(run), "x array<double>, y int").toArrow()
    if not rows.num_rows:
        return gbt.fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(rows["x"].to_pylist())
    y = rows["y"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # sums in floating point then do not depend on the order of partitions
    return gbt.fit(x[order], y[order])


def score(documents: DataFrame, model: gbt.Trees, threshold: float = THRESHOLD, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    bound_arrow_batches(documents.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.probability(np.array([features(t) for t in texts_of(batch.column(1))]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(held_out[0])) == held_out[1]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(part, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(batch_map(run), "doc_id long, held_out boolean, score double, predicted int")
