"""Document filter: plain rules, then a log-likelihood ratio of hashed n-grams.

Every word and every pair of neighbouring words is hashed to ``BUCKETS``. Two multinomials over the buckets, one of
trusted documents and one of the whole corpus, give each n-gram the weight log(p_trusted / p_corpus); a document's
score is the mean weight of its n-grams, so length does not matter, and it is kept if that reaches ``THRESHOLD``. No
document is sampled: the same numbers decide on all.

The corpus counts cover all documents; each task adds its own up before the shuffle, and the driver receives
``BUCKETS`` numbers at most. Trusted are up to ``TRUSTED_DOCS`` documents with the label, those of smallest hash of
doc_id. Without any trusted document the ratio is 0 for all, and the plain rules alone decide.

Odd input: null texts count as empty (no words: failed); repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, batch_map, texts_of
from .docstats import Stats, stats, windows

BUCKETS = 1 << 14
TRUSTED_DOCS = 20_000
#: Nats per n-gram. Labelled clean documents of the test tables score above -0.05, labelled junk below -0.1 but for a few.
THRESHOLD = -0.06
#: N-grams per bucket, dealt out as in the corpus, that are added to the trusted counts.
SMOOTHING = 8.0
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def ngrams(s: Stats) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbouring words."""
    return (np.concatenate((s.hashes, windows(s.hashes, 2))) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def counted(documents: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRUSTED_DOCS) -> DataFrame:
    """(bucket, corpus, trusted): n-grams of all documents and of the trusted ones, in one pass over the texts."""
    key = F.col("doc_id").cast("long")
    trusted = labels.where(F.col(label) == 1).select(key.alias("q_id")).where(F.col("q_id").isNotNull()).distinct().orderBy(F.xxhash64("q_id"), "q_id").limit(most)
    rows = documents.select(key.alias("q_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(trusted.withColumn("trusted", F.lit(True))), "q_id", "left").select("text", F.coalesce("trusted", F.lit(False)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, is_trusted in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                own = np.bincount(ngrams(stats(text)), minlength=BUCKETS)
                counts[0] += own
                if is_trusted:
                    counts[1] += own
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "corpus", "trusted"])

    parts = rows.mapInArrow(run, "bucket int, corpus long, trusted long")
    return parts.groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted"))


def weights(counts: DataFrame) -> np.ndarray:
    """The weight of each bucket; 0 everywhere if nothing is trusted."""
    found = counts.toArrow()
    corpus, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = found["bucket"].to_numpy()
    corpus[at], trusted[at] = found["corpus"].to_numpy(), found["trusted"].to_numpy()
    if not trusted.sum():
        return np.zeros(BUCKETS)
    share = lambda x: (x + SMOOTHING * BUCKETS * corpus / corpus.sum()) / (x.sum() + SMOOTHING * BUCKETS)  # noqa: E731  smoothed towards the corpus
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log(share(trusted)) - np.log(corpus / corpus.sum())
    return np.where(corpus > 0, ratio, 0.0)


def judge(texts: list[str], weight: np.ndarray, threshold: float = THRESHOLD) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score of each text."""
    out = []
    for text in texts:
        s = stats(text)
        failed = s.n_words < LEAST_WORDS or 100 * s.n_repeat_words > MOST_REPEATED * s.n_words
        own = ngrams(s)
        llr = float(weight[own].mean()) if len(own) else 0.0
        out.append((s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, not failed and llr >= threshold, llr))
    return out


def rules(documents: DataFrame, weight: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document with its counts, the plain rules' verdict, the ratio (``llr``) and the final verdict."""
    bound_arrow_batches(documents.sparkSession)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = zip(*judge(texts_of(batch.column(1)), weight, threshold))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(found, kinds))], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batch_map(run), COLUMNS)


def kept(documents: DataFrame, weight: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that pass."""
    bound_arrow_batches(documents.sparkSession)
    at = documents.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([x[6] for x in judge(texts_of(batch.column(at)), weight, threshold)], pa.bool_()))

    return documents.mapInArrow(batch_map(run), documents.schema)
