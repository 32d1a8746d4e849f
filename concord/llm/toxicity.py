"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its distinct words (letters only, lower-cased) and the distinct beginnings of 4 and 5 letters of its words,
hashed to ``BUCKETS``. The score of a set of terms x is

    sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so pairs of terms (an insult with a group mention) count beyond their own weights. The machine has the terms that are
associated with the label in the training rows, by themselves (chi-square) or in the company of another term (chi-square within the
documents that hold one of the terms that go with label 1 by themselves, as Mantel and Haenszel combine it): a term that means something only in a pair is no worse
off than one that always does. Their number has no cap but ``BUCKETS``. The machine is fitted on the driver by AdaGrad from at most ``TRAIN_DOCS``
labelled documents, those of smallest hash of doc_id. Labels, lang, source and doc_id are no inputs. Equal sets of terms with
equal labels are learnt from once, as a text that was copied a thousand times is one piece of evidence.

Odd input: null texts count as empty and get the score of no terms; labels that are null or not 0 or 1 are not learnt from;
without usable labels every score is one half; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_map, bound_arrow_batches, texts_of
from .quality_model import labelled

BUCKETS = 1 << 18
TRAIN_DOCS = 20_000
RANK = 8
EPOCHS = 60
BATCH = 256
DROPOUT = 0.5
HELD_OUT = (3, 1)
THRESHOLD = 0.7
#: A chosen term is in this many training documents at least (fewer where under 100 are toxic).
LEAST_DOCS = 5
#: The chi-square it reaches by itself: this share of the training documents, within bounds.
CHI2_SHARE, CHI2_BOUNDS = 1 / 80, (15.0, 100.0)
#: The one it reaches in company.
PAIR_CHI2 = 10.0
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)


@lru_cache(maxsize=200_000)
def term_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a lower-cased word and its beginnings."""
    digest = xxhash.xxh3_64_intdigest
    return tuple({digest(t) % BUCKETS for t in (word, *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k))})


def buckets(text: str) -> set[int]:
    found: set[int] = set()
    for word in set(WORD.findall(text.lower())):
        found.update(term_buckets(word))
    return found


@dataclass(frozen=True)
class Machine:
    bias: float
    weight: np.ndarray  # (terms)
    factor: np.ndarray  # (terms, rank)

    def margin(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of sets of terms: ``ids`` holds set after set, ``ends`` where each ends."""
        sums = segment_sums(np.column_stack((self.weight[ids], self.factor[ids], self.factor[ids] ** 2)), ends)
        rank = self.factor.shape[1]
        return self.bias + sums[:, 0] + 0.5 * (sums[:, 1 : 1 + rank] ** 2 - sums[:, 1 + rank :]).sum(1)


def segment_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; a run may be empty."""
    total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, 0)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(sets: list[list[int]], y: np.ndarray, terms: int, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.3, l2: float = 2e-4) -> Machine:
    """AdaGrad on the logistic loss; fixed seed and order, so the same rows give the same machine.

    The bias stays the prior log-odds, and each step drops terms at random, so that the machine doesn't come to need
    several toxic terms at once where most toxic texts have several.
    """
    rng = np.random.default_rng(7)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias, weight, factor = float(np.log(share / (1 - share))), np.zeros(terms), rng.normal(0, 0.01, (terms, rank))
    if not len(y) or not 0 < y.sum() < len(y):
        return Machine(bias, weight, np.zeros((terms, rank)))
    gw, gf = np.full(terms, 1e-8), np.full((terms, rank), 1e-8)
    lengths = np.array([len(s) for s in sets])
    flat, stops = np.array([i for s in sets for i in s], np.int64), np.cumsum(lengths)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            n, ends = lengths[rows], np.cumsum(lengths[rows])
            ids = flat[np.repeat(stops[rows] - n, n) + np.arange(n.sum()) - np.repeat(ends - n, n)]
            stay = rng.random(len(ids)) >= DROPOUT
            n = np.bincount(np.repeat(np.arange(len(rows)), n)[stay], minlength=len(rows))
            ids, ends = ids[stay], np.cumsum(n)
            own = factor[ids]
            sums = segment_sums(np.column_stack((weight[ids], own, own**2)), ends)
            p = sigmoid(bias + sums[:, 0] + 0.5 * (sums[:, 1 : 1 + rank] ** 2 - sums[:, 1 + rank :]).sum(1))
            error = p - y[rows]
            of_term = np.repeat(error, n)
            dw = np.bincount(ids, of_term, terms) / len(rows) + l2 * weight
            pull = of_term[:, None] * (np.repeat(sums[:, 1 : 1 + rank], n, axis=0) - own)
            df = np.stack([np.bincount(ids, pull[:, f], terms) for f in range(rank)], 1) / len(rows) + l2 * factor
            gw, gf = gw + dw**2, gf + df**2
            weight -= rate * dw / np.sqrt(gw)
            factor -= 0.3 * rate * df / np.sqrt(gf)
    return Machine(bias, weight, factor)


def chosen_terms(ids: np.ndarray, lengths: np.ndarray, y: np.ndarray, size: int = BUCKETS) -> np.ndarray:
    """Terms (ascending) that are associated with label 1, by themselves or in company; ``ids`` holds set after set."""
    rows, n, ones = np.repeat(np.arange(len(y)), lengths), float(len(y)), float(y.sum())
    m, k = np.bincount(ids, minlength=size).astype(float), np.bincount(ids, y[rows], size)
    usual = (m >= min(LEAST_DOCS, max(2, ones // 20))) & (m < n)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.where(usual, n * (k * (n - ones) - (m - k) * ones) ** 2 / (m * (n - m) * ones * (n - ones)), 0.0)
    alone = chi2 >= min(max(CHI2_SHARE * n, CHI2_BOUNDS[0]), CHI2_BOUNDS[1])
    toxic = np.flatnonzero(alone & (k * n > ones * m))
    excess, variance = np.zeros(size), np.zeros(size)
    # Each document counts with the strongest of its terms alone, so all terms together read each document once.
    strength = np.full(size, len(toxic), np.int32)
    strength[toxic[np.argsort(-chi2[toxic], kind="stable")]] = np.arange(len(toxic))
    strongest = np.full(len(y), len(toxic), np.int32)
    np.minimum.at(strongest, rows, strength[ids])
    of_row = np.argsort(strongest, kind="stable")
    starts = np.cumsum(lengths) - lengths
    for place, inside in enumerate(np.split(of_row, np.searchsorted(strongest[of_row], np.arange(1, len(toxic) + 1)))[: len(toxic)]):
        docs, share = float(len(inside)), float(y[inside].mean()) if len(inside) else 0.0
        if not 0 < share < 1:
            continue
        held = np.concatenate([ids[starts[i] : starts[i] + lengths[i]] for i in inside])
        met, at = np.unique(held, return_inverse=True)
        seen, ones_ = np.bincount(at).astype(float), np.bincount(at, np.repeat(y[inside], lengths[inside]))
        other = strength[met] != place
        met, seen, ones_ = met[other], seen[other], ones_[other]
        excess[met] += ones_ - seen * share
        variance[met] += seen * (docs - seen) / max(1.0, docs - 1) * share * (1 - share)
    paired = usual & (excess > 0) & (excess**2 >= PAIR_CHI2 * variance) & (variance > 0)
    return np.flatnonzero(alone | paired)


@dataclass(frozen=True)
class Model:
    index: dict[int, int]  # bucket to term
    machine: Machine

    def scores(self, texts: list[str]) -> np.ndarray:
        sets = [[self.index[b] for b in sorted(buckets(t) & self.index.keys())] for t in texts]
        ids = np.array([i for s in sets for i in s], np.int64)
        return sigmoid(self.machine.margin(ids, np.cumsum([len(s) for s in sets])))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_DOCS, held_out: tuple[int, int] = HELD_OUT) -> Model:
    bound_arrow_batches(documents.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.array(sorted(buckets(t)), np.int32).tobytes() for t in texts_of(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["terms", "y"])

    rows = labelled(documents, labels, label, held_out, most).mapInArrow(batch_map(run), "terms binary, y int").toArrow()
    found = sorted(set(zip(rows["terms"].to_pylist(), rows["y"].to_pylist())))  # in an order of their own
    y = np.array([label_ for _, label_ in found], float)
    if not 0 < y.sum() < len(y):
        return Model({}, fit([], np.zeros(0), 0))
    lengths, ids = np.array([len(t) // 4 for t, _ in found]), np.frombuffer(b"".join(t for t, _ in found), np.int32)
    chosen = chosen_terms(ids, lengths, y)
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    sets = [own[own >= 0].tolist() for own in np.split(place[ids], np.cumsum(lengths)[:-1])]
    return Model({int(t): i for i, t in enumerate(chosen)}, fit(sets, y, len(chosen)))


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    bound_arrow_batches(documents.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.scores(texts_of(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(held_out[0])) == held_out[1]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(part, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(batch_map(run), "doc_id long, held_out boolean, score double, predicted int")


def clean(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score is below the threshold."""
    bound_arrow_batches(documents.sparkSession)
    at = documents.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.scores(texts_of(batch.column(at))) < threshold))

    return documents.mapInArrow(batch_map(run), documents.schema)
