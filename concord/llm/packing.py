"""Mixture-controlled packing of documents into fixed windows of tokens.

Each source is a queue of its documents' tokens. A deficit round-robin fills every window of
``WINDOW`` tokens from the queues: in each window a queue gains its quantum (its share of the window) on
top of the deficit it carries, spends whole tokens, and carries the rest to the next window. The round-robin is
hierarchical: the queues are the leaves of a balanced binary tree, and of the ``t`` tokens that a node has spent so far

    floor(t * weight of its left half / its weight)

are its left half's and the others its right half's. Both grow with ``t``, so no queue, however small its share, is ever
taken back from, and each keeps within the tree's depth of its exact share. From this closed form any partition resumes the
round-robin at its first window with exactly the deficits that the one before it leaves, without waiting for it. A *phase*
is a run of whole windows over one set of queues; where a queue ends inside a window, that window is served by
explicit rounds (``serve_window``) that hand the unused quanta to the queues that still have tokens.

Every source has a queue of its own, however many there are. Beyond ``FAN`` queues the round-robin has levels: up to ``FAN``
queues are served, by the same rule and in windows of the same size, into one stream, and that stream is a queue of the level
above, whose share is the sum of theirs. A window then holds its streams' shares, and a stream its queues' shares over each
``WINDOW`` tokens of it.

Plan: tokenise once into a table in the shared folder; sum tokens by (partition, queue); two levels of prefix
sums give each partition's place in each queue; a second narrow pass over the table cuts the pieces. Token ids are not
shuffled unless there are over ``BROADCAST_ROWS`` places to look up, and the driver sees one name and one total per source.

Results for odd input: a null or empty text is the end token alone; a null source is a queue of its own;
repeated rows are packed as often as they occur; an empty table gives no rows; other columns are ignored. The last
window alone may be shorter than ``WINDOW``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import wordbpe
from .common import batch_map, bound_arrow_batches, texts_of, written

WINDOW = 2048
END_ID = 1
#: Queues that one schedule serves.
FAN = 128
#: Weights are in 1/65536 of the mixture, so that served() stays in 64 bits up to 10^14 tokens.
WEIGHT_SUM = 1 << 16
#: Rows of (partition, queue) offsets up to which they are broadcast (about 40 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 100_000
BLOCK = 512

TOKENS = "pk_doc_id long, pk_queue int, pk_part int, pk_from long, pk_n long, pk_ids binary"
PIECES = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@dataclass(frozen=True)
class Phase:
    """``windows`` windows from ``first``; by queue: tokens served before, and bounds of the cumulative weights, or explicit takes."""

    first: int
    windows: int
    before: tuple[int, ...]
    bounds: tuple[int, ...] | None
    takes: tuple[int, ...] | None

    def reached(self, k: int, u: np.ndarray | int):
        """Tokens of the queues up to k (exclusive) in the first u windows of the phase."""
        if self.takes is not None:
            return sum(self.takes[:k]) * u
        before, _ = self._spent(k, u)
        return before

    def served(self, k: int, u: np.ndarray | int):
        """Tokens of queue k in the first u windows of the phase; never falls as u grows."""
        if self.takes is not None:
            return self.takes[k] * u
        _, own = self._spent(k, u)
        return own

    def _spent(self, k: int, u: np.ndarray | int):
        """Tokens of the queues before k, and of queue k, in the first u windows."""
        low, high, before, own = 0, len(self.bounds) - 1, 0 * u, WINDOW * u
        while high - low > 1:
            middle = (low + high) // 2
            left = (self.bounds[middle] - self.bounds[low]) * own // max(1, self.bounds[high] - self.bounds[low])
            if k < middle:
                high, own = middle, left
            else:
                low, before, own = middle, before + left, own - left
        return before, own

    def served_by_all(self, u: int) -> np.ndarray:
        """Tokens of every queue in the first u windows (of a phase with bounds)."""
        bounds = np.array(self.bounds)
        low, high, own = np.array([0]), np.array([len(bounds) - 1]), np.array([WINDOW * u])
        while (high - low).max() > 1:  # one level of the tree; a leaf is its own left half
            middle = np.where(high - low > 1, (low + high) // 2, high)
            left = (bounds[middle] - bounds[low]) * own // np.maximum(1, bounds[high] - bounds[low])
            left = np.where(high - low > 1, left, own)
            split = middle < high
            low, high, own = np.concatenate((low, middle[split])), np.concatenate((middle, high[split])), np.concatenate((left, (own - left)[split]))
        return own[np.argsort(low)]

    @property
    def depth(self) -> int:
        return max(1, (len(self.bounds) - 2).bit_length())


def weights_of(shares: list[float], left: list[int]) -> list[int]:
    """Integer weights of the queues that have tokens left; a positive share counts 1 at least."""
    total = sum(s for s, n in zip(shares, left) if n)
    if total <= 0:
        shares, total = [1.0] * len(left), float(sum(1 for n in left if n))
    return [max(1, round(s / total * WEIGHT_SUM)) if n else 0 for s, n in zip(shares, left)]


def serve_window(weights: list[int], left: list[int]) -> list[int]:
    """One window by explicit rounds: each round deals what is open by weight, carrying the rounding deficits in the round."""
    takes, open_ = [0] * len(left), min(WINDOW, sum(left))
    while open_:
        active = [k for k, n in enumerate(left) if n > takes[k]]
        total, dealt, before = sum(max(1, weights[k]) for k in active), 0, 0
        for k in active:
            before += max(1, weights[k])
            quantum = before * open_ // total - dealt
            dealt += quantum
            takes[k] += min(quantum, left[k] - takes[k])
        open_ = min(WINDOW, sum(left)) - sum(takes)
    return takes


def phases(totals: list[int], shares: list[float]) -> list[Phase]:
    """The whole schedule, of at most two phases for each queue; ``shares``: target proportions."""
    left, before, first, out = list(totals), [0] * len(totals), 0, []
    while any(left):
        weights = weights_of(shares, left)
        bounds = [0]
        for w in weights:
            bounds.append(bounds[-1] + w)
        phase = Phase(first, 0, tuple(before), tuple(bounds), None)
        fits = lambda n: (phase.served_by_all(n) <= left).all()
        low, high = 0, sum(left) // WINDOW
        while low < high:  # served() grows with n
            middle = (low + high + 1) // 2
            low, high = (middle, high) if fits(middle) else (low, middle - 1)
        if low:
            phase, taken = Phase(first, low, tuple(before), tuple(bounds), None), phase.served_by_all(low).tolist()
        else:
            taken = serve_window(weights, left)
            phase = Phase(first, 1, tuple(before), None, tuple(taken))
        out.append(phase)
        first += phase.windows
        left, before = [n - t for n, t in zip(left, taken)], [b + t for b, t in zip(before, taken)]
    return out


def windows_of(phase: Phase, k: int, at: np.ndarray) -> np.ndarray:
    """The window of the phase that serves position ``at`` (counted from the phase's start) of queue k."""
    if phase.takes is not None:
        return np.zeros(len(at), np.int64)
    weight = (phase.bounds[k + 1] - phase.bounds[k]) * WINDOW
    near, reach = at * phase.bounds[-1] // weight, (phase.depth + 2) * phase.bounds[-1] // weight + 2
    low, high = np.clip(near - reach, 0, phase.windows - 1), np.clip(near + reach, 0, phase.windows - 1)
    while (low < high).any():  # the first window after which more than ``at`` tokens are served
        middle = (low + high) // 2
        past = phase.served(k, middle + 1) > at
        low, high = np.where(past, low, middle + 1), np.where(past, middle, high)
    return low


def pieces_of(schedule: list[Phase], k: int, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of documents that take [start, start + n) of queue k: row, start in the document, length, window, offset."""
    found, befores = [], [p.before[k] for p in schedule]
    for p in schedule[max(0, bisect_right(befores, int(start.min())) - 1) : bisect_left(befores, int((start + n).max()))]:
        low, high = p.before[k], p.before[k] + int(p.served(k, p.windows))
        a, b = np.maximum(start, low), np.minimum(start + n, high)
        rows = np.flatnonzero(a < b)
        if not len(rows):
            continue
        a, b = a[rows] - low, b[rows] - low
        u, last = windows_of(p, k, a), windows_of(p, k, b - 1)
        count = last - u + 1
        rows, first = np.repeat(rows, count), np.repeat(u, count)
        u = first + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        from_, to = np.maximum(np.repeat(a, count), p.served(k, u)), np.minimum(np.repeat(b, count), p.served(k, u + 1))
        keep = from_ < to
        rows, u, from_, to = rows[keep], u[keep], from_[keep], to[keep]
        offset = p.reached(k, u + 1) - p.reached(k, u) + from_ - p.served(k, u)
        found.append((rows, from_ + low - start[rows], to - from_, p.first + u, offset))
    return tuple(np.concatenate(x) for x in zip(*found))


def levels(totals: list[int], shares: list[float]) -> list[list[list[Phase]]]:
    """Schedules by level, from that of the sources up; queue k of a level is served by its schedule k // FAN, as queue k % FAN."""
    out = []
    while True:
        groups = range(0, max(1, len(totals)), FAN)
        out.append([phases(totals[g : g + FAN], shares[g : g + FAN]) for g in groups])
        if len(groups) == 1:
            return out
        totals, shares = [sum(totals[g : g + FAN]) for g in groups], [sum(shares[g : g + FAN]) for g in groups]


def placed_pieces(schedules: list[list[list[Phase]]], k: int, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """``pieces_of`` through all levels."""
    rows, inside, at, size = np.arange(len(start)), np.zeros(len(start), np.int64), start, n
    for level in schedules:
        part, from_, size, window, offset = pieces_of(level[k // FAN], k % FAN, at, size)
        rows, inside, at, k = rows[part], inside[part] + from_, window * WINDOW + offset, k // FAN
    return rows, inside, size, window, offset


def tokenised(documents: DataFrame, vocabulary: str, queues: dict) -> DataFrame:
    """A row per document: its queue, ids with the end token, and its place among its partition's rows of that queue."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, filled = wordbpe.load(vocabulary), TaskContext.get().partitionId(), {}
        kind = np.uint16 if words.size <= 1 << 16 else np.uint32
        for batch in batches:
            ids = [np.append(words.ids(t), END_ID).astype(kind) for t in texts_of(batch.column(1))]
            queue = [queues[s] for s in batch.column(2).to_pylist()]
            from_ = []
            for q, x in zip(queue, ids):
                from_.append(filled.get(q, 0))
                filled[q] = from_[-1] + len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(queue, pa.int32()), pa.array([part] * len(ids), pa.int32()), pa.array(from_, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["pk_doc_id", "pk_queue", "pk_part", "pk_from", "pk_n", "pk_ids"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("pk_doc_id"), "text", F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(run, TOKENS)


def pack(documents: DataFrame, vocabulary: str, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of all documents; ``ids``: the piece's ids as little-endian unsigned 32-bit numbers.

    ``targets``: share of each source in a window (sources without one divide what is left by their tokens);
    none: every source its share of all tokens, so that all queues end together.
    """
    spark = documents.sparkSession
    bound_arrow_batches(spark)
    named = [r[0] for r in documents.select(F.col("source").cast("string").alias("s")).distinct().orderBy("s").collect()]
    queues = {s: k for k, s in enumerate(named)}
    tokens = written(tokenised(documents, vocabulary, queues), "packing-tokens")
    sums = tokens.groupBy("pk_part", "pk_queue").agg(F.sum("pk_n").alias("n"))
    block = F.floor(F.col("pk_part") / BLOCK)
    inside = sums.withColumn("block", block).withColumn("before", F.sum("n").over(Window.partitionBy("pk_queue", "block").orderBy("pk_part")) - F.col("n"))
    blocks = sums.groupBy("pk_queue", block.alias("block")).agg(F.sum("n").alias("block_n"), F.count("*").alias("rows"))
    blocks = blocks.withColumn("block_before", F.sum("block_n").over(Window.partitionBy("pk_queue").orderBy("block")) - F.col("block_n"))
    total = {r[0]: (r[1], r[2]) for r in blocks.groupBy("pk_queue").agg(F.sum("block_n"), F.sum("rows")).collect()}
    totals = [total.get(k, (0, 0))[0] for k in range(len(named))]
    shares = [float(n) for n in totals]
    if targets:
        rest = max(0.0, 1.0 - sum(t for s, t in targets.items() if s in queues)) / max(1, sum(n for s, n in zip(named, totals) if s not in targets))
        shares = [float(targets.get(s, rest * n)) for s, n in zip(named, totals)]
    schedules = levels(totals, shares)
    base = inside.join(blocks.select("pk_queue", "block", "block_before"), ["pk_queue", "block"]).select("pk_queue", "pk_part", (F.col("before") + F.col("block_before")).alias("pk_base"))
    if sum(n for _, n in total.values()) <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = tokens.join(base, ["pk_queue", "pk_part"]).select("pk_doc_id", "pk_queue", (F.col("pk_from") + F.col("pk_base")).alias("pk_at"), "pk_n", "pk_ids")
    wide = wordbpe.load(vocabulary).size > 1 << 16

    def cut_pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc_id, queue, at, n = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(4))
        found = [[], [], [], [], []]
        for k in np.unique(queue):
            own = np.flatnonzero(queue == k)
            rows, *rest = placed_pieces(schedules, int(k), at[own], n[own])
            for to, x in zip(found, (own[rows], *rest)):
                to.append(x)
        row, start, length, window, offset = (np.concatenate(x) for x in found)
        ids, kind = batch.column(4), np.uint32 if wide else np.uint16
        whole = [np.frombuffer(x.as_buffer(), kind).astype("<u4").tobytes() for x in ids]
        cut_ids = [whole[r][4 * s : 4 * (s + m)] for r, s, m in zip(row.tolist(), start.tolist(), length.tolist())]
        names = pa.array([named[k] for k in queue.tolist()], pa.string())
        taken = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(taken), names.take(taken), pa.array(start), pa.array(length), pa.array(n[row]), pa.array(window), pa.array(offset), pa.array(cut_ids, pa.binary())],
            names=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    return placed.mapInArrow(batch_map(cut_pieces), PIECES)
