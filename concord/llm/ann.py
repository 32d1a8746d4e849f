"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into halves, and each half is quantised by its own codebook of ``K`` centroids; the pair of codes is
the vector's cell of K x K. A query sorts the centroids of each half by its distance to them (the negative inner product)
and a heap yields the centroid pairs by summed distance; it takes cells until they hold the share of all
vectors that ``probed_share`` measures on the sample for a recall of ``RECALL``; these are ranked by their exact inner
products. Clustered vectors need a small share; directions spread evenly, as in the test tables, need about a third.

Equal vectors are one entry with the ids of the ``k + 1`` rows of smallest id, which loses no result (a query takes no more than one
of them away, its own) and keeps a very common vector from filling a cell. Entries are dealt out in blocks of about ``BLOCK`` (a larger cell is cut into several), each query goes to
the blocks of its cells, and a task holds one block at a time while the queries stream past it, so memory is bounded.
The driver holds a sample of at most ``SAMPLE_BYTES`` for the codebooks, and K^2 cell sizes at most.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Candidates are all
rows but the query's own: of several rows with its id and its vector one is its own, and the others are neighbours like any row, with
that id. Rows that repeat both are one query; rows of one id with different vectors are a query each, whose ranks are counted
apart. An empty table gives no rows; other columns are ignored. If there are fewer than k candidates, all are returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_map, bound_arrow_batches, cut

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
CELL = 8  # vectors in a cell on average, while K is below its bound
MOST_CENTROIDS = 1024
BLOCK = 4096
STEPS = 12
QUERIES = 200  # rows of the sample that measure the share
RECALL = 0.95
FOUND = "query_id long, query_no long, vec_id long, score double"


def probed_share(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int) -> float:
    """The share of all vectors that a query must look at to find ``RECALL`` of its k nearest, measured on the sample.

    In a larger table the k nearest are nearer, so this errs to the safe side.
    """
    half = books[0].shape[1]
    rows = np.linspace(0, len(sample) - 1, min(QUERIES, len(sample))).astype(int)
    scores = sample[rows] @ sample.T
    scores[np.arange(len(rows)), rows] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1.0
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    first, second = nearest(sample[:, :half], books[0]), nearest(sample[:, half:], books[1])
    by_cell = np.argsort(-(sample[rows][:, :half] @ books[0].T)[:, first] - (sample[rows][:, half:] @ books[1].T)[:, second], axis=1, kind="stable")
    rank = np.argsort(by_cell, axis=1)
    needed = np.sort(rank[np.arange(len(rows))[:, None], best].ravel())
    return float(needed[math.ceil(RECALL * len(needed)) - 1] + 1) / len(sample)


def usable(embedding) -> F.Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0)


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from a fixed start: evenly spaced rows of the sample, in its (hashed) order."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(STEPS):
        code = nearest(x, centroids)
        counts = np.bincount(code, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, code, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, 1)


def cells_of(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells (i * K + j) by ascending first[i] + second[j] until they hold ``wanted`` vectors; empty cells are passed over."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    f, s, k = first[a].tolist(), second[b].tolist(), len(second)
    a, b = a.tolist(), b.tolist()
    heap, found, held = [(f[0] + s[0], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * k + b[j]
        if size := sizes[cell]:
            found.append(cell)
            held += size
        if j + 1 < len(s):
            heapq.heappush(heap, (f[i] + s[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(f):
            heapq.heappush(heap, (f[i + 1] + s[0], i + 1, 0))
    return found


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _best(scores: np.ndarray, ids: list[list[int]], own: int, query: np.ndarray, entries: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k best rows of the entries whose score is not -inf, but for the query's own row: (vec_id, score)."""
    rows = np.flatnonzero(scores > -np.inf)
    if len(rows) > k + 1:
        limit = np.partition(scores[rows], len(rows) - k - 1)[len(rows) - k - 1]
        rows = rows[scores[rows] >= limit - 1e-12 * (1 + abs(limit))]
    found = []
    for r in rows.tolist():
        exact = math.fsum((query * entries[r]).tolist())
        rows_of = ids[r]
        if own in rows_of and np.array_equal(query, entries[r]):
            at = rows_of.index(own)
            rows_of = rows_of[:at] + rows_of[at + 1 :]
        found += [(-exact, i) for i in rows_of]
    return [(i, -s) for s, i in sorted(found)[:k]]


def search(vectors: DataFrame, k: int = 20, query_every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every vector whose vec_id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    bound_arrow_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    common = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    dim = common[0]
    rows = rows.where(F.size("e") == dim)
    place = F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))
    entries = cut(rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("e").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    n = entries.count()
    most = max(256, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    sample = _matrix(entries.select("e").orderBy(F.xxhash64("e"), "e").limit(most).toArrow()["e"].combine_chunks(), dim)
    half, centroids = dim // 2, max(1, min(MOST_CENTROIDS, round(math.sqrt(n / CELL)), len(sample)))
    books = (codebook(sample[:, :half], centroids) if half else np.zeros((1, 0)), codebook(sample[:, half:], centroids))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(0), dim)
        cell = nearest(x[:, :half], books[0]) * len(books[1]) + nearest(x[:, half:], books[1])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int64())], names=["e", "ids", "cell"])

    coded = cut(entries.mapInArrow(batch_map(encode), "e array<double>, ids array<long>, cell long"))
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    counted = coded.groupBy("cell").count().toArrow()
    sizes[counted["cell"].to_numpy()] = counted["count"].to_numpy()
    chunks = np.maximum(1, -(-sizes // BLOCK))  # blocks of a cell
    filled = np.cumsum(np.where(chunks > 1, 0, sizes))  # whole cells fill blocks in order; cut cells get blocks of their own
    block = np.where(chunks > 1, 0, filled // BLOCK)
    shared = int(block.max()) + 1
    own_first = shared + np.cumsum(np.where(chunks > 1, chunks, 0)) - np.where(chunks > 1, chunks, 0)
    first_block = np.where(chunks > 1, own_first, block)
    wanted = math.ceil(probed_share(sample, books, k) * n)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = batch.column(2).to_numpy()
        part = batch.column(3).to_numpy() % chunks[cell]
        return pa.RecordBatch.from_arrays(
            [pa.array(first_block[cell] + part, pa.int64()), pa.array(np.zeros(len(cell), np.int32)), batch.column(0), batch.column(1), pa.array(cell[:, None].tolist(), pa.list_(pa.int64()))], names=["block", "part", "e", "ids", "cells"]
        )

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, out = _matrix(batch.column(2), dim), []
            first, second = -(x[:, :half] @ books[0].T), -(x[:, half:] @ books[1].T)
            for row, own in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                by_block: dict[int, list[int]] = {}
                for cell in cells_of(first[row], second[row], sizes, wanted):
                    for b in range(first_block[cell], first_block[cell] + chunks[cell]):
                        by_block.setdefault(b, []).append(cell)
                out += [(b, row, own, cells) for b, cells in by_block.items()]
                if len(out) >= 2000 or row == len(x) - 1:
                    take = pa.array([r for _, r, _, _ in out], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b for b, *_ in out], pa.int64()), pa.array(np.ones(len(out), np.int32)), batch.column(2).take(take), pa.array([i for _, _, i, _ in out], pa.list_(pa.int64())), pa.array([c for *_, c in out], pa.list_(pa.int64()))],
                        names=["block", "part", "e", "ids", "cells"],
                    )
                    out = []

    dealt = "block long, part int, e array<double>, ids array<long>, cells array<long>"
    held = coded.withColumn("hash", F.pmod(F.xxhash64("e"), F.lit(1 << 40))).mapInArrow(batch_map(deal), dealt)
    # dealt out anew: finding a query's cells costs far more than its few bytes suggest
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    queries = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0).select("vec_id", F.xxhash64("e").alias("no"), "e").dropDuplicates(["vec_id", "e"]).repartition(spread, "vec_id", "no").mapInArrow(ask, dealt)

    def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ordered by block, its entries before its queries."""
        current, parts, matrix, ids, cells = None, [], None, [], None
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(blocks)]):
                run = batch.slice(int(a), int(b - a))
                if blocks[a] != current:
                    current, parts, matrix = blocks[a], [], None
                if kinds[a] == 0:
                    parts.append(run)
                    matrix = None
                    continue
                if not parts:
                    continue
                if matrix is None:
                    matrix = np.concatenate([_matrix(p.column(2), dim) for p in parts])
                    ids = [i for p in parts for i in p.column(3).to_pylist()]
                    cells = np.concatenate([p.column(4).flatten().to_numpy() for p in parts])
                x, out, probed_cells = _matrix(run.column(2), dim), [], np.zeros(len(sizes), bool)
                for row, (own, probed) in enumerate(zip(run.column(3).to_pylist(), run.column(4).to_pylist())):
                    probed_cells[probed] = True
                    scores = np.where(probed_cells[cells], matrix @ x[row], -np.inf)
                    probed_cells[probed] = False
                    out += [(*own, *found) for found in _best(scores, ids, own[0], x[row], matrix, k)]
                if out:
                    q, no, v, s = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(no, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "query_no", "vec_id", "score"])

    found = held.unionByName(queries).repartition("block").sortWithinPartitions("block", "part").mapInArrow(rank, FOUND)
    order = F.row_number().over(Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
