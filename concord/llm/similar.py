"""Near-duplicates of a stated similarity by long SimHash fingerprints, shards of agreeing bits and BK-trees.

Two texts are meant to link where their sets of ``SHINGLE``-word shingles have a Jaccard similarity of ``SIMILARITY`` or more. The
fingerprints of sets of similarity s differ in a share acos(2 s / (1 + s)) / pi of their bits: 0.151 of 256, or 38.7 with a deviation of
5.7, for 0.8. Fingerprints link at ``RADIUS`` or fewer differing bits, so the measure is an estimate: pairs of exactly 0.8 link nine times of ten, pairs
of 0.85 nearly always, pairs of 0.7 three times of ten, pairs of 0.5 once in a thousand.

No block of bits must agree at so wide a radius, so candidates come from tables: a table takes some bits, the same of every fingerprint,
and the fingerprints that agree on them are a shard. A table takes so many bits that random fingerprints come to ``SHARE`` a shard, and there are so many
tables that a pair of ``SIMILARITY`` shares a shard with probability ``RECALL``: 44 tables of 14 bits for 185,000 texts. Both follow from
the number of fingerprints alone, and work grows as its power 1.24.

Within a shard small sets go through a BK-tree (``simhash.forest``). Large ones are flooded from one fingerprint to all that are not reached yet,
kept in the order of their distance to the shard's first one, of which only those are looked at whose distance is within the radius of its own, as
in the first level of a BK-tree; a group of near copies then costs about as much as it has members, and no pairs are listed. Shards of over
``BLOCK`` fingerprints are dealt into blocks, otherwise in each table, so that no task holds an unbounded group: members of a large
group meet others of it in every block, of every table.

Odd input: as in ``simhash``; null, empty and blank texts have the fingerprint zero, texts of fewer words than a shingle have one shingle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import batch_map, bound_arrow_batches, cut, texts_of
from .components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
LONGS = 4
RADIUS = 46
RECALL = 0.99
SHARE = 16
SMALL = 24
BLOCK = 20_000
#: Above so many, the list of hot shards is joined by shuffle.
BROADCAST = 100_000
SLICE = 1 << 13


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """``LONGS`` independent longs for each hash (splitmix64)."""
    z = hashes[:, None] + np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def shingles(text: str) -> np.ndarray:
    """Hashes of the distinct word shingles of the lower-cased (A-Z) text."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, simhash.SEED) for s in parts], np.uint64))


def fingerprint(text: str) -> bytes:
    hashes = shingles(text)
    ones = np.zeros(64 * LONGS, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = _mixed(hashes[at : at + SLICE])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def fingerprints(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``fp`` (the fingerprint, binary)."""
    bound_arrow_batches(documents.sparkSession)
    rows = documents.select(*keep, F.col(text).cast("string").alias("sh_text"))
    schema = rows.drop("sh_text").withColumn("fp", F.lit(b"")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = pa.array([fingerprint(t) for t in texts_of(batch.columns[-1])], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], own], schema=pa.schema([*list(batch.schema)[:-1], pa.field("fp", pa.binary())]))

    return rows.mapInArrow(batch_map(run), schema)


def tables(n: int) -> list[np.ndarray]:
    """The bits of each table, for ``n`` fingerprints."""
    width = max(8, ceil(log2(max(n, 1) / SHARE)))
    agree = (1 - acos(2 * SIMILARITY / (1 + SIMILARITY)) / pi) ** width
    rng = np.random.default_rng(simhash.SEED)
    return [rng.permutation(64 * LONGS)[:width] for _ in range(ceil(log(1 - RECALL) / log(1 - agree)))]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, LONGS)


def flood(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(row, row of the first reached of its component) of the rows of ``prints`` that are not the first of theirs."""
    apart = lambda rows, one: np.bitwise_count(rows ^ one).sum(1, dtype=np.int64)
    far = apart(prints, prints[0])
    order = np.argsort(far, kind="stable")
    prints, far = prints[order], far[order]
    left, rest, keys, found = np.arange(len(prints)), prints, far, []
    while len(left):
        root, left, rest, keys = left[0], left[1:], rest[1:], keys[1:]
        open_ = [root]
        while open_ and len(left):
            at = open_.pop()
            low, high = np.searchsorted(keys, (far[at] - radius, far[at] + radius + 1))
            near = low + np.flatnonzero(apart(rest[low:high], prints[at]) <= radius)
            if len(near):
                reached = left[near].tolist()
                found += [(order[i], order[root]) for i in reached]
                open_ += reached
                left, rest, keys = (np.delete(x, near, 0) for x in (left, rest, keys))
    return found


def _links_of(prints: np.ndarray) -> list[tuple[bytes, bytes]]:
    if len(prints) <= SMALL:
        whole = lambda x: x.to_bytes(8 * LONGS, "little")
        return [(whole(a), whole(b)) for a, b in simhash.forest([int.from_bytes(p.tobytes(), "little") for p in prints], RADIUS)]
    return [(prints[a].tobytes(), prints[b].tobytes()) for a, b in flood(prints, RADIUS)]


def _shard_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by shard and part; one may run over several batches."""

    def out(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], names=["a", "b"])

    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, part, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
        starts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(shard)]
        links = []
        for a, b in zip(starts, starts[1:]):
            if (shard[a], part[a]) != current:
                if sum(map(len, held)) > 1:
                    links += _links_of(np.concatenate(held))
                current, held = (shard[a], part[a]), []
            held.append(prints[a:b])
        if links:
            yield out(links)
    if sum(map(len, held)) > 1:
        yield out(_links_of(np.concatenate(held)))


def rest_links(members: DataFrame) -> DataFrame:
    """Links (a, b) between the blocks of the large shards ``members`` (shard, fp, root): all of a shard against those outside its largest component.

    Both sides are dealt into blocks of about ``BLOCK``, and each pair of blocks is a cell, which is searched as a shard is.
    """
    sizes = members.groupBy("shard", "root").agg(F.count("*").alias("n")).groupBy("shard").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"))
    sizes = sizes.select("shard", F.col("main.root").alias("main"), F.ceil(F.col("n") / BLOCK).alias("parts"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("rests")).where("rests > 0")
    held = members.join(sizes, "shard")
    block, own = F.pmod(F.xxhash64("shard", "fp"), "parts"), F.pmod(F.xxhash64("fp", "shard"), "rests")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    as_any = held.select("shard", "parts", "fp", block.alias("at"), every("rests").alias("of"))
    as_rest = held.where("root != main").select("shard", "parts", "fp", every("parts").alias("at"), own.alias("of"))
    cells = as_any.unionByName(as_rest).select("shard", (F.col("of") * F.col("parts") + F.col("at")).alias("part"), "fp")
    return cells.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(_shard_links, "a binary, b binary")


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp``, read several times: enough to connect all that share a shard and are within the radius."""
    bound_arrow_batches(distinct.sparkSession)
    chosen = tables(distinct.count())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.unpackbits(_matrix(batch.column(0)).view(np.uint8), axis=1, bitorder="little")
        keys = [bits[:, own].astype(np.int64) @ (1 << np.arange(len(own))) + (k << len(own)) for k, own in enumerate(chosen)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.concat_arrays([batch.column(0)] * len(keys))], names=["shard", "fp"])

    keyed = distinct.mapInArrow(batch_map(run), "shard long, fp binary")
    hot = cut(keyed.groupBy("shard").count().where(F.col("count") > BLOCK).select("shard", F.ceil(F.col("count") / BLOCK).alias("parts")))
    if n := hot.count():
        keyed = keyed.join(F.broadcast(hot) if n <= BROADCAST else hot, "shard", "left")
        part = F.coalesce(F.pmod(F.xxhash64("shard", "fp"), "parts"), F.lit(0))
    else:
        part = F.lit(0)
    dealt = keyed.select("shard", part.cast("long").alias("part"), "fp")
    found = dealt.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(_shard_links, "a binary, b binary")
    if not n:
        return found
    rooted = cut(connected_components(found).select(F.col("node").alias("fp"), "root"))
    members = keyed.where("parts is not null").select("shard", "fp").join(rooted, "fp", "left").select("shard", "fp", F.coalesce("root", "fp").alias("root"))
    return rooted.select(F.col("fp").alias("a"), F.col("root").alias("b")).unionByName(rest_links(cut(members)))


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents``, same columns, with one row of each group of near-duplicates, as ``simhash.one_of_each`` chooses it."""
    return simhash.one_of_each(documents, fingerprints, links)
