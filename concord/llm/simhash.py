"""Near-duplicates by SimHash fingerprints, linked through BK-trees.

A fingerprint bit is set where it is set in over half of the document's word shingles' hashes. Distinct fingerprints
link at ``RADIUS`` or fewer differing bits. Two such fingerprints agree on at least ``BLOCKS - RADIUS`` of ``BLOCKS``
blocks of bits, so each fingerprint joins one shard for each pair of blocks and every link lies inside some shard. A shard
builds a BK-tree (children keyed by their integer distance to the parent) and each of its fingerprints follows only the
edges whose distance is within the radius of its own distance to the node. Shards of over ``SHARD`` fingerprints are split
once more by a third of the bits that are left, after which at most 2^22 fingerprints can share a shard.

Shard trees reach the tasks by shuffle instead of broadcast: all trees together grow with the corpus.
A shard emits no pairs but a forest: each fingerprint with the smallest of its part of the shard. Components of these
links are found by distributed star contraction, so links are complete although pairs are never listed.

Odd input: null, empty and blank texts have the fingerprint zero, which links like any other; a null doc_id is no
candidate for component_id (null if no other is in the component); repeated rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_map, bound_arrow_batches, cut, free_prefix, texts_of
from .components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
SHARD = 20_000
SLICE = 1 << 16


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) words' shingles."""
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


class BkTree:
    """Integers under Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if self.values:
            node = 0
            while (d := (self.values[node] ^ value).bit_count()) in self.children[node]:
                node = self.children[node][d]
            if d:
                self.children[node][d] = len(self.values)
            else:
                return
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of the values at most ``radius`` away."""
        found, open_ = [], [0] if self.values else []
        while open_:
            node = open_.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            own = self.children[node]
            if len(own) <= 2 * radius + 1:
                open_.extend(c for k, c in own.items() if d - radius <= k <= d + radius)
            else:
                open_.extend(own[k] for k in range(d - radius, d + radius + 1) if k in own)
        return found


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, smallest value of its component) of the values that are linked to a smaller one."""
    tree, parent = BkTree(), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for v in values:
        if v in parent:
            continue
        parent[v] = v
        for i in tree.within(v, radius):
            a, b = root(v), root(tree.values[i])
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, r) for v in parent if (r := root(v)) != v]


def _shard_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by shard; a shard may run over several batches."""
    current, values, links = None, [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for batch in batches:
        for shard, part, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (shard, part) != current:
                if len(values) > 1:
                    links += [(signed(a), signed(b)) for a, b in forest(values)]
                current, values = (shard, part), []
            values.append(value & (1 << 64) - 1)
        if len(links) >= 10_000:
            yield out()
            links = []
    if len(values) > 1:
        links += [(signed(a), signed(b)) for a, b in forest(values)]
    if links:
        yield out()


def fingerprints(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``fp`` (the fingerprint as a signed long)."""
    bound_arrow_batches(documents.sparkSession)
    rows = documents.select(*keep, F.col(text).cast("string").alias("sh_text"))
    schema = rows.drop("sh_text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = np.array([fingerprint(t) for t in texts_of(batch.columns[-1])], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own)], schema=pa.schema([*list(batch.schema)[:-1], pa.field("fp", pa.int64())]))

    return rows.mapInArrow(batch_map(run), schema)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp``, enough to connect all that are within the radius."""
    bound_arrow_batches(distinct.sparkSession)
    width = 64 // BLOCKS
    block = lambda i: F.expr(f"shiftrightunsigned(fp, {i * width}) & {(1 << width) - 1}")
    own, rest = [], []
    for k, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS)):
        others = [b for b in range(BLOCKS) if b not in (i, j)]
        left = block(others[0]).bitwiseOR(F.shiftleft(block(others[1]), width))
        own.append(F.struct((F.lit(k << 2 * width).bitwiseOR(F.shiftleft(block(i), width)).bitwiseOR(block(j))).alias("shard"), left.alias("left")))
    keyed = distinct.select("fp", F.explode(F.array(*own)).alias("k")).select("fp", "k.shard", "k.left")
    hot = keyed.groupBy("shard").count().where(F.col("count") > SHARD).select("shard", F.lit(True).alias("hot"))
    keyed = keyed.join(hot, "shard", "left")
    thirds = [F.lit(i << 11).bitwiseOR(F.expr(f"shiftrightunsigned(left, {11 * i}) & 2047")) for i in range(RADIUS + 1)]
    parts = keyed.select("shard", F.explode(F.when(F.col("hot"), F.array(*thirds)).otherwise(F.array(F.lit(-1).cast("long")))).alias("part"), "fp")
    return parts.repartition("shard", "part").sortWithinPartitions("shard", "part", "fp").mapInArrow(_shard_links, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """A row per document: doc_id, fp, component_id (the smallest doc_id that links reach)."""
    marked = cut(fingerprints(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = connected_components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = nodes.join(found, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(labelled, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(documents: DataFrame, fingerprints: Callable[..., DataFrame] = fingerprints, links: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """``documents``, same columns, with one row of each group of near-duplicates: that of the smallest doc_id.

    ``fingerprints`` and ``links`` say what links, here this module's. Rows go by 128 bits of hash over all their columns. Of several rows with the group's smallest doc_id (or of rows without
    one, if the group has no other) the one of the smallest hash stays. Before the last join, which carries texts, only
    hashes and fingerprints are shuffled.
    """
    columns = [c for c in documents.columns if documents.schema[c].dataType.typeName() not in ("map", "variant")]
    a, b = (free_prefix(documents.columns, "sh_") + x for x in "ab")
    nulls = F.array(*(F.col(c).isNull() for c in columns))  # the hash passes over nulls
    keys = [F.xxhash64(nulls, *columns).alias(a), F.xxhash64(F.lit("b"), nulls, *columns[::-1]).alias(b)]
    marked = fingerprints(documents.select(F.col("doc_id").cast("long").alias("sh_id"), *keys, "text"), keep=("sh_id", a, b))
    order = F.struct(F.col("sh_id").isNull().alias("no_id"), "sh_id", a, b)
    nodes = cut(marked.groupBy("fp").agg(F.min(order).alias("first")))
    found = connected_components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    first = nodes.join(found, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = documents.select("*", *keys).join(first.select(f"first.{a}", f"first.{b}"), [a, b], "left_semi")
    return kept.dropDuplicates([a, b]).select(*documents.columns)
