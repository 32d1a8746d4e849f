"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is two shuffles of node pairs, of which a hub's are reduced to a minimum before the shuffle; each round is
checkpointed in the shared folder. No node's neighbours are gathered, and the driver sees one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
    return row[0], row[1] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: long columns a and b. Rows (node, root) of each node that has an edge and is not the smallest of its
    component; root is that smallest node. Self-loops, repeats and either direction are fine; a row with a null is ignored."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    edges = cut(edges.distinct())
    state = _checksum(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small)
        now = _checksum(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
