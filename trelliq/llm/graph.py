"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); the root is the component's smallest node.

    Direction, repeats and loops do not matter; a node that occurs in loops only is its own component and is left out.
    Each round is written to the shared folder. Only a row count and a checksum reach the driver. A component may hold any
    share of all nodes: minima are taken before the shuffle, and the joins on a hub's neighbours can be split.
    """
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    now = materialize(edges.filter("u != v").select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    before = _state(now)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(new)
        discard(now)
        now = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
