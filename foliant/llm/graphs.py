"""Connected components of a table of links, by alternating stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import written

#: Rounds after which a run is given up; each at least halves a path, so this covers any input.
MOST_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node with a link; links: a, b of one comparable type.

    Large-star and small-star rounds: neighbours are linked to the least of them, so a group's links never exceed its
    nodes, and a hot node is aggregated map-side to its minimum before any shuffle.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = _state(edges)
    for _ in range(MOST_ROUNDS):
        # large star: every larger neighbour of a node goes to the least of the node's neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
            .where("u <> v")
            .distinct()
        )
        edges = written(small, "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """Number and combined hash of the links: equal once a round changes nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())
