"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed

MAX_ROUNDS = 60


def _toward_smallest(pairs: DataFrame) -> DataFrame:
    """Add to each (u, v) the smallest v of its u. Sums up before it shuffles; a hot u is split by AQE."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def least_reached(rooted: DataFrame, node: str, value: str, parts: int = 16) -> DataFrame:
    """(node, least) for rows (node, root, value): the least value of the rows that share a root.

    The least values are copied `parts` times, one for each part of a root's rows, so that a root of a
    third of all rows does not go to one task.
    """
    least = rooted.groupBy("root").agg(F.min(value).alias("least"))
    copies = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    part = F.pmod(F.xxhash64(node), F.lit(parts)).cast("int")
    return rooted.withColumn("part", part).join(copies, ["root", "part"]).select(node, "least")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node it reaches.

    edges: columns a, b (bigint). Each round links all larger neighbours of a node to its smallest
    one, then all smaller neighbours to the smallest; the edge count never grows and the paths shrink
    by a constant factor, so rounds grow with the logarithm of the longest path. Ends when a round
    changes nothing.
    """
    a, b = F.col("a"), F.col("b")
    now = landed(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.select(a.alias("u"), b.alias("v")).unionByName(now.select(b.alias("u"), a.alias("v")))
        large = (
            _toward_smallest(both)
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        starred = _toward_smallest(large)
        small = (
            starred.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")),
                                             F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a != b")
            .distinct()
        )
        now = landed(small)
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
