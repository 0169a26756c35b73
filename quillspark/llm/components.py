"""Connected components of an undirected edge table, by large-star and small-star.

Every round is two joins and two aggregations on the edges; no component is
ever held in one task.  Rounds grow with the logarithm of the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least node that it sees."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v); root is the least node of its component.

    Null ends and loops are no edges.  Raises if ``rounds`` don't suffice, rather than return parts.
    """
    edges = cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select("u", "v").distinct(), name)
    state = None
    for _ in range(rounds):
        last, edges = edges, cut(_small_star(_large_star(edges)), name)
        drop(last)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        state = now
    raise RuntimeError("components: the edges did not settle")
