"""Connected components of a link table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.session import durable


def _around(edges: DataFrame) -> DataFrame:
    """Both directions of every link beside the smallest node around ``u`` (itself included): ``u, v, m``."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(lowest, "u")


def _open_nodes(links: DataFrame) -> DataFrame:
    """Nodes below several others, or between two: where there is none, every node hangs on its root and no round is left."""
    ends = links.select("u", F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR below = 1 AND above = 1")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node with a link: root is the smallest node that can be reached.

    Large-star and small-star rounds: each node links its larger (then its smaller) neighbours to the smallest one
    around it, until every node hangs on its root; no round is spent on seeing that. Rounds grow with the logarithm of the longest chain. Neighbours are
    never gathered: a hub with many links is an aggregate and a join. NULL ends and self-links are dropped; an empty
    table gives an empty result. Rounds are cut by ``checkpoint``.
    """
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = durable(links)
    for _ in range(max_rounds):
        large = _around(links).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u keeps its link to the smallest neighbour below it; the other smaller ones link to that one too.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = durable(down.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        if _open_nodes(links).isEmpty():
            roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    raise RuntimeError(f"components need more than {max_rounds} rounds")
