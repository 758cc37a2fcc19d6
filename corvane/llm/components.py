"""Connected components by alternating large and small stars; links and labels stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def near_labels(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (src, dst): the smallest node within two steps.

    Nodes of equal label are connected; connected nodes can differ in label.
    """
    both = links.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(links.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.join(low, F.col("v") == F.col("n")).groupBy(F.col("u").alias("node")).agg(F.least(F.min("m"), F.first("u")).alias("label"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (src long, dst long); root is the smallest node reachable.

    Loops and null ends are ignored, repeated links count once, no links give no rows. A round replaces each node's
    links by links to the smallest node it knows: first those to larger neighbours, then those to smaller ones. Minima
    are combined before the shuffle, so a hub is no single task's work, and joins back are left to Spark's skew
    handling. Rounds end when the links are stars: nobody has two, and no centre has one of its own. Each round's links
    are written to the shared folder, the round's before deleted; one figure a round reaches the driver.
    """
    src, dst = F.col("src"), F.col("dst")
    links = edges.where(src != dst).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    links = cut(links, "links")
    for _ in range(max_rounds):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("n")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(low, F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        done, links = links, cut(small.where(F.col("u") != F.col("v")).distinct(), "links")
        release(done)
        ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("own")), F.struct(F.col("v").alias("n"), F.lit(0).alias("own")))).alias("e"))
        ends = ends.groupBy("e.n").agg(F.sum("e.own").alias("own"), F.min("e.own").alias("least"))
        if ends.where("own > 1 OR (own > 0 AND least = 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
