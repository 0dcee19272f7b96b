"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


#: Links of a node below which it is no hub.
HUB = 500
#: Rows for which a partition of their own is worth its task.
ROWS = 100_000


def parts(rows: int) -> int:
    return max(1, -(-rows // ROWS))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node that has a link. links: a, b.

    Alternates the large-star and small-star steps of Kiveris et al. Each step is one aggregate of
    the smallest neighbour, combined before the shuffle, and one join with it; the lineage is cut after each
    round, and results take no more partitions than their rows are worth. A node that has over a thousandth of all links (so fewer
    than a thousand have, whatever the size) meets them where they are, as its smallest neighbour is sent to all.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before, n = None, edges.count()
    while n:
        k = parts(n)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")).select("u", F.least("u", "m").alias("m"), "d").coalesce(k)
        hubs = F.broadcast(low.where(F.col("d") > max(HUB, 2 * n // 1000)).drop("d"))
        apart = both.join(hubs.select("u"), "u", "left_anti").join(low.drop("d"), "u")
        large = both.join(hubs, "u").unionByName(apart).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(k)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(k)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = written(small.distinct().coalesce(k), "links")
        n, check = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, check) == before:
            break
        before, rounds = (n, check), rounds - 1
        if not rounds:
            raise RuntimeError("components did not settle")
    # settled: every edge leads from a node to its component's smallest node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
