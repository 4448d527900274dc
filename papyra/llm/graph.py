"""Connected components of an edge list that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dist import stage

#: A node with fewer links than this is never treated as a hub.
HUB = 100


def _to_least(links: DataFrame, own: bool, n_links: int) -> tuple[DataFrame, DataFrame]:
    """u, v, low of each of links (u, v), low being the least of u's neighbours (and of u itself, if own); and n, low of each u.

    Links of hubs meet their hub's row by broadcast where they lie, all others by an ordinary join, so no node's links come
    together in one task. A hub has more than twice the links of an even partition: there are fewer hubs than half of
    the shuffle partitions, which bounds what is broadcast.
    """
    partitions = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = max(HUB, 2 * n_links // max(1, partitions))
    least = F.least(F.min("v"), F.col("n")) if own else F.min("v")
    low = links.groupBy(F.col("u").alias("n")).agg(least.alias("low"), F.count(F.lit(1)).alias("links"))
    hubs = F.broadcast(low.where(F.col("links") > many).select(F.col("n").alias("hub"), F.col("low").alias("hub_low")))
    marked = links.join(hubs, F.col("u") == F.col("hub"), "left")
    rest = marked.where("hub IS NULL").join(low.where(F.col("links") <= many), F.col("u") == F.col("n")).select("u", "v", "low")
    return rest.unionByName(marked.where("hub IS NOT NULL").select("u", "v", F.col("hub_low").alias("low"))), low.select("n", "low")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node of edges (a long, b long).

    Alternates two contractions until nothing changes: each node's larger neighbours, then each node's smaller
    neighbours, are linked to its smallest one. Each round at least halves the depth of a component, so rounds
    grow with the logarithm of its size. A node's minimum is combined before the shuffle.
    """
    links = stage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before, n_links = None, links.count()
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, True, 2 * n_links)[0].where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
        large = stage(large, "large-star")
        joined, low = _to_least(large, False, n_links)
        small = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").unionByName(low.select(F.col("n").alias("u"), F.col("low").alias("v"))).distinct()
        links = stage(small, "small-star")
        # a signature of the edge set: unchanged when every link leads to its component's smallest node
        sign = tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if sign == before:
            break
        before, n_links = sign, sign[0]
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
