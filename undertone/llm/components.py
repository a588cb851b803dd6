"""Connected components by joins."""

from pyspark.sql import DataFrame, functions as F

from undertone.session import durable, release


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is the smallest reachable node.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours. Both are a grouped minimum and a join on the node;
    rounds grow with the logarithm of the longest chain. A node's neighbours are never collected.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = durable(both.filter("a <> b").distinct(), "links")
    stored, seen = edges, None
    while True:
        # Large star: neighbours above a node go to its smallest neighbour or itself.
        lowest = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = edges.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(up.filter("a <> b").distinct(), "large-star")
        # Small star: neighbours below a node, and itself, go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(
            low.select("a", F.col("m").alias("b"))).distinct()
        small = durable(small, "small-star")
        release(stored, large)
        stored = small
        # Both steps keep what is connected; a pass that leaves the stars as they were is the last.
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        edges = small.unionByName(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return small.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        small.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
