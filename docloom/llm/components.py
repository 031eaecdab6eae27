"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Stored, store


def connected_components(links: DataFrame) -> Stored:
    """(node, root) for every node of `links` (columns a, b): root is the least node of its component.

    Alternates the large-star and the small-star step (Kiveris et al. 2014): each joins every node's links with the
    least of its neighbours, an aggregate that combines before the shuffle, so a node with very many links is no
    single task's group. Rounds grow with the logarithm of the longest path; each is written to the shared folder.
    Links of a node to itself keep it as a component of its own; nulls take no part.
    """
    both = links.where("a is not null and b is not null")
    edges = store(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = digest(edges.df)
    while True:
        e = edges.df
        around = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(e.where("a = b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").distinct()
        after = store(small, "links")
        edges.drop()
        edges, now = after, digest(after.df)
        if now == before:
            break
        before = now
    roots = store(edges.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "roots")
    edges.drop()
    return roots
