"""Connected components of links between long ids, by alternating star contractions on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import saved


def connected(links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for all nodes of the links (a, b): root is the smallest id of the component.

    Every round turns each node's larger neighbours, then its smaller ones, towards the smallest id
    it sees; the number of rounds grows with the logarithm of the longest chain. A hot node's rows
    are aggregated to a minimum before they are shuffled.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(limit):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now["n"] == 0 or now == before:
            break
        before = now
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written, so that the join behind reads two plain exchanges, which Spark can split at a hub.
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = saved(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def rooted(df: DataFrame, node: str, roots: DataFrame, name: str) -> DataFrame:
    """Adds the root of ``node``; a node without links is its own root."""
    r = roots.select(F.col("node").alias(node), F.col("root").alias(name))
    return df.join(r, node, "left").withColumn(name, F.coalesce(F.col(name), F.col(node)))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` of all nodes after further links (a, b) between them."""
    ends = rooted(rooted(links, "a", roots, "ra"), "b", roots, "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return saved(rooted(roots, "root", connected(ends), "top").select("node", F.col("top").alias("root")), "roots")
