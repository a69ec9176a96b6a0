"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.llm.common import written


def _step(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """One large-star and one small-star step over links (a, b) with a > b; and what tells whether the next changes anything."""
    # Large star: every larger neighbour of a node is linked with the node's smallest neighbour or itself.
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    # Small star: a node and its smaller neighbours are linked with the smallest of these.
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    seen = Observation()
    out = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    out = written(out, "links")
    return out, (seen.get["n"], seen.get["h"])


def linked(links: DataFrame) -> DataFrame:
    """Links as (larger, smaller) node, each once."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def names(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node is linked with directly, or itself.  Nodes of one name are connected; of settled links all connected nodes have one."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return both.groupBy("node").agg(F.min("component").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (a, b); a component's name is its smallest node.

    A step is a grouped minimum and a join back; no node's neighbours are ever
    gathered.  Each step's links are written, so lineage stays short.  Steps end
    when one changes nothing, after a number that grows with the logarithm of the
    longest path.
    """
    edges, before = linked(links), None
    while True:
        edges, now = _step(edges)
        if now == before:
            return names(edges)
        before = now
