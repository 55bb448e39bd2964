"""Connected components by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkmill.llm._shared import Scratch


def _star(edges: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with m, the least v of each u: dealt by u once for both."""
    dealt = edges.repartition("u").distinct()
    return dealt.withColumn("m", F.min("v").over(W.partitionBy("u")))


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links (a, b) -> one row (node, component) per linked node; component is the smallest
    node reachable. Each round hangs every node below the least of its neighbours, first
    among the larger ones and then among the smaller ones, until nothing changes; rounds
    grow with the logarithm of the longest path. A round is two exchanges and a written table
    of pairs of numbers; the neighbours of a node are streamed through one task, which
    spills them if they are many. Null ends and loops are ignored; no links: no rows."""
    edges = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = scratch.write(edges, f"{name}-0")
    seen, k = None, 0
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen or not now[0]:
            break
        seen, k = now, k + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # Of the smaller neighbours of u, the least takes u, and every other one goes below it.
        small = _star(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = scratch.write(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
