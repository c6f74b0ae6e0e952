"""Connected components by contraction: every node takes as parent its neighbour of the lowest rank, if that is below its own;
chains are shortened, edges are drawn between the parents, and so on until none is left. The first round ranks nodes by themselves,
so stars around their smallest node fall together in it; later rounds rank by hashes that change from round to round, so a node that
has an edge keeps no parent with a chance of a half at most, whatever the graph: about log2 of the nodes are the rounds expected, and
each round takes away one node of every edge at least, so the work ends on any graph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.store import written


def _parents(edges: DataFrame, time: int) -> DataFrame:
    rank = lambda c: F.struct((F.xxhash64(c, F.lit(time)) if time else F.col(c)).alias("h"), F.col(c).alias("node"))
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least("m", rank("u"))["node"].alias("p"))


def _jumped(parents: DataFrame) -> DataFrame:
    above = parents.select(F.col("u").alias("p"), F.col("p").alias("q"))
    return parents.join(above, "p", "left").select("u", F.coalesce("q", "p").alias("p"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v), bigint: component is the smallest node that can be reached. Edges from a
    node to itself and repeated ones count for nothing; without edges there are no rows."""
    left = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    labels = None
    for time in count():
        if left.isEmpty():
            break
        parents = written(_jumped(_parents(left, time)), "parents")
        at = lambda c: parents.select(F.col("u").alias(c), F.col("p").alias(f"{c}p"))  # noqa: E731, B023
        drawn = left.join(at("u"), "u").join(at("v"), "v").where("up <> vp")
        left = written(drawn.select(F.least("up", "vp").alias("u"), F.greatest("up", "vp").alias("v")).distinct(), "edges")
        if labels is None:
            labels = parents
        else:
            labels = labels.join(parents.select(F.col("u").alias("p"), F.col("p").alias("q")), "p", "left").select("u", F.coalesce("q", "p").alias("p"))
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = written(labels, "labels")
    return labels.join(labels.groupBy("p").agg(F.min("u").alias("component")), "p").select(F.col("u").alias("node"), "component")
