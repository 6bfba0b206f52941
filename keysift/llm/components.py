"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import materialize


def _measure(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """The edges with ``m``, the least node among u and its neighbours.

    The least nodes are stored, so both sides of the join are shuffled straight from files and
    the adaptive join can split the rows of a node that a large component hangs on.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = materialize(least.select("u", F.least("u", "m").alias("m")), "least")
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (u, v long): the least node it is joined to.

    A round links, for every node, its larger neighbours to the least one (large star) and then
    its smaller neighbours to the least one (small star).  Rounds go on until nothing
    changes, about the logarithm of the longest path; each is stored in the shared folder.
    Null ends, loops and repeated edges have no effect; without edges the result is empty.
    """
    edges = edges.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    seen = _measure(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        small = _with_least(large).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").where("u != v").distinct(), "small")
        now = _measure(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
