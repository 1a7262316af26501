"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_dealt_anew, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Links every neighbour of a node to the smallest node next to it."""
    sym = edges.union(edges.select("v", "u")) if large else edges
    least = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = join_dealt_anew(sym, least, ["u"])
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b: long) that isn't itself a root; the root is the component's least node.

    Null ends, loops and repeated edges are ignored; no edge gives no row. Each round ends in a written table,
    so a lost executor costs one round at most. Rounds grow with the logarithm of the number of nodes.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = written(e, "edges"), None
    while True:
        # order-free digest of the edge set; two sums, as bounded as one row
        digest = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("long"))).first()
        if digest == before or digest[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e, before = written(_star(_star(e, True), False), "edges"), digest
