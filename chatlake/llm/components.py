"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``v`` (longs) to ``node``, ``label``: equal labels, one component.

    Each round maps every node to the one of itself and its neighbours that a
    hash of the round ranks first, and replaces edges by edges between these.
    A random order contracts chains as well as stars by a constant factor
    a round, so rounds grow with the logarithm of the nodes.  The
    neighbours' best combines before the shuffle, and the joins have one
    row for each node on one side, so a node with very many edges is only ever a
    large key on the side that adaptive execution splits."""
    now = cut(edges.where("u != v").select("u", "v").distinct())
    labels, rounds = None, 0
    while not now.isEmpty():
        order = F.xxhash64(F.lit(rounds), "v")
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the smallest hash and its node as one comparable value; hashes of distinct longs under one seed differ but for chance, the node breaks ties
        best = both.groupBy("u").agg(F.min(F.struct(order.alias("h"), F.col("v"))).alias("b"))
        own = F.struct(F.xxhash64(F.lit(rounds), "u").alias("h"), F.col("u").alias("v"))
        step = cut(best.select("u", F.least(own, F.col("b"))["v"].alias("p")))
        left, right = (step.select(F.col("u").alias(c), F.col("p").alias(f"p{c}")) for c in "uv")
        now = cut(now.join(left, "u").join(right, "v").where("pu != pv")
                  .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            labels = cut(labels.join(step, F.col("label") == F.col("u"), "left")
                         .select("node", F.coalesce("p", "label").alias("label")))
        rounds += 1
    return labels if labels is not None else now.select(F.col("u").alias("node"), F.col("v").alias("label"))
