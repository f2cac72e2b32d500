"""Connected components by alternating large and small stars.

Links stay distributed: each half round is a minimum by node and a join, and
its result is a written table.  A hub's rows meet one row of minima; both
sides come from files, so adaptive execution can split the hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` of comparable ids -> ``node, root``: for every linked
    node the smallest node it can reach.  Self links and repeated links do
    no harm; nodes without a link to another one are not listed; no links
    give an empty result."""
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
                       "least")
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .distinct(), "large-star")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        edges, before = staged(small, "small-star"), state
        state = _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
