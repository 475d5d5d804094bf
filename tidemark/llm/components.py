"""Connected components of a link table, by alternating star contractions.

Each round hangs every node's larger neighbours onto its smallest one
(large star) and then its smaller ones too (small star); the table stays a
set of links between the same components and ends as one star per
component around its smallest node, after about log(n) rounds. A round is
aggregates with map-side combining and equi-joins, so a hub with very many
links is split by the aggregate and by the adaptive skew join. Each round is
written to the shared checkpoint folder: a lost executor rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: columns ``u`` and ``v`` (long). Returns (node, root) for every
    node that has a link to another; root is the smallest node reachable. Self
    links, repeated links and links with a null end are ignored."""
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialize(least, "least")  # a written side lets the adaptive join split a hub's links
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = materialize(small, "small")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
