"""Connected components of links between documents, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.util import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to its
    larger neighbours, then to its smaller ones. Each step is one aggregation, merged on the map
    side, and one join, which adaptive execution splits if a node has very many links. The lineage
    is cut after every round by a written table. Null nodes and loops are ignored.
    """
    edges = written(links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
                    .where(F.col("a") != F.col("b"))
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), "links")
    state = None
    while True:
        edges = written(_small_star(_large_star(edges)), "links")
        found = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint")),
                          F.sum(F.hash("v", "u").cast("bigint"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots.withColumn("component", F.col("node"))))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of u are linked to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    linked = both.join(least, "u").where(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of u, and u, are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = (edges.join(least, "u").where(F.col("v") != F.col("m"))
              .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
