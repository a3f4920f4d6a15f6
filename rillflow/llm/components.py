"""Connected components by alternating large-star and small-star steps, in DataFrame operations.

Nodes may be of any orderable type. Edges shrink to stars around each component's smallest node; every step is written
to the shared folder, so lineage stays short and nothing of the graph reaches the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import materialize


def _large(edges: DataFrame) -> DataFrame:
    """Connects every node's larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Connects every node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge to another; component is its smallest node.

    edges: columns a, b. Loops, repeated edges, either direction and null ends (ignored) are allowed.
    """
    edges = edges.select("a", "b").where("a <> b").distinct()
    edges = materialize(edges, "cc-edges")
    before = None
    for _ in range(max_rounds):
        edges = materialize(_small(_large(edges)), "cc-round")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
