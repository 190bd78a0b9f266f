"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame, str], DataFrame]


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b); the component is its smallest node.

    Each round, every node's larger neighbours are linked to the smallest node it knows, then its smaller
    ones; distances shrink geometrically, so a chain of n nodes takes about log n rounds. Groups are only ever reduced to their
    minimum, never gathered.
    """
    low = lambda rows, by: rows.groupBy("u").agg(by.alias("m"))
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    nodes = now.select(F.col("u").alias("node")).union(now.select("v")).distinct()
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        least = low(both, F.least(F.min("v"), F.first("u")))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        large = stage(large, "large")
        least = low(large, F.min("v"))
        now = stage(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
