"""Connected components of an edge table, by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(id, c) for each end of ``edges`` (a, b): c is the least id of its component.

    Each round hooks every label to its least neighbour, follows hooks to hooks, and contracts the
    edges; a round leaves at most the local minima of the contracted graph.
    """
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    labels = cut(ends.select("id", F.col("id").alias("c")), "labels")
    rest = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not rest.isEmpty():
        hooks = cut(rest.groupBy("b").agg(F.min("a").alias("to")), "hooks")
        while True:
            further = hooks.select(F.col("b").alias("to"), F.col("to").alias("next"))
            jumped = cut(hooks.join(further, "to", "left").select("b", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
            discard(hooks)
            hooks = jumped
            if jumped.where("moved").isEmpty():
                break
        by = lambda name: hooks.select(F.col("b").alias(name), F.col("to").alias(name + "_to"))
        named = cut(labels.join(by("c"), "c", "left").select("id", F.coalesce("c_to", "c").alias("c")), "labels")
        discard(labels)
        labels = named
        moved = rest.join(by("a"), "a", "left").join(by("b"), "b", "left").select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y"))
        fewer = cut(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(rest, hooks)
        rest = fewer
    return labels
