"""Connected components by contraction, in a few distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` for every node of ``links`` (``a``, ``b``; undirected, repeats allowed).

    In each round a node moves to the smallest of itself and its neighbours, and links
    between nodes that met disappear. A node that is not the smallest around it
    vanishes, so the rounds grow with the logarithm of a component. Neighbours are
    reduced to a minimum in the map tasks first, so a node may have any number.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = materialize(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")), "moves"
        )
        if labels is None:
            labels = moved.select("node", F.col("to").alias("component"))
        else:
            step = moved.select(F.col("node").alias("component"), "to")
            labels = materialize(
                labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")),
                "labels",
            )
        a = moved.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = moved.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = materialize(
            edges.join(a, "a").join(b, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
