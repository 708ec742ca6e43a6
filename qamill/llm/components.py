"""Connected components of a link table, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qamill.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(k, label) for every node of ``links`` (a, b): the smallest node of its component.

    Every round takes the least label among a node and its neighbours, then the label of that
    label (pointer jumping), so rounds grow with the logarithm of a component's diameter. Minima
    are combined before each shuffle, so a node with very many links is no hot spot; each round is
    written to the shared folder, and only a flag comes to the driver.
    """
    ends = links.where("a <> b").select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    edges = materialise(ends.distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("u").alias("k")).agg(
        F.least(F.min("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("k").alias("v"), "label"), "v").select(F.col("u").alias("k"), "label")
        least = near.unionByName(labels).groupBy("k").agg(F.min("label").alias("l"))
        jump = labels.select(F.col("k").alias("l"), F.col("label").alias("far"))
        fresh = materialise(least.join(jump, "l").join(
            labels.select("k", F.col("label").alias("was")), "k").select(
            "k", F.least("l", "far").alias("label"), (F.least("l", "far") < F.col("was")).alias("moved")), "labels")
        moved = fresh.where("moved").limit(1).count()
        labels = fresh.select("k", "label")
        if not moved:
            return labels
