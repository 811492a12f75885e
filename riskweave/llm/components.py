"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import discarded, written_at


EDGES_A_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): the component is its
    smallest node. Alternating large and small stars: each round hooks the neighbours
    of a node to the smallest one, so the rounds grow with the logarithm of the size. A hub is
    one row after the partial minimum; the joins back can be split by AQE. Every
    round is a written table that replaces the one before, and its tasks follow the number of its edges, not the
    shuffle setting; only count and checksum reach the driver."""
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    edges, path = written_at(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or seen == tuple(state):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        tasks = 1 + state["n"] // EDGES_A_TASK
        if seen is None:  # the given edges may lie in very many small files
            loose, (edges, path) = path, written_at(edges.repartition(tasks), "edges")
            discarded(spark, loose)
        seen = tuple(state)
        least = lambda df: df.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        both = edges.coalesce(tasks).unionByName(edges.coalesce(tasks).select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(least(both).select("u", F.least("u", "m").alias("m")), "u")
                 .where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks))
        low = least(large)
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        edges, new = written_at(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "edges")
        discarded(spark, path)
        path = new


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges (i, root) of a spanning forest of the rows that have links."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (before == label).all():
            break
    return [(int(i), int(r)) for i, r in enumerate(label) if i != r]
