"""Connected components of an edge table, with the smallest node as the component's label.

Alternating star contraction: in a large-star step every node hands its larger
neighbours to the smallest of its neighbourhood, in a small-star step its
smaller ones. The steps are groupings by node with a minimum (combined before
the shuffle) and a join back with the written minima. Both sides of that join
are plain shuffles, which adaptive execution splits where a hub holds a large
share of the edges (its row of the other side is then read by each part).
Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import drop_written, written

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node with an edge (``a, b``, two different nodes); the label is
    the smallest node reachable. Repeated and reversed edges are fine; no edges: no rows."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
        for star in (_large_star, _small_star):
            after, least = star(now)
            after = written(after, "edges")
            drop_written(now)
            drop_written(least)
            now = after
    else:
        raise RuntimeError("components did not settle")
    # every edge now leads from a node to its label
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
