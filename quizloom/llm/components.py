"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm._shared import staged


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
    least = both.groupBy("v").agg(F.min("m").alias("_least")).select(F.col("v").alias("_v"), F.least("v", "_least").alias("_least"))
    return both.join(least, F.col("v") == F.col("_v")).where("m > v").select(F.col("m").alias("v"), F.col("_least").alias("m")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("v").agg(F.min("m").alias("_least")).select(F.col("v").alias("_v"), "_least")
    hung = edges.join(least, F.col("v") == F.col("_v")).where("m != _least").select(F.col("m").alias("v"), F.col("_least").alias("m"))
    return hung.union(least.select(F.col("_v").alias("v"), F.col("_least").alias("m"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, component) for each vertex that has an edge to another; component is the smallest vertex reachable.

    Each step groups by a vertex with sums combined before the shuffle, and is written to the shared folder; large-star and
    small-star steps need a number of rounds that grows with the logarithm of the longest path. Nothing but a count and a
    checksum comes to the driver. Hot vertices are joined by plain equi-joins, which Spark splits where they are skewed.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct()
    edges = staged(edges, "edges")
    state = _state(edges)
    while state[0]:
        edges = staged(_small_star(_large_star(edges)), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select("v", F.col("m").alias("component")).union(edges.select(F.col("m"), F.col("m")).distinct())
