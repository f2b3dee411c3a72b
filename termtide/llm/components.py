"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide.llm.common import written

MAX_ROUNDS = 50


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _to_smallest(edges: DataFrame) -> DataFrame:
    """u, v, m: every edge with the smallest of u and its neighbours in ``edges``."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m"))
    return edges.join(smallest, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges`` (u, v: long, no nulls); component is
    the smallest node of its component.

    Rounds of two steps make every tree flatter: larger neighbours move to the smallest
    neighbour, then smaller ones do. Each round is written, so lineage stays short; rounds grow
    with the logarithm of a component's diameter. No component is gathered in one task.
    """
    def step(e: DataFrame) -> DataFrame:
        large = _to_smallest(_both_ways(e)).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = _to_smallest(small)
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    current = written(edges.select("u", "v").where("u <> v").distinct(), "components")
    state = None
    for _ in range(MAX_ROUNDS):
        current = written(step(current), "components")
        now = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = now
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
