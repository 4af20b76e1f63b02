"""Connected components of a link table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import Stage


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, stage: Stage, name: str = "components") -> DataFrame:
    """(id, component) of every id in ``links`` (long columns a, b); the component is its smallest id.

    Every step is joins and grouped minima, staged before the next: a component of any size,
    and a node with any number of links, is never gathered. Steps needed grow with the
    logarithm of the size. Null ends and self-links are left out.
    """
    edges = stage.put(links.where("a <> b").select("a", "b").distinct(), f"{name}-links")
    mark = None
    while True:
        edges = stage.put(_small(_large(edges)), f"{name}-step")
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    stage.drop(f"{name}-links")
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
