"""Connected components of a table of links, by large-star and small-star steps until nothing moves.

Least neighbours are aggregated before they are shuffled and joined back, so a node with very many links is
no single task's work: a join can be split where many rows share one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _sum(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for links (u, v): every linked id with the least id that links reach from it."""
    edges = checkpoint(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _sum(edges)
    while state[0]:
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = _least(edges.union(up)).withColumn("m", F.least("u", "m"))
        large = up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = _least(large)
        small = large.join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        before, state = state, _sum(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
