"""Connected components of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _towards_smallest(links: DataFrame, larger: bool) -> DataFrame:
    """Every link end moves to the smallest neighbour of its other end."""
    if larger:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = around.join(least, "u")
    if larger:
        moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that links reach.

    Large and small stars alternate until nothing moves; each pass is written to the shared folder.
    """
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
    links = stored(links.select("a", "b").where("a <> b").distinct(), "stars")
    while True:
        before = digest(links)
        if not before[0]:
            break
        links = stored(_towards_smallest(_towards_smallest(links, True), False), "stars")
        if digest(links) == before:
            break
    members = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
