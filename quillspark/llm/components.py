"""Connected components with DataFrame functions: large-star and small-star rounds, the lineage cut after each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v), u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(small, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest reachable node) for each node of a link to a different node.

    links: two columns of one comparable type; direction, repeats, self-links and nulls don't matter. Rounds grow with
    the logarithm of the longest path; only a count and a checksum of each round reach the driver.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges, before = materialise(edges, name), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        old, edges = edges, materialise(_stars(edges), name)
        release(old)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return roots.unionByName(edges.select(F.col("u").alias("node"), F.col("v").alias("component")))
