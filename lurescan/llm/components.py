"""Connected components of links as DataFrame rounds (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescan.llm import common


def connected(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, component): the smallest id reachable, for every id in a link.

    Each round points every node's larger neighbours at its smallest one, then
    every node's smaller neighbours too; the number of rounds grows with the
    logarithm of the longest path.  Only minima travel (map-side combined), and
    a round's edges are written to the shared folder, so lineage stays short.
    The driver sees two numbers a round.

    Cases: no links give an empty result; loops (a, a) and repeats are dropped.
    """
    edges = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where(
        "u > v").distinct()
    edges = common.materialise(edges, "cc-start")
    seen = None
    while True:
        # large star: every node's larger neighbours go to the least of it and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        # small star: a node and its smaller neighbours go to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        edges = common.materialise(small, "cc-round")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component")))
