"""Connected components of links between documents, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of the links (a, b).

    Alternating large-star and small-star rounds (Kiveris et al. 2014).  Each round lowers
    every node towards the smallest of its neighbours.  Minima are aggregated before the
    shuffle and written, so that the joins they meet the links in read shuffled scans alone
    on both sides: there adaptive execution splits a hub's links over tasks.  Rounds are written to
    the shared folder, so lineage stays short and no executor's loss matters.
    """
    edges = written(links.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m"), "least")
        large = written(both.where("b > a").join(least, "a").selectExpr("m as a", "b").where("a <> b").distinct(), "large")
        lower = written(large.groupBy("b").agg(F.min("a").alias("m")), "lower")
        small = large.join(lower, "b")
        small = small.selectExpr("m as a", "a as b").unionByName(small.selectExpr("m as a", "b")).where("a <> b").distinct()
        last, edges = edges, written(small, "links")
        discard(last, least, large, lower)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    stars = edges.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")
    return stars.unionByName(edges.selectExpr("a as node", "a as component").distinct())
