"""Connected components on Spark: alternating large-star and small-star rounds.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).  Each round
rewires edges towards smaller ids by one aggregation and one join that deals a hub's edges out, and is
written to the shared scratch folder, so nothing is collected and a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_weighted, materialise


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Large-star links each node's larger neighbours to its least; small-star its smaller ones."""
    if small:
        sides = edges
    else:
        sides = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight")).select("u", F.least("u", "m").alias("m"), "weight")
    wired = lookup_weighted(sides, materialise(least, "stars"), ["u"])
    if small:  # here u is the larger end, v the smaller
        return wired.select(F.col("v").alias("x"), "m").union(wired.select(F.col("u").alias("x"), "m")).where("x <> m").distinct()
    return wired.where("v > u").select(F.col("v").alias("x"), "m").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that ``edges`` (``u``, ``v`` longs) names; root: its least node."""
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        large = materialise(_stars(now, small=False).select(F.col("x").alias("u"), F.col("m").alias("v")), "edges")
        now = materialise(_stars(large, small=True).select(F.col("x").alias("u"), F.col("m").alias("v")), "edges")
        seal = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seal == before:
            break
        before = seal
    star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.union(star.select(F.col("root").alias("node"), "root").distinct())
