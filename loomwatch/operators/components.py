"""Connected components of a table of links, by alternating star contractions.

Each round is two aggregations and two joins over the links that are left; its result is
written to the shared folder, so lineage stays short and a lost executor costs one round.
Nothing but two numbers a round reaches the driver. The joins are plain equi-joins, whose
skewed keys (large stars) adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwatch.shared import remove, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large star: larger neighbours move to the least; small star: smaller ones do."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u")
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each linked node reaches. Nodes without links aren't listed."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, last = written(edges, "links"), None
    while True:
        new = written(_star(_star(edges, True), False), "links")
        remove(edges)
        edges = new
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = now
