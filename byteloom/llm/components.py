"""Connected components of links, by alternating large and small stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom.llm.common import stored


def settled(e: DataFrame) -> bool:
    """Whether links (u, v) are stars: no node has two links out, and none with one has links in."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not nodes.agg(F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))).first()[0]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that a link names, root being the smallest node reachable: a stored table. Nodes are of any type with an order.

    Each round moves all links of a node to its smallest neighbour, so chains shorten geometrically and the rounds end by themselves, with stars. They are written to the shared
    folder; nothing but their being settled comes to the driver. Smallest neighbours are stored before they are joined, so that adaptive execution can split the links of a hub."""
    e = stored(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while not settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "low")
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("x"), "m").where("x != m").unionByName(down.select(F.col("u").alias("x"), "m"))
        e = stored(small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "links")
    return stored(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
