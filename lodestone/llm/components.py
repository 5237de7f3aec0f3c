"""Connected components by alternating stars: rounds grow with the logarithm of a component's width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


#: A node's edges are dealt over so many tasks, as a component's root comes to have all its members.
SALTS = 8


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One round: every node's larger (or, if `small`, smaller) neighbours are tied to the least node it knows."""
    if small:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        seen = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    tied = salted.join(least, (F.col("u") == F.col("w")) & (F.col("salt") == F.col("part")))
    if small:
        out = tied.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two edges to smaller ones, or one to a smaller and one from a larger: else the edges are stars."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return bool(nodes.where("up > 1 or up = 1 and down = 1").limit(1).count())


def components(edges: DataFrame) -> DataFrame:
    """node, root: for edges (u, v) of any ordered type, the least node of each node's component; isolated nodes are absent."""
    edges = settled(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _unfinished(edges):
        edges = settled(_stars(_stars(edges, small=False), small=True))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
