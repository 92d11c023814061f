"""Seeded test graphs of any size: every row follows from its number and a hash, so parts are made anywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.graph import Graph


def _uniform(seed: int, *of: Column | str) -> Column:
    """A number in [0, 1) from a seeded hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / F.lit(float(1 << 53))


def _pick(seed: int, n: int | Column, *of: Column | str) -> Column:
    return F.floor(_uniform(seed, *of) * n).cast("long")


def _edges(rows: DataFrame) -> DataFrame:
    return rows.where("src != dst").select("src", "dst", F.lit(1.0).alias("weight"))


def random_graph(spark: SparkSession, nodes: int, edges: int, seed: int = 1, size: float = 500.0) -> Graph:
    """Places and edge ends drawn evenly."""
    n = spark.range(nodes).select(F.col("id").alias("node_id"), ((_uniform(seed, "id") - 0.5) * size).alias("x"), ((_uniform(seed + 1, "id") - 0.5) * size).alias("y"))
    return Graph(n, _edges(spark.range(edges).select(_pick(seed + 2, nodes, "id").alias("src"), _pick(seed + 3, nodes, "id").alias("dst"))))


def clustered_graph(spark: SparkSession, clusters: int, members: int, inside: int = 4, across: float = 0.05, seed: int = 1, radius: float = 300.0) -> Graph:
    """Clusters on a circle; each node has ``inside`` edges in its own and, with the chance ``across``, one to another."""
    total = clusters * members
    n = spark.range(total).select(F.col("id").alias("node_id"), F.floor(F.col("id") / members).alias("community"))
    angle = F.col("community") * (2 * math.pi / clusters)
    n = n.withColumns({"x": radius * F.cos(angle) + (_uniform(seed, "node_id") - 0.5) * 60, "y": radius * F.sin(angle) + (_uniform(seed + 1, "node_id") - 0.5) * 60})
    own = spark.range(total).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(inside)))).select(F.col("id").alias("src"), (F.floor(F.col("id") / members) * members + _pick(seed + 2, members, "id", "k")).alias("dst"))
    other = spark.range(total).where(_uniform(seed + 3, "id") < across).select(F.col("id").alias("src"), _pick(seed + 4, total, "id").alias("dst"))
    return Graph(n, _edges(own.union(other)))


def spiral_graph(spark: SparkSession, nodes: int, arms: int = 3, seed: int = 1) -> Graph:
    """Nodes along spiral arms, each linked to the next of its arm."""
    arm, step = F.col("id") % arms, F.floor(F.col("id") / arms)
    angle = step * 0.1 + arm * (2 * math.pi / arms)
    n = spark.range(nodes).select(F.col("id").alias("node_id"), ((step * 2.0 + 10) * F.cos(angle)).alias("x"), ((step * 2.0 + 10) * F.sin(angle)).alias("y"), arm.alias("community"))
    return Graph(n, _edges(spark.range(max(nodes - arms, 0)).select(F.col("id").alias("src"), (F.col("id") + arms).alias("dst"))))


def social_graph(spark: SparkSession, nodes: int, friends: int = 3, seed: int = 1, skew: float = 2.0) -> Graph:
    """Every node links to ``friends`` earlier ones, low numbers the likelier: hubs as in social networks."""
    n = spark.range(nodes).select(F.col("id").alias("node_id"))
    rows = spark.range(1, max(nodes, 1)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(friends))))
    return Graph(n, _edges(rows.select(F.col("id").alias("src"), F.floor(F.pow(_uniform(seed, "id", "k"), F.lit(skew)) * F.col("id")).cast("long").alias("dst")).distinct()))


def contour_points(spark: SparkSession, nodes: int, peaks: int = 4, seed: int = 1, size: float = 400.0) -> Graph:
    """Points heaped normally around some peaks, without edges."""
    peak = _pick(seed, peaks, "id")
    at = lambda s: (F.shiftrightunsigned(F.xxhash64(F.lit(s), "peak"), 11) / F.lit(float(1 << 53)) - 0.5) * size
    r = F.sqrt(-2 * F.log(F.greatest(_uniform(seed + 1, "id"), F.lit(1e-12)))) * size / 12
    angle = _uniform(seed + 2, "id") * 2 * math.pi
    n = spark.range(nodes).withColumn("peak", peak)
    return Graph(n.select(F.col("id").alias("node_id"), (at(seed + 3) + r * F.cos(angle)).alias("x"), (at(seed + 4) + r * F.sin(angle)).alias("y"), F.col("peak").alias("community")), _edges(spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst"))))


def tree_graph(spark: SparkSession, nodes: int, children: int = 3) -> Graph:
    """A complete tree, numbered level by level from the root 0."""
    return Graph(spark.range(nodes).select(F.col("id").alias("node_id")), _edges(spark.range(1, max(nodes, 1)).select(F.floor((F.col("id") - 1) / children).cast("long").alias("src"), F.col("id").alias("dst"))))


def random_tree(spark: SparkSession, nodes: int, seed: int = 1, across: float = 0.0) -> Graph:
    """Every node hangs below an earlier one; a share of nodes has one more edge to any other."""
    down = spark.range(1, max(nodes, 1)).select(_pick(seed, F.col("id"), "id").alias("src"), F.col("id").alias("dst"))
    more = spark.range(nodes).where(_uniform(seed + 1, "id") < across).select(F.col("id").alias("src"), _pick(seed + 2, nodes, "id").alias("dst"))
    return Graph(spark.range(nodes).select(F.col("id").alias("node_id")), _edges(down.union(more)))


def large_graph(spark: SparkSession, nodes: int = 500_000, degree: int = 2, reach: int = 100, seed: int = 1) -> Graph:
    """Nodes on a sunflower, each with ``degree`` edges to nodes of near numbers."""
    r, angle = 10 * F.sqrt(F.col("id").cast("double")), F.col("id") * (math.pi * (3 - math.sqrt(5)))
    n = spark.range(nodes).select(F.col("id").alias("node_id"), (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))
    rows = spark.range(nodes).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(degree))))
    return Graph(n, _edges(rows.select(F.col("id").alias("src"), F.pmod(F.col("id") + 1 + _pick(seed, reach, "id", "k"), F.lit(nodes)).alias("dst"))))
