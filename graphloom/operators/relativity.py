"""Forces of a layout in which children circle their parents: orbits, siblings, cousins, and gravity by mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import forces
from graphloom.operators.forces import _sum


def _length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def family(edges: DataFrame, most: int = 100) -> DataFrame:
    """(parent, child, place): children in the order of their ids, for which only the first ``most`` push others: the model's own limit, so that a hub of n children makes n times ``most`` pairs."""
    w = Window.partitionBy("parent").orderBy("child")
    rows = edges.select(F.col("src").alias("parent"), F.col("dst").alias("child")).where("parent != child").distinct()
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def _repelled(pairs: DataFrame, k: Column | float) -> tuple[Column, Column]:
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    d = F.greatest(_length(dx, dy), F.lit(0.01))
    f = k * F.greatest(F.col("mass"), F.lit(1.0)) * F.greatest(F.col("mass2"), F.lit(1.0)) / d
    return f * dx / d, f * dy / d


def _second(points: DataFrame, key: str) -> DataFrame:
    return points.select(F.col("node_id").alias(key), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("mass").alias("mass2"))


def orbit(points: DataFrame, edges: DataFrame, strength: float = 1.0, radius: float = 25.0) -> DataFrame:
    """Pull each child to a circle around its parent whose radius grows with the root of the number of children."""
    rows = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node_id")).where("parent != node_id")
    sizes = rows.groupBy("parent").agg(F.count("*").alias("n"))
    rows = rows.join(sizes, "parent").join(points.select("node_id", "x", "y"), "node_id").join(_second(points.withColumn("mass", F.lit(1.0)), "parent"), "parent")
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    d = _length(dx, dy)
    f = strength * (d - radius * F.sqrt(F.col("n").cast("double"))) / d
    return _sum(rows.where(d > 1e-4).select("node_id", (f * dx).alias("fx"), (f * dy).alias("fy")))


def siblings(points: DataFrame, edges: DataFrame, k: float = 50.0, tangential: float = 2.0, most: int = 100) -> DataFrame:
    """Repulsion k m1 m2 / d among children of one parent; its part across the line to the parent counts ``tangential`` times."""
    kin = family(edges, most)
    every = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node_id")).where("parent != node_id").distinct()
    pairs = every.join(kin.select("parent", F.col("child").alias("other")), "parent").where("node_id != other")
    center = points.select(F.col("node_id").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    rows = pairs.join(points.select("node_id", "x", "y", "mass"), "node_id").join(_second(points, "other"), "other").join(center, "parent")
    fx, fy = _repelled(rows, F.lit(k))
    rx, ry = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    r = _length(rx, ry)
    along = (F.col("_fx") * rx + F.col("_fy") * ry) / (r * r)
    rows = rows.withColumns({"_fx": fx, "_fy": fy}).withColumn("_along", F.when(r > 1e-4, along).otherwise(0.0))
    part = lambda f, c: F.col("_along") * c + tangential * (F.col(f) - F.col("_along") * c)
    far = r > 1e-4
    return _sum(rows.select("node_id", F.when(far, part("_fx", rx)).otherwise(F.col("_fx")).alias("fx"), F.when(far, part("_fy", ry)).otherwise(F.col("_fy")).alias("fy")))


def cousins(points: DataFrame, edges: DataFrame, k: float = 50.0, strength: float = 0.5, most: int = 64) -> DataFrame:
    """Repulsion among children of siblings: the first ``most`` cousins of a node push it, the model's own limit."""
    up = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node_id")).where("parent != node_id").distinct()
    kin = family(edges)
    aunts = up.withColumnRenamed("parent", "grand").withColumnRenamed("node_id", "parent").join(kin.select(F.col("parent").alias("grand"), F.col("child").alias("aunt")), "grand").where("aunt != parent").select("parent", "aunt").distinct()
    first = aunts.join(kin.select(F.col("parent").alias("aunt"), F.col("child").alias("other")), "aunt")
    w = Window.partitionBy("parent").orderBy("other")
    first = first.select("parent", "other").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    rows = up.join(first, "parent").where("node_id != other").join(points.select("node_id", "x", "y", "mass"), "node_id").join(_second(points, "other"), "other")
    fx, fy = _repelled(rows, F.lit(k * strength))
    return _sum(rows.select("node_id", fx.alias("fx"), fy.alias("fy")))


def children(points: DataFrame, edges: DataFrame, k: float = 50.0, strength: float = 0.15, most: int = 100) -> DataFrame:
    """Weak repulsion of a parent by its first children."""
    rows = family(edges, most).select(F.col("parent").alias("node_id"), F.col("child").alias("other")).join(points.select("node_id", "x", "y", "mass"), "node_id").join(_second(points, "other"), "other")
    fx, fy = _repelled(rows, F.lit(k * strength))
    return _sum(rows.select("node_id", fx.alias("fx"), fy.alias("fy")))


def mass_gravity(points: DataFrame, strength: float = 0.01, exponent: float = 0.5, curve: str = "soft", power: float = 1.0, depth_decay: float = 1.0) -> DataFrame:
    """Pull to the origin, the weaker the heavier a node is and the deeper it lies; ``curve`` says how it grows with the distance."""
    d = _length(F.col("x"), F.col("y"))
    curves = {"linear": d, "inverse": 1 / F.greatest(d, F.lit(1.0)), "soft": F.sqrt(d), "custom": F.pow(d, F.lit(power))}
    depth = F.col("depth") if "depth" in points.columns else F.lit(0)
    f = strength / F.pow(F.greatest(F.col("mass"), F.lit(1.0)), F.lit(exponent)) * F.pow(F.lit(depth_decay), depth) * curves[curve]
    return points.where(d > 1e-4).select("node_id", (-f * F.col("x") / d).alias("fx"), (-f * F.col("y") / d).alias("fy"))


def relativity(points: DataFrame, edges: DataFrame, k: float = 50.0, with_cousins: bool = False, density: float = 0.0) -> list[DataFrame]:
    """All forces of the model over points with ``mass``: orbits, siblings, parents, gravity and linear attraction along edges, which keeps families together; cousins and a push down the density of all points on request."""
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    out = [orbit(points, edges), siblings(points, edges, k), children(points, edges, k), mass_gravity(points), forces.linear_attraction(points, edges)]
    if with_cousins:
        out.append(cousins(points, edges, k))
    return [*out, forces.density_repulsion(points, density)] if density else out


def _model(points: DataFrame, edges: DataFrame, c: forces.Config) -> list[DataFrame]:
    """The model for ``forces.MODELS``: masses come from the edges unless the points have them."""
    if "mass" not in points.columns:
        points = points.join(forces.propagate_mass(points, edges), "node_id")
    return relativity(points, edges, c.repulsion)


forces.register("relativity", _model)
