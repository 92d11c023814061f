"""Initial positions as functions of a node's number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOLDEN = math.pi * (3 - math.sqrt(5))


def _polar(r: Column, theta: Column) -> tuple[Column, Column]:
    return r * F.cos(theta), r * F.sin(theta)


def coordinates(strategy: str, i: Column, n: Column, radius: Column, seed: int = 1) -> tuple[Column, Column]:
    """Column expressions of x and y for node number ``i`` of ``n``; an unknown strategy is phyllotaxis."""
    i, n = i.cast("double"), n.cast("double")
    if strategy == "random":
        return _polar(radius * F.sqrt(F.rand(seed)), 2 * math.pi * F.rand(seed + 1))
    if strategy == "grid":
        columns = F.ceil(F.sqrt(n)).cast("double")
        step = 2 * radius / F.greatest(columns - 1, F.lit(1.0))
        return -radius + step * (i % columns), -radius + step * F.floor(i / columns)
    if strategy == "circle":
        return _polar(radius, 2 * math.pi * i / n)
    if strategy == "spiral":
        t = i / F.greatest(n - 1, F.lit(1.0))
        return _polar(radius * t, 6 * math.pi * t)
    return _polar(radius * F.sqrt(i / n), i * GOLDEN)


def place(nodes: DataFrame, strategy: str = "phyllotaxis", radius: float | None = None, order: str = "slot", seed: int = 1) -> DataFrame:
    """``nodes`` (with the number ``order``) placed; the radius is 10 * sqrt(n) unless given."""
    counted = nodes.crossJoin(F.broadcast(nodes.agg(F.count("*").alias("_n"))))  # one row
    r = F.lit(float(radius)) if radius is not None else 10 * F.sqrt(F.col("_n").cast("double"))
    x, y = coordinates(strategy, F.col(order), F.col("_n"), r, seed)
    return counted.withColumns({"x": x, "y": y}).drop("_n")


def jitter(points: DataFrame, amount: float, seed: int = 1) -> DataFrame:
    """Points moved by up to ``amount`` each way."""
    return points.withColumns({"x": F.col("x") + amount * (2 * F.rand(seed) - 1), "y": F.col("y") + amount * (2 * F.rand(seed + 1) - 1)})


def unplaced(points: DataFrame) -> DataFrame:
    """One row: whether every point lies at the origin."""
    return points.agg(F.coalesce(F.max(F.greatest(F.abs("x"), F.abs("y"))) == 0, F.lit(True)).alias("unplaced"))
