"""Layers of a drawing: which rows each one takes, and settings that tell their own faults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layer_rows(items: DataFrame, layers: dict[str, Column | None]) -> DataFrame:
    """(layer, ...) the rows of ``items``, nodes or edges, once for each layer whose predicate they meet.

    A layer without a predicate takes all rows, and a predicate that is null takes none. All
    layers are told in one scan, without a shuffle.
    """
    if not layers:
        return items.limit(0).select(F.lit("").alias("layer"), *items.columns)
    names = F.array(*[F.lit(name) if p is None else F.when(p, F.lit(name)) for name, p in layers.items()])
    return items.withColumn("_layers", F.array_compact(names)).select(F.explode("_layers").alias("layer"), *items.columns)


def edge_layer_rows(edges: DataFrame, nodes: DataFrame, layers: dict[str, Column | None]) -> DataFrame:
    """(layer, src, dst, ...) the edges with both ends among the layer's nodes, ``nodes`` as from ``layer_rows`` with ``layers`` that tell edges."""
    ends = nodes.select("layer", "node_id").distinct()
    rows = layer_rows(edges, layers)
    for end in ("src", "dst"):
        rows = rows.join(ends.withColumnRenamed("node_id", end), ["layer", end], "left_semi")
    return rows


@dataclass(frozen=True)
class Settings:
    """Settings with ``BOUNDS``: a field's least and most value, and whether it may be as small as the least."""

    BOUNDS = {}

    def faults(self) -> list[str]:
        """The fields that are out of their bounds, each as a sentence; none if all is well. NaN is out of all bounds."""
        found = []
        for field in fields(self):
            if field.name not in self.BOUNDS:
                continue
            least, most, closed = self.BOUNDS[field.name]
            value = getattr(self, field.name)
            values = value if isinstance(value, tuple) else (value,)
            if not values:
                found.append(f"{field.name} needs a value")
            for v in values:
                if not ((v >= least if closed else v > least) and v <= most):
                    found.append(f"{field.name} is {v}, not {'from' if closed else 'above'} {least} to {most}")
        return found


_MOST = float("inf")


@dataclass(frozen=True)
class Heat(Settings):
    """Heat maps; ``source`` is ``density`` or a value stream's name."""

    BOUNDS = {"radius": (0, _MOST, False), "intensity": (0, _MOST, True), "opacity": (0, 1, True), "resolution": (0, 2, False)}
    radius: float = 50.0
    intensity: float = 0.1
    least: float = 0.0
    most: float = 1.0
    opacity: float = 0.7
    scale: str = "viridis"
    resolution: float = 1.0
    source: str = "density"


@dataclass(frozen=True)
class Contour(Settings):
    """Lines of equal density."""

    BOUNDS = {"thresholds": (0, 1, True), "stroke": (0, _MOST, False), "opacity": (0, 1, True), "resolution": (0, 2, False)}
    thresholds: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)
    stroke: float = 1.5
    color: str = "#333333"
    opacity: float = 0.8
    resolution: float = 1.0
    smooth: bool = True
    source: str = "density"


@dataclass(frozen=True)
class Blobs(Settings):
    """Smooth unions of discs."""

    BOUNDS = {"threshold": (0, 1, True), "blend": (0, _MOST, True), "opacity": (0, 1, True), "radius": (0, _MOST, False), "outline": (0, _MOST, True)}
    threshold: float = 0.5
    blend: float = 30.0
    color: str = "#6366f1"
    opacity: float = 0.3
    radius: float = 50.0
    only_outline: bool = False
    outline: float = 2.0
    source: str = "density"
