"""Boundary physics: communities' outlines as convex polygons that push each other apart, frame by frame."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.iterate import stored

#: Radius that a community without an area of its own gets beyond its members, and the corners of the ring that stands for it.
FALLBACK, CORNERS = 20.0, 8


@dataclass(frozen=True)
class Physics:
    """Settings with the usual defaults, held to their ranges."""

    enabled: bool = True
    strength: float = 0.5
    damping: float = 0.9
    most: float = 10.0

    def __post_init__(self):
        for name, high in (("strength", 1.0), ("damping", 1.0), ("most", math.inf)):
            object.__setattr__(self, name, min(max(float(getattr(self, name)), 0.0), high))


def rings(hulls: DataFrame) -> DataFrame:
    """(community, ring): each convex hull (community, ord, x, y) as the array of its corners in order; one of fewer than three corners as a ring of ``CORNERS`` around them."""
    whole = hulls.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))).alias("c"), F.avg("x").alias("mx"), F.avg("y").alias("my"))  # corners of a hull
    ring = F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    far = F.array_max(F.transform("c", lambda p: F.sqrt((p["x"] - F.col("mx")) ** 2 + (p["y"] - F.col("my")) ** 2))) + FALLBACK
    turns = F.array(*[F.struct(F.lit(math.cos(2 * math.pi * k / CORNERS)).alias("x"), F.lit(math.sin(2 * math.pi * k / CORNERS)).alias("y")) for k in range(CORNERS)])
    around = F.transform(turns, lambda p: F.struct((F.col("mx") + far * p["x"]).alias("x"), (F.col("my") + far * p["y"]).alias("y")))
    return whole.select("community", F.when(F.size("c") < 3, around).otherwise(ring).alias("ring"))


def _axes(ring: Column) -> Column:
    """Unit normals of a ring's sides."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    sides = F.zip_with(ring, after, lambda p, q: F.struct((q["y"] - p["y"]).alias("x"), (p["x"] - q["x"]).alias("y")))
    long = lambda s: F.sqrt(s["x"] * s["x"] + s["y"] * s["y"])
    return F.transform(F.filter(sides, lambda s: long(s) > 1e-12), lambda s: F.struct((s["x"] / long(s)).alias("x"), (s["y"] / long(s)).alias("y")))


def overlapping(shapes: DataFrame) -> DataFrame:
    """(community, other, depth, ux, uy) for the pairs of rings (community, ring) that overlap, each both ways: the least way that parts them and the direction of ``community``'s side of it.

    By the separating axis theorem: convex rings are apart if on the normal of some side
    their shadows are; else the normal with the least way parts them soonest, a ring inside
    another included. Rings meet by cells of their boxes' size classes, in the cell of their own
    and the nine around in each larger class, never all with all. Rings that only touch don't
    overlap. Of equal rings the smaller id goes against the normal.
    """
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    boxed = shapes.withColumns({"x0": edge(F.array_min, "x"), "x1": edge(F.array_max, "x"), "y0": edge(F.array_min, "y"), "y1": edge(F.array_max, "y")})
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9))
    sized = boxed.withColumns({"level": F.ceil(F.log2(size)).cast("int"), "bx": (F.col("x0") + F.col("x1")) / 2, "by": (F.col("y0") + F.col("y1")) / 2})
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "level")).cast("long")
    box = ["x0", "x1", "y0", "y1"]
    own = sized.select(F.col("community").alias("other"), F.col("ring").alias("ring2"), *[F.col(c).alias(f"{c}b") for c in box], "level", at("bx").alias("cx"), at("by").alias("cy"))
    levels = [r.level for r in sized.select("level").distinct().collect()]  # powers of two: some dozens at most
    steps = F.sequence(F.lit(-1), F.lit(1))
    looks = sized.withColumn("own", F.col("level")).withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda v: v >= F.col("own"))))
    looks = looks.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps)).withColumns({"cx": at("bx") + F.col("_a"), "cy": at("by") + F.col("_b")})
    met = looks.join(own, ["level", "cx", "cy"]).where("community != other and (own < level or community < other)").where("x0 < x1b and x0b < x1 and y0 < y1b and y0b < y1")
    met = met.select("community", "other", "ring", "ring2", F.concat(_axes(F.col("ring")), _axes(F.col("ring2"))).alias("axes"))

    def parted(axis: Column) -> Column:
        shadow = lambda f, ring: f(F.transform(ring, lambda p: p["x"] * axis["x"] + p["y"] * axis["y"]))
        back = shadow(F.array_max, "ring") - shadow(F.array_min, "ring2")
        forth = shadow(F.array_max, "ring2") - shadow(F.array_min, "ring")
        against = (back < forth) | ((back == forth) & (F.col("community") < F.col("other")))
        sign = F.when(against, -1.0).otherwise(1.0)
        return F.struct(F.least(back, forth).alias("depth"), (sign * axis["x"]).alias("ux"), (sign * axis["y"]).alias("uy"))

    least = met.select("community", "other", F.array_min(F.transform("axes", parted)).alias("m")).where("m.depth > 1e-9").select("community", "other", "m.*")
    return least.union(least.select(F.col("other").alias("community"), F.col("community").alias("other"), "depth", -F.col("ux"), -F.col("uy")))


class Boundaries:
    """Rings in motion: their offsets, velocities and the number of frames. Every frame is stored, so a lost executor costs one."""

    def __init__(self, hulls: DataFrame, physics: Physics = Physics()):
        self.physics, self.iteration, self.has_overlaps = physics, 0, False
        zero = F.lit(0.0)
        self.state = stored(rings(hulls).select("community", "ring", *[zero.alias(c) for c in ("dx", "dy", "vx", "vy")]))

    def configure(self, **settings: float | bool) -> None:
        """Change some settings; switched off, frames move nothing."""
        self.physics = replace(self.physics, **settings)

    def shapes(self) -> DataFrame:
        """(community, ring) where the rings are now."""
        moved = F.transform("ring", lambda p: F.struct((p["x"] + F.col("dx")).alias("x"), (p["y"] + F.col("dy")).alias("y")))
        return self.state.select("community", moved.alias("ring"))

    def update(self) -> DataFrame:
        """One frame: (community, mx, my) of the communities that it moves, ``physics.most`` far at most.

        A community's push is half of ``strength`` times the ways out of all it overlaps; its
        velocity, damped, goes on while it overlaps any and ends with the last.
        """
        self.iteration += 1
        if not self.physics.enabled:
            return self.state.select("community", F.lit(0.0).alias("mx"), F.lit(0.0).alias("my")).limit(0)
        half = 0.5 * self.physics.strength
        pushes = stored(overlapping(self.shapes()).groupBy("community").agg(F.sum(half * F.col("depth") * F.col("ux")).alias("px"), F.sum(half * F.col("depth") * F.col("uy")).alias("py")))
        self.has_overlaps = not pushes.isEmpty()
        going = self.state.join(pushes, "community", "left").withColumns({f"v{c}": F.when(F.col("px").isNull(), 0.0).otherwise(self.physics.damping * F.col(f"v{c}") + F.col(f"p{c}")) for c in ("x", "y")})
        speed = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)
        k = F.when(speed > self.physics.most, self.physics.most / speed).otherwise(1.0)
        going = going.withColumns({"mx": k * F.col("vx"), "my": k * F.col("vy")})
        new = stored(going.select("community", "ring", (F.col("dx") + F.col("mx")).alias("dx"), (F.col("dy") + F.col("my")).alias("dy"), F.col("mx").alias("vx"), F.col("my").alias("vy")))
        self.state = new
        return new.where("vx != 0 or vy != 0").select("community", F.col("vx").alias("mx"), F.col("vy").alias("my"))

    def settle(self, frames: int = 200) -> int:
        """Frames until no rings overlap, ``frames`` at most; how many it took."""
        for n in range(frames):
            self.update()
            if not self.has_overlaps:
                return n
        return frames

    def node_moves(self, points: DataFrame) -> DataFrame:
        """(node_id, dx, dy): how far the members (node_id, community) of the communities that were moved so far go with them."""
        moved = self.state.where("dx != 0 or dy != 0").select("community", "dx", "dy")
        return points.select("node_id", "community").join(moved, "community").select("node_id", "dx", "dy")
