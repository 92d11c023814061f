"""Forces of layout models as sums over pairs, edges and groups, and the tick that applies them.

Pair laws take effect within a cutoff, so pairs come from a grid join; a model returns
(node_id, fx, fy). All forces read the positions before the tick.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.density import density_gradient
from graphloom.operators.iterate import stored
from graphloom.operators.spatial import within_pairs

Law = Callable[[np.ndarray], np.ndarray]

# Defaults of the force models, and the ranges that their settings are clamped to.
@dataclass(frozen=True)
class Config:
    """Parameters of the models, with the usual defaults."""

    repulsion: float = 50.0
    min_distance: float = 1.0
    max_distance: float = 1000.0
    spring: float = 0.1
    length: float = 30.0
    center: float = 0.01
    damping: float = 0.4
    max_velocity: float = 50.0
    dt: float = 1.0
    depth_spread: float = 2.5
    theta: float = 0.8
    collision_strength: float = 0.7
    collision_radius: float = 1.0
    collision_rounds: int = 1
    density_grid: int = 128
    linlog_influence: float = 1.0
    linlog_scaling: float = 0.1
    linlog_gravity: float = 1.0
    tfdp_gamma: float = 2.0
    tfdp_scale: float = 1.0
    tfdp_alpha: float = 0.1
    tfdp_beta: float = 8.0

    def __post_init__(self):
        if not (self.min_distance > 0 and self.max_distance >= self.min_distance and 0 <= self.damping <= 1 and self.dt > 0):
            raise ValueError("force parameters out of range")


RANGES = {
    "theta": (0.1, 2.0), "min_distance": (0.1, math.inf), "max_distance": (0.0, math.inf), "spring": (0.0, math.inf), "length": (1.0, math.inf), "damping": (0.0, 1.0),
    "max_velocity": (1.0, math.inf), "density_grid": (32, 512), "depth_spread": (0.0, 10.0), "collision_strength": (0.0, 1.0), "collision_radius": (0.1, math.inf), "collision_rounds": (1, math.inf),
    "linlog_influence": (0.0, 2.0), "linlog_scaling": (0.001, 100.0), "linlog_gravity": (0.0, 10.0), "tfdp_gamma": (1.0, 5.0), "tfdp_scale": (0.1, 50.0), "tfdp_alpha": (0.01, 1.0), "tfdp_beta": (0.0, 20.0),
}


def clamped(settings: dict, base: Config = Config()) -> Config:
    """``base`` with ``settings`` in their ranges; the density grid's side is a power of two, and t-FDP's attraction stays below the point where all would fall together."""
    if unknown := set(settings) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    held = {k: min(max(v, RANGES[k][0]), RANGES[k][1]) if k in RANGES else v for k, v in settings.items()}
    if "density_grid" in held:
        held["density_grid"] = 2 ** round(math.log2(held["density_grid"]))
    held["max_distance"] = max(held.get("max_distance", base.max_distance), held.get("min_distance", base.min_distance))
    out = replace(base, **held)
    return replace(out, tfdp_beta=1 / out.tfdp_alpha - 1.01) if out.tfdp_alpha * (1 + out.tfdp_beta) >= 1 else out


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node_id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def _pairs(points: DataFrame, law: Callable[[Column], Column], cutoff: float, weight: Column | None = None) -> DataFrame:
    """Sum over pairs of ``law(d)`` along the line from the other point to this one."""
    d = F.sqrt("d2")
    rows = within_pairs(points, cutoff).where("d2 > 1e-8").withColumn("f", law(d) * (weight if weight is not None else F.lit(1.0)) / d)
    return _sum(rows.select("node_id", (F.col("f") * (F.col("x") - F.col("x2"))).alias("fx"), (F.col("f") * (F.col("y") - F.col("y2"))).alias("fy")))


def repulsion(points: DataFrame, c: Config = Config()) -> DataFrame:
    """k / max(d, dmin)^2, the direction shortened below dmin."""
    low = F.lit(c.min_distance)
    return _pairs(points, lambda d: c.repulsion / F.pow(F.greatest(d, low), 2) * d / F.greatest(d, low), c.max_distance)


def degree_repulsion(points: DataFrame, c: Config = Config(), scaling: float = 0.1) -> DataFrame:
    """k (deg_i + 1)(deg_j + 1) / d over points with ``degree``."""
    return _pairs(points, lambda d: scaling * c.repulsion / F.greatest(d, F.lit(0.01)), c.max_distance, (F.col("degree") + 1) * (F.col("degree2") + 1))


def gravity(points: DataFrame, strength: float, mass: str = "degree", strong: bool = False) -> DataFrame:
    """Pull to the origin by mass + 1, growing with the distance if ``strong``."""
    d = F.greatest(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), F.lit(0.01))
    k = strength * (F.col(mass) + 1) * (F.lit(1.0) if strong else 1 / d)
    return points.select("node_id", (-k * F.col("x")).alias("fx"), (-k * F.col("y")).alias("fy"))


def student_repulsion(points: DataFrame, c: Config = Config(), gamma: float = 2.0) -> DataFrame:
    """max(k d / (1 + d^2)^gamma, 0.3 k): a bounded short-range force."""
    return _pairs(points, lambda d: F.greatest(c.repulsion * d / F.pow(1 + d * d, gamma), F.lit(0.3 * c.repulsion)), c.max_distance)


def community_repulsion(points: DataFrame, c: Config = Config(), inner: float = 0.5, outer: float = 1.5) -> DataFrame:
    """Repulsion by square-root masses, weaker within a community and stronger between; points have ``degree`` and ``community``."""
    mass = F.sqrt(F.col("degree") + 1.0) * F.sqrt(F.col("degree2") + 1.0)
    factor = F.when(F.col("community") == F.col("community2"), inner).otherwise(outer)
    return _pairs(points, lambda d: c.repulsion / F.pow(F.greatest(d, F.lit(c.min_distance)), 2), c.max_distance, mass * factor)


def _along_edges(points: DataFrame, edges: DataFrame, law: Callable[[Column, Column], Column]) -> DataFrame:
    """``law(d, weight)`` pulls both ends of each edge together."""
    a = points.select(F.col("node_id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = points.select(F.col("node_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = edges.join(a, "src").join(b, "dst").withColumns({"dx": dx, "dy": dy, "d": F.sqrt(dx * dx + dy * dy)}).where("d > 1e-4")
    f = law(F.col("d"), F.col("weight")) / F.col("d")
    ends = F.array(F.struct(F.col("src").alias("node_id"), (f * F.col("dx")).alias("fx"), (f * F.col("dy")).alias("fy")), F.struct(F.col("dst").alias("node_id"), (-f * F.col("dx")).alias("fx"), (-f * F.col("dy")).alias("fy")))
    return _sum(rows.select(F.explode(ends).alias("e")).select("e.*"))


def springs(points: DataFrame, edges: DataFrame, c: Config = Config()) -> DataFrame:
    return _along_edges(points, edges, lambda d, w: c.spring * (d - c.length))


def linlog_attraction(points: DataFrame, edges: DataFrame, influence: float = 1.0) -> DataFrame:
    return _along_edges(points, edges, lambda d, w: F.pow(w, influence) * F.log1p(d))


def linear_attraction(points: DataFrame, edges: DataFrame, influence: float = 1.0) -> DataFrame:
    return _along_edges(points, edges, lambda d, w: F.pow(w, influence) * d)


def student_attraction(points: DataFrame, edges: DataFrame, alpha: float = 0.1, beta: float = 8.0) -> DataFrame:
    return _along_edges(points, edges, lambda d, w: alpha * d + beta * d / (1 + d * d))


def cluster_attraction(points: DataFrame, strength: float = 0.1) -> DataFrame:
    """Pull to the community's centre by sqrt(degree + 1) / sqrt(members)."""
    centers = points.groupBy("community").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("members"))
    k = strength * F.sqrt(F.col("degree") + 1.0) / F.sqrt(F.col("members").cast("double"))
    return points.join(centers, "community").select("node_id", (k * (F.col("mx") - F.col("x"))).alias("fx"), (k * (F.col("my") - F.col("y"))).alias("fy"))


def target_spring(points: DataFrame, targets: DataFrame, stiffness: float = 0.3, damping: float = 0.5) -> DataFrame:
    """Pull to (tx, ty), levelling off near it; nodes without a target aren't pulled."""
    dx, dy = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    k = stiffness * (1 - F.exp(-F.sqrt(dx * dx + dy * dy) * damping))
    return points.join(targets.where("tx is not null and ty is not null"), "node_id").select("node_id", (k * dx).alias("fx"), (k * dy).alias("fy"))


#: Points a finest cell holds at most where the tree can go deeper, and the deepest level.
LEAF, DEEPEST = 64, 20


def _tree(points: DataFrame, weight: Column, group: Column) -> tuple[DataFrame, DataFrame, int]:
    """Points (node_id, w, spot), spots (spot, g, x, y, w, ix, iy) that hold all points of one place and group, and the number of levels: as many as leave no crowded cell.

    Where even the deepest level has crowded cells, narrower than a millionth of the layout,
    each of its cells is one spot at its points' centre of mass.
    """
    box = points.agg(F.count("*"), F.min("x"), F.min("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9))).first()
    n, low_x, low_y, extent = box[0], box[1] or 0.0, box[2] or 0.0, box[3] or 1.0
    at = lambda c, low: F.least(F.greatest(F.floor((F.col(c) - low) / extent * (1 << DEEPEST)), F.lit(0)), F.lit((1 << DEEPEST) - 1)).cast("long")
    cells = stored(points.select("node_id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"), weight.cast("double").alias("w"), group.alias("g"), at("x", low_x).alias("ix"), at("y", low_y).alias("iy")))
    spots = cells.groupBy("g", "x", "y", "ix", "iy").agg(F.sum("w").alias("w"))
    first = min(DEEPEST, max(2, math.ceil(math.log(max(n, 1) / 4 + 1, 4))))
    by_level = spots.select("g", F.explode(F.sequence(F.lit(first), F.lit(DEEPEST))).alias("level"), "ix", "iy")
    up = lambda c: F.expr(f"shiftright({c}, {DEEPEST} - level)")
    crowds = by_level.groupBy("g", "level", up("ix").alias("cx"), up("iy").alias("cy")).agg(F.count("*").alias("n")).groupBy("level").agg(F.max("n").alias("n"))
    levels = min((r[0] for r in crowds.where(F.col("n") <= LEAF).collect()), default=0)
    key = ["x", "y"] if levels else ["ix", "iy"]
    if not levels:
        levels, w = DEEPEST, F.sum("w")
        spots = spots.groupBy("g", "ix", "iy").agg(w.alias("w"), (F.sum(F.col("w") * F.col("x")) / w).alias("x"), (F.sum(F.col("w") * F.col("y")) / w).alias("y"))
    spot = F.struct("g", *[F.col(c).cast("double").alias(f"k{i}") for i, c in enumerate(key)]).alias("spot")
    spots = stored(spots.select(spot, "g", "x", "y", "w", *[F.shiftright(c, DEEPEST - levels).alias(c) for c in ("ix", "iy")]))
    return cells.select("node_id", "w", spot), spots, levels


#: Levels of the tree below a block: a task computes a block of 4^3 finest cells at a time, at most 64 * ``LEAF`` spots.
BELOW = 3


def _block_forces(law: Law, ring: int, levels: int, top: int, longest: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """Forces on the spots of one block at level ``top``, from its own and near spots (level 0) and the cells of each level that it needs."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        level, cx, cy, px, py, pw = (rows.column(c).to_numpy() for c in ("level", "cx", "cy", "x", "y", "w"))
        spot, side = level == 0, levels - top
        own = np.flatnonzero(spot & (cx >> side == key[1].as_py()) & (cy >> side == key[2].as_py()))
        x, y, fx, fy, met = px[own], py[own], np.zeros(len(own)), np.zeros(len(own)), np.zeros(len(own), np.int64)
        for at_level in range(levels, 0, -1):
            ux, uy = cx[own] >> levels - at_level, cy[own] >> levels - at_level
            cells = np.flatnonzero(level == at_level)
            for cell in np.unique(np.stack([ux, uy]), axis=1).T if len(own) else ():
                mine = np.flatnonzero((ux == cell[0]) & (uy == cell[1]))
                away = np.maximum(abs(cx[cells] - cell[0]), abs(cy[cells] - cell[1]))
                above = np.maximum(abs((cx[cells] >> 1) - (cell[0] >> 1)), abs((cy[cells] >> 1) - (cell[1] >> 1)))
                by = cells[(away > ring) & (above <= ring)]
                if at_level == levels:
                    near = spot & (np.maximum(abs(cx - cell[0]), abs(cy - cell[1])) <= ring)
                    by, met[mine] = np.append(by, np.flatnonzero(near)), -1  # itself
                if not len(by):
                    continue
                dx, dy = x[mine, None] - px[by], y[mine, None] - py[by]
                d = np.sqrt(dx * dx + dy * dy)
                acts = (d > 1e-4) & (d <= longest)
                d = np.where(acts, d, 1.0)
                f = np.where(acts, law(d) * pw[by] / d, 0.0)
                fx[mine] += (f * dx).sum(axis=1)
                fy[mine] += (f * dy).sum(axis=1)
                met[mine] += len(by)
        pushed = met > 0
        return pa.table([rows.column("spot").take(pa.array(own[pushed])), pa.array(fx[pushed]), pa.array(fy[pushed])], ["spot", "_fx", "_fy"])

    return run


def tree_forces(points: DataFrame, law: Law, c: Config = Config(), weight: Column | None = None, group: Column | None = None) -> DataFrame:
    """Sums over pairs of ``law(d)``, a function of arrays, times both weights, far points taken together as in Barnes and Hut's tree; with a ``group`` over pairs within one group only.

    Points at one place push each other by nothing and all others alike: they are one spot
    with their weights summed. The tree's levels are grids of halved cells. A cell as wide as s
    at a distance d stands for its spots if s < theta * d holds wherever in their cells the two
    are: they are ``ceil(1 / theta)`` cells or more apart. On each level a cell meets the cells
    that are so far apart while their parents aren't, a bounded list; on the finest level the
    near cells' spots meet each other. So work grows with points times levels. Cells and spots go
    to the blocks that need them, which are ``BELOW`` levels above the finest and bounded like
    these; a block is one group's task. Distances over ``c.max_distance`` don't count.
    """
    ring = max(1, math.ceil(1 / c.theta))
    nodes, grid, levels = _tree(points, F.lit(1.0) if weight is None else weight, F.lit(0) if group is None else group)
    top = max(0, levels - BELOW)
    w = F.sum("w")
    up = lambda col: F.expr(f"shiftright({col}, {levels} - level)")
    every = grid.select("g", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"), "ix", "iy", "x", "y", "w")
    cells = every.groupBy("g", "level", up("ix").alias("cx"), up("iy").alias("cy")).agg((F.sum(F.col("w") * F.col("x")) / w).alias("x"), (F.sum(F.col("w") * F.col("y")) / w).alias("y"), w.alias("w"))
    cells = stored(cells) if top else cells

    def sent(rows: DataFrame, far: int, below: Column) -> DataFrame:
        """``rows`` once for each block that reaches them with ``far`` cells of their level, which is ``below`` levels under the blocks."""
        least = [F.greatest(F.call_function("shiftright", F.col(i) - far, below), F.lit(0)) for i in ("cx", "cy")]
        most = [F.least(F.call_function("shiftright", F.col(i) + far, below), F.lit((1 << top) - 1)) for i in ("cx", "cy")]
        return rows.withColumn("bx", F.explode(F.sequence(least[0], most[0]))).withColumn("by", F.explode(F.sequence(least[1], most[1])))

    columns = ["g", "bx", "by", "level", "cx", "cy", "x", "y", "w", "spot"]
    none = F.lit(None).cast(grid.schema["spot"].dataType).alias("spot")
    spots = grid.select("g", F.lit(0).alias("level"), F.col("ix").alias("cx"), F.col("iy").alias("cy"), "x", "y", "w", "spot")
    met = sent(spots, ring, F.lit(levels - top)).select(columns)
    met = met.union(sent(cells.where(F.col("level") > top).select("*", none), 2 * ring + 1, F.col("level") - top).select(columns))
    if top:
        blocks = cells.where(F.col("level") == top).select("g", F.col("cx").alias("bx"), F.col("cy").alias("by"), F.explode(F.sequence(F.lit(1), F.lit(top))).alias("level"))
        for i in ("x", "y"):
            blocks = blocks.withColumn(f"t{i}", F.expr(f"shiftright(b{i}, {top} - level)")).withColumn(f"c{i}", F.explode(F.sequence(F.col(f"t{i}") - 2 * ring - 1, F.col(f"t{i}") + 2 * ring + 1)))
        far = F.greatest(F.abs(F.col("cx") - F.col("tx")), F.abs(F.col("cy") - F.col("ty"))) > ring
        above = F.greatest(*[F.abs(F.shiftright(f"c{i}", 1) - F.shiftright(f"t{i}", 1)) for i in ("x", "y")]) <= ring
        met = met.union(blocks.where(far & above).join(cells, ["g", "level", "cx", "cy"]).select("*", none).select(columns))
    schema = T.StructType([grid.schema["spot"], T.StructField("_fx", T.DoubleType()), T.StructField("_fy", T.DoubleType())])
    pushed = met.groupBy("g", "bx", "by").applyInArrow(_block_forces(law, ring, levels, top, c.max_distance), schema)
    return nodes.join(pushed, "spot").select("node_id", (F.col("w") * F.col("_fx")).alias("fx"), (F.col("w") * F.col("_fy")).alias("fy"))


def far_degree_repulsion(points: DataFrame, c: Config = Config(), scaling: float = 0.1) -> DataFrame:
    """``degree_repulsion`` by ``tree_forces``."""
    return tree_forces(points, lambda d: scaling * c.repulsion / np.maximum(d, 0.01), c, F.col("degree") + 1)


def far_student_repulsion(points: DataFrame, c: Config = Config(), gamma: float = 2.0) -> DataFrame:
    """``student_repulsion`` by ``tree_forces``."""
    return tree_forces(points, lambda d: np.maximum(c.repulsion * d / (1 + d * d) ** gamma, 0.3 * c.repulsion), c)


def far_community_repulsion(points: DataFrame, c: Config = Config(), inner: float = 0.5, outer: float = 1.5) -> DataFrame:
    """``community_repulsion`` by two trees: ``outer`` times the push of all, less the difference for those of the own community. Points without a community belong to none."""
    law = lambda k: lambda d: k * c.repulsion / np.maximum(d, c.min_distance) ** 2
    mass = F.sqrt(F.col("degree") + 1.0)
    own = tree_forces(points.where("community is not null"), law(inner - outer), c, mass, F.col("community"))
    return _sum(tree_forces(points, law(outer), c, mass).unionByName(own))


def far_repulsion(points: DataFrame, c: Config = Config()) -> DataFrame:
    """``repulsion`` by ``tree_forces``."""
    low = c.min_distance
    return tree_forces(points, lambda d: c.repulsion / np.maximum(d, low) ** 2 * d / np.maximum(d, low), c)


def density_repulsion(points: DataFrame, strength: float = 50.0, size: int = 128, splat: float = 3.0) -> DataFrame:
    """Push down the slope of the points' density: each point is spread over the cells within ``splat`` as a Gaussian, and takes minus half the central difference at its cell.

    The grid has ``size`` cells along the longer side of the points' box. Work is a fixed
    number of cells a point, however dense they lie.
    """
    box = points.agg(F.min("x").alias("low_x"), F.min("y").alias("low_y"), (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1.0)) / size).alias("side"))
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"low_{c}")) / F.col("side")), F.lit(size - 1)).cast("long")
    own = stored(points.crossJoin(F.broadcast(box)).select("node_id", at("x").alias("cx"), at("y").alias("cy")))
    reach = math.ceil(splat)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    d2 = F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")
    spread = own.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps)).where(d2 <= splat * splat)
    grid = spread.groupBy((F.col("cx") + F.col("_a")).alias("cx"), (F.col("cy") + F.col("_b")).alias("cy")).agg(F.sum(F.exp(-2.0 * d2 / (splat * splat))).alias("density"))
    inside = F.col("cx").between(0, size - 1) & F.col("cy").between(0, size - 1)
    return own.join(density_gradient(grid.where(inside), strength), ["cx", "cy"]).select("node_id", "fx", "fy")


def propagate_mass(nodes: DataFrame, edges: DataFrame, base: float = 1.0, child: float = 0.5, rounds: int = 20) -> DataFrame:
    """(node_id, mass): base plus ``child`` times the children's masses, ``rounds`` times over."""
    out_degree = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("d"))
    start = nodes.select("node_id").join(out_degree, "node_id", "left").select("node_id", (base + 0.1 * F.coalesce("d", F.lit(0))).alias("mass"))
    state = stored(start)
    for turn in range(rounds):
        sums = edges.join(state, edges.dst == state.node_id).groupBy(F.col("src").alias("node_id")).agg(F.sum("mass").alias("s"))
        state = nodes.select("node_id").join(sums, "node_id", "left").select("node_id", (base + child * F.coalesce("s", F.lit(0.0))).alias("mass"))
        if turn % 5 == 4:
            state = stored(state)
    return state


def integrate(points: DataFrame, forces: list[DataFrame], c: Config = Config(), alpha: float = 1.0, pinned: str | None = None) -> DataFrame:
    """One tick: velocities damped, pushed by all forces and the pull to the centre, clamped, and added to the positions; pinned nodes stay."""
    total = _sum(reduce(DataFrame.unionByName, forces))
    have = points.columns
    vx, vy = (F.col(v) if v in have else F.lit(0.0) for v in ("vx", "vy"))
    depth = F.col("depth") if "depth" in have else F.lit(0)
    a = F.least(alpha * (1 + depth * c.depth_spread), F.lit(1.0)) * c.dt
    fx, fy = (F.coalesce(f, F.lit(0.0)) - c.center * F.col(p) for f, p in (("fx", "x"), ("fy", "y")))
    moved = points.join(total, "node_id", "left").withColumns({"_vx": vx * (1 - c.damping) + fx * a, "_vy": vy * (1 - c.damping) + fy * a})
    speed = F.sqrt(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy"))
    slow = F.when(speed > c.max_velocity, c.max_velocity / speed).otherwise(F.lit(1.0))
    moved = moved.withColumns({"_vx": F.col("_vx") * slow, "_vy": F.col("_vy") * slow})
    hold = F.coalesce(F.col(pinned), F.lit(False)) if pinned else F.lit(False)
    new = {"vx": F.when(hold, 0.0).otherwise(F.col("_vx")), "vy": F.when(hold, 0.0).otherwise(F.col("_vy")), "x": F.when(hold, F.col("x")).otherwise(F.col("x") + F.col("_vx") * c.dt), "y": F.when(hold, F.col("y")).otherwise(F.col("y") + F.col("_vy") * c.dt)}
    return moved.withColumns(new).drop("fx", "fy", "_vx", "_vy")


def collide(points: DataFrame, c: Config = Config(), largest: float | None = None) -> DataFrame:
    """Overlapping discs pushed half their overlap apart; of two at one place only the lower id moves."""
    if largest is None:
        largest = points.agg(F.max("radius")).first()[0] or 1.0
    pairs = within_pairs(points.select("node_id", "x", "y", "radius"), max(2 * largest, 1.0))
    d = F.sqrt("d2")
    overlap = F.col("radius") + F.col("radius2") - d
    push = 0.5 * c.collision_strength * overlap
    angle = F.col("node_id") * 2.399963229728653
    fx = F.when(d > 1e-4, push * (F.col("x") - F.col("x2")) / d).when(F.col("node_id") < F.col("node_id2"), push * F.cos(angle)).otherwise(0.0)
    fy = F.when(d > 1e-4, push * (F.col("y") - F.col("y2")) / d).when(F.col("node_id") < F.col("node_id2"), push * F.sin(angle)).otherwise(0.0)
    moves = _sum(pairs.where(overlap > 0).select("node_id", fx.alias("fx"), fy.alias("fy")))
    return points.join(moves, "node_id", "left").withColumns({"x": F.col("x") + F.coalesce("fx", F.lit(0.0)), "y": F.col("y") + F.coalesce("fy", F.lit(0.0))}).drop("fx", "fy")


def _tfdp(p: DataFrame, e: DataFrame, c: Config) -> list[DataFrame]:
    return [student_repulsion(p, replace(c, repulsion=c.repulsion * c.tfdp_scale), c.tfdp_gamma), student_attraction(p, e, c.tfdp_alpha, c.tfdp_beta)]


#: Models by name: functions of (points, edges, config) that return lists of forces; points have what the model reads (degree, community, tx and ty).
MODELS: dict[str, Callable[[DataFrame, DataFrame, Config], list[DataFrame]]] = {
    "n2": lambda p, e, c: [repulsion(p, c), springs(p, e, c)],
    "barnes-hut": lambda p, e, c: [far_repulsion(p, c), springs(p, e, c)],
    "density": lambda p, e, c: [density_repulsion(p, c.repulsion, c.density_grid), springs(p, e, c)],
    "force-atlas2": lambda p, e, c: [degree_repulsion(p, c), gravity(p, 10 * c.center), springs(p, e, c)],
    "linlog": lambda p, e, c: [degree_repulsion(p, c, c.linlog_scaling), gravity(p, 10 * c.linlog_gravity * c.center), linlog_attraction(p, e, c.linlog_influence)],
    "t-fdp": _tfdp,
    "community": lambda p, e, c: [community_repulsion(p, c), cluster_attraction(p), springs(p, e, c)],
    "tidy-tree": lambda p, e, c: [target_spring(p, p.select("node_id", "tx", "ty"))],
    "codebase": lambda p, e, c: [community_repulsion(p, c, 0.5, 1.5), target_spring(p, p.select("node_id", "tx", "ty"))],
}


def register(name: str, model: Callable[[DataFrame, DataFrame, Config], list[DataFrame]]) -> None:
    if name in MODELS:
        raise ValueError(f"model {name} exists")
    MODELS[name] = model


#: Models whose pair laws go through the tree: those to take for more than a few thousand points.
MODELS |= {
    "force-atlas2-tree": lambda p, e, c: [far_degree_repulsion(p, c), gravity(p, 10 * c.center), linear_attraction(p, e)],
    "linlog-tree": lambda p, e, c: [far_degree_repulsion(p, c, c.linlog_scaling), gravity(p, 10 * c.linlog_gravity * c.center), linlog_attraction(p, e, c.linlog_influence)],
    "t-fdp-tree": lambda p, e, c: [far_student_repulsion(p, replace(c, repulsion=c.repulsion * c.tfdp_scale), c.tfdp_gamma), student_attraction(p, e, c.tfdp_alpha, c.tfdp_beta)],
    "community-tree": lambda p, e, c: [far_community_repulsion(p, c), cluster_attraction(p), springs(p, e, c)],
}


def recommended(n_nodes: int) -> str:
    return "n2" if n_nodes < 5_000 else "barnes-hut" if n_nodes < 50_000 else "density"


def progressive_damping(damping: float, alpha: float) -> float:
    """What is kept of a velocity: less as the layout cools, a twentieth at least."""
    return max(0.05, 1 - damping - 0.12 * (1 - alpha))


def anchored(points: DataFrame, node: int, x: float = 0.0, y: float = 0.0) -> DataFrame:
    """``points`` with one node held at the centre, at rest."""
    own = F.col("node_id") == node
    at = {"x": x, "y": y, "vx": 0.0, "vy": 0.0}
    return points.withColumns({c: F.when(own, F.lit(v)).otherwise(F.col(c)) for c, v in at.items() if c in points.columns})


def layout(points: DataFrame, edges: DataFrame, model: str = "n2", ticks: int = 50, c: Config = Config(), alpha: float = 1.0, decay: float = 0.0002, still: float = 0.75) -> DataFrame:
    """Ticks until the largest move is under ``still`` or ``ticks`` are over; the rows are stored each tick."""
    state = stored(points)
    for _ in range(ticks):
        ahead = integrate(state.withColumns({"_x": F.col("x"), "_y": F.col("y")}), MODELS[model](state, edges, c), c, alpha)
        new = stored(ahead)
        moved = new.agg(F.max(F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2))).first()[0]
        state, alpha = new.drop("_x", "_y"), alpha * (1 - decay)
        if moved is None or moved < still:
            break
    return state
