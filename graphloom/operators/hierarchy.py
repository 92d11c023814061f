"""Layouts of trees: bubble radii by levels and circle packing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.iterate import stored
from graphloom.operators.structure import running
from graphloom.operators.trees import siblings


def spanning(nodes: DataFrame, edges: DataFrame, root: int) -> DataFrame:
    """(node_id, parent, depth): the tree of first visits from ``root``, the least parent at each depth; safe on cycles."""
    state = stored(nodes.where(F.col("node_id") == root).select("node_id", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth")))
    front, turn = state, 0
    while not front.isEmpty():
        turn += 1
        new = front.select(F.col("node_id").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("parent"))
        front = stored(new.join(state, "node_id", "left_anti").select("node_id", "parent", F.lit(turn).alias("depth")))
        state = stored(state.unionByName(front))
    return state


def bubble_radii(tree: DataFrame, base: float = 10.0, padding: float = 5.0, fill: float = 0.82) -> DataFrame:
    """(node_id, parent, depth, radius): leaves have ``base``; others hold their children's discs, by levels from below."""
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    done = None
    for depth in range(deepest, -1, -1):
        level = tree.where(F.col("depth") == depth)
        if done is None:
            level = level.withColumn("radius", F.lit(base))
        else:
            sums = done.where(F.col("depth") == depth + 1).groupBy(F.col("parent").alias("node_id")).agg(F.sum(F.col("radius") * F.col("radius")).alias("area"))
            level = level.join(sums, "node_id", "left").withColumn("radius", F.when(F.col("area").isNull(), base).otherwise(F.greatest(F.sqrt(F.col("area") / fill), F.lit(base)) + padding)).drop("area")
        level = level.select("node_id", "parent", "depth", "radius")
        done = stored(level if done is None else done.unionByName(level))
    return done


def spiral(children: DataFrame) -> DataFrame:
    """(parent, i, node_id, radius, dx, dy): children of each parent on a golden spiral, the largest inside; ``i`` counts a parent's from 0."""
    order = F.struct("parent", (-F.col("radius")).alias("r"), "node_id")
    ranked = stored(running(children.select("parent", "node_id", "radius", order.alias("_at")), "_at", F.lit(1)).withColumnRenamed("before", "i"))
    ranked = ranked.join(ranked.groupBy("parent").agg(F.min("i").alias("_i")), "parent").withColumn("i", F.col("i") - F.col("_i")).drop("_i")
    summed = stored(running(ranked, "_at", F.col("radius") / F.sqrt(F.col("i") + 1), "double").drop("_at"))
    reach = F.col("before") - F.col("_first")
    angle = F.col("i") * (math.pi * (3 - math.sqrt(5)))
    first = summed.where("i = 0").select("parent", F.col("before").alias("_first"))
    return summed.join(first, "parent").select("parent", "i", "node_id", "radius", (reach * F.cos(angle)).alias("dx"), (reach * F.sin(angle)).alias("dy"))


def push_apart(discs: DataFrame) -> DataFrame:
    """Each disc moved off its siblings of smaller ``i`` by the sum of the overlaps.

    Siblings meet by (parent, level, cell): a disc lies in the cell, as wide as the next power
    of two above its diameter, of its own level, and looks into the nine cells around it at its own
    and each larger level that its parent has.
    """
    level = F.ceil(F.log2(F.greatest(2 * F.col("radius"), F.lit(1e-9)))).cast("int")
    at = lambda c, by: F.floor(F.col(c) / F.pow(F.lit(2.0), by)).cast("long")
    sized = discs.withColumn("level", level)
    own = sized.select("parent", "level", at("dx", F.col("level")).alias("cx"), at("dy", F.col("level")).alias("cy"), F.col("i").alias("i2"), F.col("dx").alias("x2"), F.col("dy").alias("y2"), F.col("radius").alias("r2"))
    levels = sized.select("parent", F.col("level").alias("l")).distinct()
    looks = sized.join(levels, "parent").where("l >= level").select("parent", F.col("l").alias("level"), "i", "dx", "dy", "radius")
    steps = F.sequence(F.lit(-1), F.lit(1))
    looks = looks.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps)).withColumns({"cx": at("dx", F.col("level")) + F.col("_a"), "cy": at("dy", F.col("level")) + F.col("_b")})
    x, y = F.col("dx") - F.col("x2"), F.col("dy") - F.col("y2")
    met = looks.join(own, ["parent", "level", "cx", "cy"]).where("i > i2")
    met = met.withColumn("d", F.greatest(F.sqrt(x * x + y * y), F.lit(1e-9))).withColumn("over", F.col("radius") + F.col("r2") - F.col("d")).where("over > 0")
    moves = met.groupBy("parent", "i").agg(F.sum(x / F.col("d") * F.col("over")).alias("mx"), F.sum(y / F.col("d") * F.col("over")).alias("my"))
    zero = F.lit(0.0)
    return discs.join(moves, ["parent", "i"], "left").select("parent", "i", "node_id", "radius", (F.col("dx") + F.coalesce("mx", zero)).alias("dx"), (F.col("dy") + F.coalesce("my", zero)).alias("dy"))


def pack_layout(radii: DataFrame, spread: float = 1.5) -> DataFrame:
    """(node_id, x, y): every node placed around its parent, from the root at the origin down.

    Children start on a spiral and are pushed apart in three passes, in families of every size.
    """
    offsets = stored(spiral(radii.where("parent is not null")))
    for _ in range(3):
        offsets = stored(push_apart(offsets))
    offsets = offsets.select("node_id", "dx", "dy")
    steps = radii.join(offsets, "node_id", "left")
    state = stored(steps.where("parent is null").select("node_id", "depth", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    for depth in range(1, (radii.agg(F.max("depth")).first()[0] or 0) + 1):
        up = state.where(F.col("depth") == depth - 1).select(F.col("node_id").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
        new = steps.where(F.col("depth") == depth).join(up, "parent").select("node_id", "depth", (F.col("px") + spread * F.col("dx")).alias("x"), (F.col("py") + spread * F.col("dy")).alias("y"))
        state = stored(state.unionByName(new))
    return state.select("node_id", "x", "y")


# Categories of a code base by their number, and the types of nodes that belong to each.
CATEGORIES = ("repository", "directory", "file", "symbol", "other")
SYMBOLS = ("function", "class", "method", "variable", "interface", "type")


@dataclass(frozen=True)
class Codebase:
    """Sizes of a code base's discs, with the usual defaults."""

    directory_padding: float = 15.0
    file_padding: float = 8.0
    symbol_radius: float = 5.0
    file_radius: float = 12.0
    directory_radius: float = 25.0
    spread: float = 1.5
    fill: float = 0.82

    def base(self, category: Column) -> Column:
        """The least radius of a category: a repository's is twice a directory's, what isn't known is a symbol."""
        return F.when(category == 0, 2 * self.directory_radius).when(category == 1, self.directory_radius).when(category == 2, self.file_radius).otherwise(self.symbol_radius)

    def padding(self, category: Column) -> Column:
        return F.when(category <= 1, self.directory_padding).otherwise(self.file_padding)


def category_of(kind: Column) -> Column:
    """The number of a node type's category in ``CATEGORIES``."""
    return F.when(kind == "repository", 0).when(kind == "directory", 1).when(kind == "file", 2).when(kind.isin(*SYMBOLS), 3).otherwise(4)


def codebase_radii(tree: DataFrame, c: Codebase = Codebase()) -> DataFrame:
    """(node_id, parent, depth, category, radius) for (node_id, parent, depth, category): leaves have their category's base, others hold their children's discs at ``fill`` of the area, the base at least, and the padding. By levels from below."""
    known = stored(tree.select("node_id", "parent", "depth", F.coalesce("category", F.lit(4)).alias("category")))
    deepest = known.agg(F.max("depth")).first()[0] or 0
    base, padding = c.base(F.col("category")), c.padding(F.col("category"))
    level = stored(known.where(F.col("depth") == deepest).withColumn("radius", base))
    out = level
    for depth in range(deepest - 1, -1, -1):
        sums = level.groupBy(F.col("parent").alias("node_id")).agg(F.sum(F.col("radius") * F.col("radius")).alias("area"))
        inner = F.greatest(F.sqrt(F.col("area") / c.fill), base) + padding
        level = stored(known.where(F.col("depth") == depth).join(sums, "node_id", "left").withColumn("radius", F.when(F.col("area").isNull(), base).otherwise(inner)).drop("area"))
        out = out.union(level)
    return out


def _clamped(discs: DataFrame) -> DataFrame:
    """Discs drawn back along the line to their parent's middle where they would reach out of its ``room``."""
    d = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    most = F.greatest(F.col("room") - F.col("radius"), F.lit(0.0))
    k = F.when(d > most, most / d).otherwise(1.0)
    return discs.withColumns({"dx": F.col("dx") * k, "dy": F.col("dy") * k})


def overlaps(discs: DataFrame) -> DataFrame:
    """(parent, i, i2, over, ux, uy): siblings that overlap, each pair both ways, with by how much and the direction away from the other; of two at one place the directions are opposite.

    Siblings meet by cells of a size class, as in ``push_apart``.
    """
    level = F.ceil(F.log2(F.greatest(2 * F.col("radius"), F.lit(1e-9)))).cast("int")
    at = lambda c, by: F.floor(F.col(c) / F.pow(F.lit(2.0), by)).cast("long")
    sized = discs.withColumn("level", level)
    own = sized.select("parent", "level", at("dx", F.col("level")).alias("cx"), at("dy", F.col("level")).alias("cy"), F.col("i").alias("i2"), F.col("dx").alias("x2"), F.col("dy").alias("y2"), F.col("radius").alias("r2"))
    levels = sized.select("parent", F.col("level").alias("l")).distinct()
    looks = sized.join(levels, "parent").where("l >= level").select("parent", F.col("l").alias("level"), F.col("level").alias("own"), "i", "dx", "dy", "radius")
    steps = F.sequence(F.lit(-1), F.lit(1))
    looks = looks.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps)).withColumns({"cx": at("dx", F.col("level")) + F.col("_a"), "cy": at("dy", F.col("level")) + F.col("_b")})
    x, y = F.col("dx") - F.col("x2"), F.col("dy") - F.col("y2")
    met = looks.join(own, ["parent", "level", "cx", "cy"]).where("i != i2 and (own < level or i < i2)").withColumn("d", F.sqrt(x * x + y * y))
    met = met.withColumn("over", F.col("radius") + F.col("r2") - F.col("d")).where("over > 1e-9")
    turn = F.least("i", "i2") * (math.pi * (3 - math.sqrt(5)))
    ux, uy = F.when(F.col("d") > 1e-9, x / F.col("d")).otherwise(F.cos(turn)), F.when(F.col("d") > 1e-9, y / F.col("d")).otherwise(F.sin(turn))
    once = met.select("parent", "i", "i2", "over", ux.alias("ux"), uy.alias("uy"))
    return once.union(once.select("parent", F.col("i2").alias("i"), F.col("i").alias("i2"), "over", -F.col("ux"), -F.col("uy")))


def codebase_layout(tree: DataFrame, c: Codebase = Codebase(), rounds: int = 30, slack: float = 0.05) -> DataFrame:
    """(node_id, x, y, radius): every disc within its parent's, siblings pushed apart, from the root at the origin.

    Children lie on a sunflower inside the parent's room (its radius less the padding), an
    only child in its middle. In each round each overlap moves both discs half of it, a disc
    by the mean over its overlaps at most, and discs that reach out of the room are drawn back
    into it; rounds end when no overlap is over ``slack`` of the smaller disc or after
    ``rounds``. Discs of all families move at once, and none is ever outside its parent; where the
    areas don't leave room for all, overlaps stay, as large as the last round left them.
    """
    sized = stored(codebase_radii(tree, c))
    up = sized.select(F.col("node_id").alias("parent"), F.greatest(F.col("radius") - c.padding(F.col("category")), F.lit(0.0)).alias("room"))
    inner = sized.where("parent is not null").select("node_id", "parent", "radius", (-F.col("radius")).alias("_r"))
    ranked = siblings(inner, "_r").withColumnRenamed("place", "i")
    n = ranked.groupBy("parent").agg(F.count("*").alias("n"))
    rows = ranked.join(n, "parent").join(inner.select("node_id", "radius"), "node_id").join(up, "parent")
    t = F.when(F.col("n") == 2, (F.col("i") + 1) / 3).otherwise((F.col("i") + 0.5) / F.col("n"))
    reach = F.when(F.col("n") == 1, 0.0).otherwise(F.greatest(F.col("room") - F.col("radius"), F.lit(0.0)) * F.sqrt(t))
    angle = F.col("i") * (2 * math.pi * (1 - 2 / (1 + math.sqrt(5))))
    discs = stored(rows.select("parent", "i", "node_id", "radius", "room", (reach * F.cos(angle)).alias("dx"), (reach * F.sin(angle)).alias("dy")))
    for _ in range(rounds):
        met = stored(overlaps(discs).join(discs.select("parent", F.col("i").alias("i2"), F.col("radius").alias("r2")), ["parent", "i2"]))
        pushes = met.groupBy("parent", "i").agg(F.sum(F.col("over") * F.col("ux")).alias("px"), F.sum(F.col("over") * F.col("uy")).alias("py"), F.max(F.col("over") / F.col("r2")).alias("worst"), F.max("over").alias("most"))
        pushes = stored(pushes)
        if not (pushes.agg(F.max("worst")).first()[0] or 0.0) > slack:
            break
        long = F.sqrt(F.col("px") ** 2 + F.col("py") ** 2)
        k = F.when(long > F.col("most"), 0.5 * F.col("most") / long).otherwise(0.5)
        moved = discs.join(pushes, ["parent", "i"], "left").withColumns({"dx": F.col("dx") + F.coalesce(k * F.col("px"), F.lit(0.0)), "dy": F.col("dy") + F.coalesce(k * F.col("py"), F.lit(0.0))})
        discs = stored(_clamped(moved).select("parent", "i", "node_id", "radius", "room", "dx", "dy"))
    level = stored(sized.where("parent is null").select("node_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "radius"))
    out, steps = level, discs.join(sized.select("node_id", "depth"), "node_id")
    for depth in range(1, (sized.agg(F.max("depth")).first()[0] or 0) + 1):
        above = level.select(F.col("node_id").alias("parent"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        level = stored(steps.where(F.col("depth") == depth).join(above, "parent").select("node_id", (F.col("_x") + F.col("dx")).alias("x"), (F.col("_y") + F.col("dy")).alias("y"), "radius"))
        out = out.union(level)
    return out.select("node_id", (c.spread * F.col("x")).alias("x"), (c.spread * F.col("y")).alias("y"), "radius")


def codebase_graph(nodes: DataFrame, edges: DataFrame, root: int | None = None, c: Codebase = Codebase(), **options: float) -> DataFrame:
    """``codebase_layout`` of the edges' first visits from a root, found where none is given. Nodes have ``category`` or ``type``, or count as other; what the root doesn't reach has no row, and without edges there are none."""
    from graphloom.operators.reach import root as find_root
    from graphloom.sources.graph import closed_edges

    valid = stored(closed_edges(nodes, edges.where("src != dst")))
    if valid.isEmpty():
        return nodes.select("node_id", *[F.lit(0.0).alias(v) for v in ("x", "y", "radius")]).limit(0)
    if root is None:
        ends = valid.select(F.col("src").alias("node_id")).union(valid.select("dst")).distinct()
        root = find_root(ends, valid).first()[0]
    number = F.col("category") if "category" in nodes.columns else category_of(F.col("type")) if "type" in nodes.columns else F.lit(4)
    return codebase_layout(spanning(nodes, valid, root).join(nodes.select("node_id", number.alias("category")), "node_id"), c, **options)
