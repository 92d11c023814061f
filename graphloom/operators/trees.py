"""Trees: Euler tours ranked by pointer jumping, and tidy trees by merged outlines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.iterate import stored
from graphloom.operators.structure import running


def siblings(tree: DataFrame, order: str = "node_id") -> DataFrame:
    """(node_id, parent, place): each child's place among its parent's children from 0, by ``order`` and id. Counted over range partitions: no task needs a family whole."""
    rows = tree.where("parent is not null").select("node_id", "parent", F.struct("parent", F.col(order).alias("by"), "node_id").alias("_at"))
    counted = stored(running(rows, "_at", F.lit(1)).select("node_id", "parent", "before"))
    first = counted.groupBy("parent").agg(F.min("before").alias("first"))
    return stored(counted.join(first, "parent").select("node_id", "parent", (F.col("before") - F.col("first")).alias("place")))


def tour(tree: DataFrame, order: str = "node_id") -> DataFrame:
    """(node_id, root, pre, post, size, depth) of every node of a forest (node_id, parent).

    ``pre`` and ``post`` count from 0 in the order of a depth-first walk that takes children by
    ``order`` and id; ``size`` is the node with all below it. Each node is an arc down and an arc
    up; arcs point to the one before them, and pointers double in each round while the arcs
    passed add up (list ranking), so that rounds are the logarithm of the number of nodes, chains
    included. An arc has one follower, so that no join has a hot key. A parent that is no node
    of the forest counts as none. On circles, which are no forest, it raises an error.
    """
    rows = stored(tree.select("node_id", "parent", F.col(order).alias("_by")))
    known = rows.select(F.col("node_id").alias("parent"), F.lit(True).alias("_has"))
    rows = stored(rows.join(known, "parent", "left").select("node_id", F.when(F.col("_has"), F.col("parent")).alias("parent"), "_by"))
    kids = siblings(rows, "_by")
    older = kids.select(F.col("node_id").alias("older"), "parent", (F.col("place") + 1).alias("place"))
    last = kids.groupBy(F.col("parent").alias("node_id")).agg(F.max_by("node_id", "place").alias("last"))
    before = kids.join(older, ["parent", "place"], "left").select("node_id", "older")
    linked = rows.select("node_id", "parent").join(before, "node_id", "left").join(last, "node_id", "left")
    arc = lambda node, up: F.struct(node.alias("node"), up.alias("up"))
    node, parent, older, last = map(F.col, ("node_id", "parent", "older", "last"))
    down = F.when(older.isNotNull(), arc(older, F.lit(1))).when(parent.isNotNull(), arc(parent, F.lit(0)))
    up = F.when(last.isNotNull(), arc(last, F.lit(1))).otherwise(arc(node, F.lit(0)))
    arcs = linked.select(F.explode(F.array(F.struct(arc(node, F.lit(0)).alias("at"), down.alias("to"), F.lit(1).cast("long").alias("downs"), F.lit(0).cast("long").alias("ups")), F.struct(arc(node, F.lit(1)).alias("at"), up.alias("to"), F.lit(0).cast("long").alias("downs"), F.lit(1).cast("long").alias("ups")))).alias("a")).select("a.*")
    state = stored(arcs.withColumn("root", F.when(F.col("to").isNull(), F.col("at.node"))))
    most = 2 * rows.count()
    done, passed = state.where("to is null"), 1
    ahead = state.where("to is not null")
    finished = [done]
    while not ahead.isEmpty():
        if passed > most:
            raise ValueError("the parents run in a circle")
        all_now = finished[0]
        for more in finished[1:]:
            all_now = all_now.union(more)
        other = all_now.union(ahead).select(F.col("at").alias("to"), F.col("to").alias("beyond"), F.col("downs").alias("d"), F.col("ups").alias("u"), F.col("root").alias("r"))
        jumped = stored(ahead.drop("root").join(other, "to").select("at", F.col("beyond").alias("to"), (F.col("downs") + F.col("d")).alias("downs"), (F.col("ups") + F.col("u")).alias("ups"), F.col("r").alias("root")))
        finished.append(jumped.where("to is null"))
        ahead, passed = jumped.where("to is not null"), 2 * passed
    ranked = finished[0]
    for more in finished[1:]:
        ranked = ranked.union(more)
    both = ranked.groupBy(F.col("at.node").alias("node_id")).agg(
        F.first("root").alias("root"),
        *[F.max(F.when(F.col("at.up") == side, F.col(c))).alias(f"{c}_{name}") for side, name in ((0, "in"), (1, "out")) for c in ("downs", "ups")],
    )
    return both.select("node_id", "root", (F.col("downs_in") - 1).alias("pre"), (F.col("ups_out") - 1).alias("post"), (F.col("downs_out") - F.col("downs_in") + 1).alias("size"), (F.col("downs_in") - 1 - F.col("ups_in")).alias("depth"))


def _merged(blocks: DataFrame, separation: F.Column) -> DataFrame:
    """Neighbouring blocks of each family put together two by two: the right one moved until every level that both reach is apart."""
    side = lambda c, bit: F.max(F.when(F.col("block") % 2 == bit, F.col(c)))
    pairs = blocks.groupBy("parent", F.floor(F.col("block") / 2).cast("long").alias("block"), "depth").agg(side("low", 0).alias("al"), side("high", 0).alias("ah"), side("low", 1).alias("bl"), side("high", 1).alias("bh"))
    moved = pairs.withColumn("shift", F.max(F.col("ah") + separation - F.col("bl")).over(Window.partitionBy("parent", "block")))
    return moved.select("parent", "block", "depth", F.coalesce("al", F.col("bl") + F.col("shift")).alias("low"), F.coalesce(F.col("bh") + F.col("shift"), "ah").alias("high"), "shift")


def contours(tree: DataFrame, sibling: float = 1.0, subtree: float = 2.0, order: str = "node_id") -> DataFrame:
    """(node_id, parent, depth, across) for a tree (node_id, parent, depth): parents over the middle of their first and last child, subtrees as close as ``sibling`` (children of one parent) and ``subtree`` (below them) let them.

    A subtree's outline is its leftmost and rightmost place at each depth. From the deepest
    level up, the outlines of a family are merged in pairs, then pairs of pairs: the right half
    moves as a whole, so that a family of any size takes as many rounds as its logarithm and
    no task holds more than two outlines. A child's place is the sum of the moves of the blocks
    it was in. Rounds are the depth times that; at each level the outlines hold a row for each
    subtree and depth it reaches.
    """
    rows = stored(tree.select("node_id", "parent", "depth", F.col(order).alias("_by")))
    kids = siblings(rows, "_by").join(rows.select("node_id", "depth"), "node_id")
    kids = stored(kids)
    widest = {r.depth: r.most + 1 for r in kids.groupBy("depth").agg(F.max("place").alias("most")).collect()}  # a row a level
    zero = F.lit(0.0)
    at = lambda depth: rows.where(F.col("depth") == depth).select("node_id", F.lit(depth).alias("depth"), zero.alias("low"), zero.alias("high"))
    deepest = max(widest, default=0)
    outline, placed = at(deepest), {}
    for depth in range(deepest, 0, -1):
        family = kids.where(F.col("depth") == depth).select("node_id", "parent", "place")
        separation = F.when(F.col("depth") == depth, sibling).otherwise(subtree)
        blocks, moves, n, turn = outline.join(family, "node_id").select("parent", F.col("place").alias("block"), "depth", "low", "high"), None, widest[depth], 0
        while n > 1:
            blocks = stored(_merged(blocks, separation))
            some = blocks.where((F.col("depth") == depth) & F.col("shift").isNotNull()).select("parent", F.lit(turn).alias("turn"), "block", "shift")
            moves = some if moves is None else moves.union(some)
            blocks, n, turn = blocks.drop("shift"), (n + 1) // 2, turn + 1
        if moves is None:
            across = stored(family.select("node_id", "parent", zero.alias("across")))
        else:
            bits = F.filter(F.sequence(F.lit(0), F.lit(turn - 1)), lambda t: F.floor(F.col("place") / F.pow(F.lit(2.0), t)) % 2 == 1)
            moved = family.select("node_id", "parent", "place", F.explode(bits).alias("turn")).withColumn("block", F.floor(F.col("place") / F.pow(F.lit(2.0), F.col("turn") + 1)).cast("long"))
            sums = moved.join(moves, ["parent", "turn", "block"]).groupBy("node_id").agg(F.sum("shift").alias("across"))
            across = stored(family.join(sums, "node_id", "left").select("node_id", "parent", F.coalesce("across", zero).alias("across")))
        middle = stored(across.groupBy("parent").agg((F.max("across") / 2).alias("middle")))
        placed[depth] = stored(across.join(middle, "parent").select("node_id", "parent", (F.col("across") - F.col("middle")).alias("step")))
        raised = blocks.join(middle, "parent").select(F.col("parent").alias("node_id"), "depth", (F.col("low") - F.col("middle")).alias("low"), (F.col("high") - F.col("middle")).alias("high"))
        outline = stored(at(depth - 1).union(raised))
    level = stored(rows.where("depth = 0").select("node_id", "parent", "depth", zero.alias("across")))
    out = level
    for depth in range(1, deepest + 1):
        up = level.select(F.col("node_id").alias("parent"), F.col("across").alias("_x"))
        level = stored(placed[depth].join(up, "parent").select("node_id", "parent", F.lit(depth).alias("depth"), (F.col("_x") + F.col("step")).alias("across")))
        out = out.union(level)
    return out


def tidy(tree: DataFrame, level: float = 80.0, sibling: float = 1.0, subtree: float = 2.0, radial: bool = True, order: str = "node_id") -> DataFrame:
    """(node_id, x, y): ``contours`` drawn from the root down, around 0, or in rings around the root.

    Straight: across times ``level``, centred on 0, and depth times ``level``. Radial: the width plus
    ``sibling`` is the full turn, the ring is (depth + 1) times ``level`` wide, the root lies
    in the middle; a tree without width lies there as a whole.
    """
    found = stored(contours(tree, sibling, subtree, order))
    low, high = found.agg(F.min("across"), F.max("across")).first()
    if low is None:
        return found.select("node_id", F.col("across").alias("x"), F.col("across").alias("y"))
    if not radial:
        return found.select("node_id", ((F.col("across") - (low + high) / 2) * level).alias("x"), (F.col("depth") * level).cast("double").alias("y"))
    angle = (F.col("across") - low) * (2 * math.pi / (high - low + sibling))
    ring = F.when((F.col("depth") == 0) | F.lit(high == low), 0.0).otherwise((F.col("depth") + 1) * level)
    return found.select("node_id", (ring * F.cos(angle)).alias("x"), (ring * F.sin(angle)).alias("y"))


def tidy_graph(nodes: DataFrame, edges: DataFrame, root: int | None = None, **options: float) -> DataFrame:
    """(node_id, x, y): the tidy tree of the edges' first visits from a root, found where none is given.

    Edges from a node to itself and to ids that aren't nodes don't count; nodes that the root
    doesn't reach have no row; without edges there are none.
    """
    from graphloom.operators.hierarchy import spanning
    from graphloom.operators.reach import root as find_root
    from graphloom.sources.graph import closed_edges

    valid = stored(closed_edges(nodes, edges.where("src != dst")))
    if valid.isEmpty():
        return nodes.select("node_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    if root is None:
        ends = valid.select(F.col("src").alias("node_id")).union(valid.select("dst")).distinct()
        root = find_root(ends, valid).first()[0]
    return tidy(spanning(nodes, valid, root), **options)
