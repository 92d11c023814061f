"""Graph analytics: components, centralities, communities, hulls."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.operators.iterate import repeat, settle, stored
from graphloom.operators.structure import running


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest id reachable over edges in either direction, by labels that jump to their label's label."""
    both = stored(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    start = nodes.select("node_id", F.col("node_id").alias("component"))

    def step(state: DataFrame, turn: int) -> DataFrame:
        near = both.join(state, both.dst == state.node_id).groupBy(F.col("src").alias("node_id")).agg(F.min("component").alias("m"))
        lower = state.join(near, "node_id", "left").select("node_id", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = lower.select(F.col("node_id").alias("component"), F.col("component").alias("j"))
        return lower.join(jump, "component", "left").select("node_id", F.least("component", F.coalesce("j", "component")).alias("component"))

    return settle(start, step, lambda s: s.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0])


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float | None = None) -> DataFrame:
    """(node_id, rank) after a number of power iterations; nodes without outgoing edges spread their rank over all.

    With a ``tolerance`` (1e-6 is usual, with 100 iterations at most) it ends once the ranks' changes sum to less, looked at every five.
    """
    n = nodes.count()
    links = stored(edges.select("src", "dst").join(edges.groupBy("src").agg(F.count("*").alias("out")), "src"))
    ids = stored(nodes.select("node_id").join(links.select(F.col("src").alias("node_id"), F.lit(True).alias("has_out")).distinct(), "node_id", "left"))

    def step(state: DataFrame) -> DataFrame:
        sums = links.join(state, links.src == state.node_id).groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("rank") / F.col("out")).alias("s"))
        lost = state.where("has_out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        return ids.join(sums, "node_id", "left").crossJoin(F.broadcast(lost)).select("node_id", "has_out", ((1 - damping) / n + damping * (F.coalesce("s", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))

    start = ids.withColumn("rank", F.lit(1.0 / max(n, 1)))
    if tolerance is None:
        return repeat(start, step, iterations).select("node_id", "rank")
    state = stored(start)
    for _ in range(0, iterations, 5):
        before = stored(repeat(state, step, 4))
        state = stored(step(before))
        moved = state.join(before.select("node_id", F.col("rank").alias("was")), "node_id").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        if moved < tolerance:
            break
    return state.select("node_id", "rank")


def eigenvector(nodes: DataFrame, edges: DataFrame, iterations: int = 20) -> DataFrame:
    """(node_id, score): power iteration over incoming edges, shifted by the identity, scaled to length 1."""
    ids, links = nodes.select("node_id"), stored(edges.select("src", "dst"))

    def step(state: DataFrame) -> DataFrame:
        sums = links.join(state, links.src == state.node_id).groupBy(F.col("dst").alias("node_id")).agg(F.sum("score").alias("s"))
        raw = state.join(sums, "node_id", "left").select("node_id", (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"))
        norm = raw.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
        return raw.crossJoin(F.broadcast(norm)).select("node_id", (F.col("score") / F.col("norm")).alias("score"))

    return repeat(ids.withColumn("score", F.lit(1.0)), step, iterations, every=2)


def katz(nodes: DataFrame, edges: DataFrame, alpha: float = 0.05, beta: float = 1.0, iterations: int = 20) -> DataFrame:
    """(node_id, score) = beta + alpha * sum of the scores of nodes that point here."""
    ids, links = nodes.select("node_id"), stored(edges.select("src", "dst"))

    def step(state: DataFrame) -> DataFrame:
        sums = links.join(state, links.src == state.node_id).groupBy(F.col("dst").alias("node_id")).agg(F.sum("score").alias("s"))
        return ids.join(sums, "node_id", "left").select("node_id", (beta + alpha * F.coalesce("s", F.lit(0.0))).alias("score"))

    return repeat(ids.withColumn("score", F.lit(beta)), step, iterations)


def summary(values: DataFrame, col: str) -> DataFrame:
    return values.agg(F.min(col).alias("least"), F.max(col).alias("most"), F.avg(col).alias("mean"))


def undirected_weights(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """Both directions of every edge, with weight 1 unless ``weighted``; self loops stay once."""
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    return e.union(e.where("src != dst").select("dst", "src", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, assignment: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of (node_id, community) over undirected weights (src, dst, w)."""
    ends = edges.join(assignment.select(F.col("node_id").alias("src"), F.col("community").alias("c1")), "src").join(assignment.select(F.col("node_id").alias("dst"), F.col("community").alias("c2")), "dst")
    per = ends.groupBy(F.col("c1").alias("c")).agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("c1") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("inner"))
    total = per.agg(F.sum("degree").alias("m2"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inner") / F.col("m2") - resolution * (F.col("degree") / F.col("m2")) ** 2).alias("modularity"))


def coarsen(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Weights (src, dst, w) between communities; inner weight is their self loop."""
    return edges.join(assignment.select(F.col("node_id").alias("src"), F.col("community").alias("a")), "src").join(assignment.select(F.col("node_id").alias("dst"), F.col("community").alias("b")), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))


#: Rows that one key may meet in a task: where all are fewer, no hub needs its rows spread.
PLAIN = 10_000_000


def _spread(rows: DataFrame, key: str, table: DataFrame, weight: str, total: float) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and in ``weight`` the rows that it meets, ``total`` in all.

    Keys that meet over a thousandth of all rows, of which there are fewer than 1,000, are broadcast; their rows keep a salt
    in the join of the others, so that no task gets all rows of a hub. Fewer rows than ``PLAIN`` in all are joined as they are.
    """
    if total < PLAIN:
        return rows.join(table, key).select(*rows.columns, *[c for c in table.columns if c != key])
    values = F.struct(*[c for c in table.columns if c != key])
    many = F.col(weight) * 1000 > total
    hot = table.where(many).select(key, values.alias("_hot"))
    cold = table.where(~many).select(F.col(key).alias("_key"), values.alias("_cold"), F.least(F.col(weight).cast("long"), F.lit(0)).alias("_zero"))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_000))).otherwise(0).cast("long"))
    met = marked.join(cold, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_zero")), "left").withColumn("_v", F.coalesce("_hot", "_cold"))
    return met.where("_v is not null").select(*rows.columns, "_v.*")


def _moved(graph: DataFrame, state: DataFrame, m2: float, met: int, resolution: float, turn: int) -> DataFrame:
    """``state`` (node_id, community, k, links) after the nodes of one hash half went where modularity gains most, over ``graph`` (src, dst, w, k of src).

    ``was``, ``inner`` and ``total`` tell each node's community before, its weight into that and
    that one's weight: the modularity before the moves is a sum over these rows.
    """
    totals = state.groupBy("community").agg(F.expr("sum(k) AS total"), F.expr("sum(links + 1) AS _met"))
    ends = _spread(graph.withColumnRenamed("dst", "node_id"), "node_id", state.select("node_id", "community", "links"), "links", met)
    ends = ends.selectExpr("src AS node_id", "community", "if(src = node_id, 0D, w) AS w", "if(src = node_id, w, 0D) AS loop", "k", "0L AS links")
    every = ends.union(state.selectExpr("node_id", "community", "0D AS w", "0D AS loop", "k", "links"))
    if met < PLAIN:  # one shuffle serves both groupings
        every = every.repartition("node_id")
    options = every.groupBy("node_id", "community").agg(*map(F.expr, ("sum(w) AS w", "sum(loop) AS loop", "max(k) AS k", "max(links) AS links")))
    rest = f"{resolution!r}D * (total - if(links > 0, k, 0D)) * k"
    options = _spread(options, "community", totals, "_met", met).selectExpr("*", "links > 0 AS stays", f"round(w / {m2!r}D - {rest} / ({m2!r}D * {m2!r}D), 12) AS gain")
    best = "max(struct(gain, int(stays) AS stay, -community AS c)) AS b", "max(k) AS k", "max(links) AS links", "max(if(stays, community, null)) AS was", "max(if(stays, w + loop, null)) AS inner", "max(if(stays, total, null)) AS total"
    moves = f"pmod(xxhash64(node_id, {turn // 2}), 2) = {turn % 2}"
    return options.groupBy("node_id").agg(*map(F.expr, best)).selectExpr("node_id", f"if({moves}, -b.c, was) AS community", "k", "links", "was", "inner", "total")


def _settled(graph: DataFrame, start: DataFrame, resolution: float, passes: int, min_gain: float, inside: DataFrame | None = None) -> tuple[DataFrame, float]:
    """Moves of both halves in turn until two in a row gain less than ``min_gain``: (node_id, community) and its modularity.

    Each turn is one stored plan whose write also measures the state it began with. With ``inside``
    (node_id, bound) nodes only meet those of their bound.
    """
    sums = graph.groupBy(F.col("src").alias("node_id")).agg(F.sum("w").alias("k"), F.count("*").alias("links"))
    start = stored(start.join(sums, "node_id"))
    m2, met = start.agg(F.sum("k"), F.sum("links") + F.count("*")).first()
    if inside is not None:
        bounds = start.select("node_id", "links").join(inside, "node_id")
        near = graph
        for end in ("src", "dst"):
            near = _spread(near, end, bounds.select(F.col("node_id").alias(end), F.col("bound").alias(f"b_{end}"), F.col("links").alias("_l")), "_l", met).drop("_l")
        graph = near.where("b_src = b_dst").select("src", "dst", "w")
    graph = stored(_spread(graph, "src", start.select(F.col("node_id").alias("src"), "k", "links"), "links", met).drop("links"))
    state, trial, score, idle = start, start, None, 0
    for turn in range(2 * passes + 1):
        seen = Observation()
        ahead = stored(_moved(graph, trial, m2, met, resolution, turn).observe(seen, F.sum("inner").alias("inner"), F.sum(F.col("k") * F.col("total")).alias("square"), F.sum((F.col("community") != F.col("was")).cast("long")).alias("moved")))
        moved = seen.get["moved"]
        q = seen.get["inner"] / m2 - resolution * seen.get["square"] / (m2 * m2)
        if score is None:
            score = q
        elif trial is not state:
            idle = 0 if q > score + min_gain else idle + 1
            if q > score:
                state, score = trial, q
        if trial is state and moved == 0:
            idle += 1
        if idle >= 2:
            break
        trial = ahead if trial is state and moved else state
    return state.select("node_id", "community"), score


def _named(state: DataFrame) -> DataFrame:
    names = state.groupBy("community").agg(F.min("node_id").alias("name"))
    return stored(state.join(names, "community").select("node_id", F.col("name").alias("community")))


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, passes: int = 100, levels: int = 20, weighted: bool = False, min_gain: float = 1e-4, refined: bool = False, progress: Callable[[int, float], None] | None = None) -> DataFrame:
    """(node_id, community): greedy modularity with all nodes of one half moving at a time.

    In each pass the nodes of one hash half go to the neighbouring community of the largest
    gain, halves in turn, so neighbours seldom swap. A level ends when neither half gains
    ``min_gain``, or after ``passes`` of both, and is coarsened, which keeps the modularity. Levels end when
    one gains nothing more or puts all nodes into one community; the best is returned,
    communities named by their smallest node. Without edges every node is alone. With
    ``refined`` (as in Leiden) each community is split again by moves within it before
    coarsening, and the parts, placed together, go on. ``progress`` gets each level and its modularity.
    """
    graph = stored(undirected_weights(edges, weighted))
    best, best_q = nodes.select("node_id", F.col("node_id").alias("community")), -1.0
    if not (graph.agg(F.sum("w")).first()[0] or 0.0) > 0.0:
        return best
    part, start = best, None
    lift = lambda p, s: stored(p.withColumnRenamed("community", "_c").join(s.select(F.col("node_id").alias("_c"), "community"), "_c", "left").select("node_id", F.coalesce("community", "_c").alias("community")))
    for level in range(levels):
        alone = stored(graph.select(F.col("src").alias("node_id")).distinct().withColumn("community", F.col("node_id")))
        state, q = _settled(graph, alone if start is None else start, resolution, passes, min_gain)
        state = _named(state)
        whole = lift(part, state)
        if progress:
            progress(level, q)
        if q <= best_q + 1e-9 or whole.select("community").distinct().limit(2).count() < 2:
            break
        best, best_q = whole, q
        parts = state
        if refined:
            parts = _named(_settled(graph, alone, resolution, passes, min_gain, state.withColumnRenamed("community", "bound"))[0])
            start = stored(parts.join(state.withColumnRenamed("community", "_s"), "node_id").groupBy(F.col("community").alias("node_id")).agg(F.min("_s").alias("community")))
        part = lift(part, parts)
        graph = stored(coarsen(graph, parts))
    return best


def community_sizes(assignment: DataFrame, most: int | None = None) -> DataFrame:
    """(community, members), the largest first, only ``most`` if given."""
    out = assignment.groupBy("community").agg(F.count("*").alias("members")).orderBy(F.desc("members"), "community")
    return out if most is None else out.limit(most)


def community_of(assignment: DataFrame, node: int, col: str = "community") -> DataFrame:
    """The row of one node's community or component."""
    return assignment.where(F.col("node_id") == node).select("node_id", col)


def _hull(group: pd.DataFrame) -> pd.DataFrame:
    points = sorted(set(zip(group["x"], group["y"], strict=True)))

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(points) + half(points[::-1]) if len(points) > 2 else points
    return pd.DataFrame({"community": group["community"].iloc[0], "ord": range(len(ring)), "x": [p[0] for p in ring], "y": [p[1] for p in ring]})


def convex_hulls(points: DataFrame) -> DataFrame:
    """(community, ord, x, y): each community's convex hull, counter-clockwise.

    Each of 1024 random parts of a community is reduced to its own hull first, so no task
    holds a community whole.
    """
    schema = "community long, ord int, x double, y double"
    parts = points.select(F.col("community").cast("long").alias("community"), "x", "y").withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(1024)))
    small = parts.groupBy("community", "part").applyInPandas(_hull, schema)
    return small.select("community", "x", "y").groupBy("community").applyInPandas(_hull, schema)


def hull_shapes(hulls: DataFrame, points: DataFrame, fallback: float = 20.0) -> DataFrame:
    """(community, cx, cy, corners, radius): the middle of each community's members; where its hull has no area, a circle of ``fallback`` around the middle and its members stands for it."""
    middle = points.groupBy("community").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    corners = hulls.groupBy("community").agg(F.count("*").alias("corners"))
    far = points.join(middle, "community").groupBy("community").agg(F.max(F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)).alias("far"))
    return middle.join(corners, "community").join(far, "community").select("community", "cx", "cy", "corners", F.when(F.col("corners") < 3, F.col("far") + fallback).otherwise(F.col("far")).alias("radius"))


def hulls_apart(shapes: DataFrame, strength: float = 0.5, most: float = 20.0, padding: float = 10.0) -> DataFrame:
    """(community, dx, dy): how far overlapping communities (community, cx, cy, radius) are pushed apart along the line of their middles, ``most`` at most.

    Shapes meet by grid cells as wide as the largest of them.
    """
    widest = 2 * (shapes.agg(F.max("radius")).first()[0] or 1.0) + padding
    at = lambda c: F.floor(F.col(c) / widest).cast("long")
    steps = F.sequence(F.lit(-1), F.lit(1))
    own = shapes.select("community", "cx", "cy", "radius", F.explode(steps).alias("_a")).withColumn("_b", F.explode(steps)).withColumns({"gx": at("cx") + F.col("_a"), "gy": at("cy") + F.col("_b")})
    other = shapes.select(F.col("community").alias("c2"), F.col("cx").alias("x2"), F.col("cy").alias("y2"), F.col("radius").alias("r2"), at("cx").alias("gx"), at("cy").alias("gy"))
    dx, dy = F.col("cx") - F.col("x2"), F.col("cy") - F.col("y2")
    d = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-6))
    over = F.col("radius") + F.col("r2") + padding - d
    met = own.join(other, ["gx", "gy"]).where("community != c2").withColumns({"_o": over, "_ux": dx / d, "_uy": dy / d}).where("_o > 0")
    sums = met.groupBy("community").agg(F.sum(0.5 * strength * F.col("_o") * F.col("_ux")).alias("dx"), F.sum(0.5 * strength * F.col("_o") * F.col("_uy")).alias("dy"))
    size = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    return sums.select("community", *[(F.col(c) * F.least(F.lit(1.0), most / F.greatest(size, F.lit(1e-9)))).alias(c) for c in ("dx", "dy")])


def community_circle(points: DataFrame, spacing: float = 50.0, spread: float = 1.5, between: float = 10.0) -> DataFrame:
    """(community, members, inner, cx, cy): communities on a circle, arcs by their members; ``inner`` is the radius that a community's members take. One row a community is ordered."""
    sizes = points.groupBy("community").agg(F.count("*").alias("members"))
    inner = F.when(F.col("members") > 1, between * F.sqrt(F.col("members") / F.lit(math.pi))).otherwise(0.0)
    sizes = stored(sizes.withColumn("inner", inner))
    all_, around = sizes.agg(F.sum("members"), F.sum(2 * F.col("inner") + spacing)).first()
    placed = running(sizes, "community", F.col("members"))
    angle = 2 * math.pi * (F.col("before") + F.col("members") / 2) / float(all_ or 1)
    radius = (around or 0.0) / (2 * math.pi) * spread
    return placed.select("community", "members", "inner", (radius * F.cos(angle)).alias("cx"), (radius * F.sin(angle)).alias("cy"))


def sunflower(points: DataFrame, centers: DataFrame, spread: float = 1.5) -> DataFrame:
    """(node_id, x, y): members of each community around its centre (community, members, inner, cx, cy), evenly over a disc, in the order of their ids.

    A member's number is its place among all less its community's first, so no community is sorted in one task.
    """
    order = F.struct("community", "node_id")
    ranked = stored(running(points.select("node_id", "community", order.alias("_at")), "_at", F.lit(1)))
    first = ranked.groupBy("community").agg(F.min("before").alias("_first"))
    rows = ranked.join(first, "community").join(centers, "community").withColumn("i", F.col("before") - F.col("_first"))
    angle = F.col("i") * (2 * math.pi / (1 + math.sqrt(5)))
    r = F.col("inner") * spread * F.sqrt((F.col("i") + 0.5) / F.col("members"))
    return rows.select("node_id", (F.col("cx") + r * F.cos(angle)).alias("x"), (F.col("cy") + r * F.sin(angle)).alias("y"))


def shrunk(points: DataFrame, spacing: float = 10.0, spread: float = 1.5) -> DataFrame:
    """Points drawn in, never out, until the farthest from the origin is at ``spacing`` times the root of their number times ``spread``."""
    d = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    scale = points.agg(F.max(d).alias("_far"), F.count("*").alias("_n"))
    k = F.when(F.col("_far") < 1, 1.0).otherwise(F.least(F.lit(1.0), spacing * F.sqrt(F.col("_n").cast("double")) * spread / F.col("_far")))
    return points.crossJoin(F.broadcast(scale)).withColumns({"x": F.col("x") * k, "y": F.col("y") * k}).drop("_far", "_n")


def community_layout(assignment: DataFrame, spacing: float = 50.0, between: float = 10.0, spread: float = 1.5) -> DataFrame:
    """(node_id, x, y): circle of communities, sunflowers within, shrunk to a bounded size."""
    return shrunk(sunflower(assignment, community_circle(assignment, spacing, spread, between), spread), between, spread)


def detected_layout(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Communities found and laid out in one call: (node_id, x, y)."""
    return community_layout(stored(louvain(nodes, edges, resolution)))


def ranked_summary(values: DataFrame, cols: list[str]) -> DataFrame:
    """(measure, least, most, mean) of each of several centralities."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in cols])).alias("p")
    return values.select(parts).groupBy("p.measure").agg(F.min("p.v").alias("least"), F.max("p.v").alias("most"), F.avg("p.v").alias("mean"))
