"""Spatial predicates and nearest neighbours over points, by grid cells and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.geometry import Viewport
from graphloom.operators.iterate import stored


def cell(col: str, size: float) -> Column:
    return F.floor(F.col(col) / F.lit(float(size))).cast("long")


def gridded(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"cx": cell("x", size), "cy": cell("y", size)})


def beside(points: DataFrame, size: float) -> DataFrame:
    """Every point once for its own and each neighbouring cell."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    out = gridded(points, size).withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return out.withColumns({"cx": F.col("cx") + F.col("_dx"), "cy": F.col("cy") + F.col("_dy")}).drop("_dx", "_dy")


def squared(ax: str = "x", ay: str = "y", bx: str = "x2", by: str = "y2") -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return dx * dx + dy * dy


def within_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(node_id, node_id2, d2): ordered pairs of different points at most ``radius`` apart, with both points' columns.

    Points meet in cells as wide as the radius and the eight around, never all with all.
    """
    other = points.select(*[F.col(c).alias(f"{c}2") for c in points.columns])
    near = beside(points, radius).join(gridded(other.withColumnRenamed("x2", "x").withColumnRenamed("y2", "y"), radius).withColumnRenamed("x", "x2").withColumnRenamed("y", "y2"), ["cx", "cy"])
    return near.where("node_id != node_id2").withColumn("d2", squared()).where(F.col("d2") <= float(radius) ** 2).drop("cx", "cy")


def in_rect(points: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    return points.where(F.col("x").between(min_x, max_x) & F.col("y").between(min_y, max_y))


def in_radius(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    near = in_rect(points, x - radius, y - radius, x + radius, y + radius)
    return near.where((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) <= radius * radius)


def nearest(points: DataFrame, x: float, y: float, k: int = 1) -> DataFrame:
    """The k nearest points, ties by id."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.withColumn("d2", d2).orderBy("d2", "node_id").limit(k)


def nearest_within(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """For each query point (query_id, x, y) the nearest point at most ``radius`` away, ties by id; queries without one are left out. Queries of one place are looked up once."""
    p = gridded(points.select("node_id", "x", "y"), radius).withColumnsRenamed({"x": "x2", "y": "y2"})
    asked = queries.select("query_id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))
    found = beside(asked.select("x", "y").distinct(), radius).hint("merge").join(p, ["cx", "cy"]).withColumn("d2", squared()).where(F.col("d2") <= float(radius) ** 2)
    found = found.groupBy("x", "y").agg(F.min(F.struct("d2", "node_id")).alias("m"))
    return asked.hint("merge").join(found, ["x", "y"]).groupBy("query_id").agg(F.min("m").alias("m")).select("query_id", F.col("m.node_id").alias("node_id"), F.col("m.d2").alias("d2"))


def nearest_k(points: DataFrame, k: int, radius: float) -> DataFrame:
    """The k nearest other points of each point within ``radius``, ranked."""
    w = Window.partitionBy("node_id").orderBy("d2", "node_id2")
    return within_pairs(points.select("node_id", "x", "y"), radius).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("node_id", F.col("node_id2").alias("neighbor"), "d2", "rank")


def pick_node(points: DataFrame, x: float, y: float, slack: float = 2.0) -> DataFrame:
    """The nearest node whose disc, widened by ``slack``, holds the place."""
    return nearest(points, x, y, 1) if "radius" not in points.columns else points.withColumn("d2", (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)).where(F.sqrt("d2") <= F.col("radius") + slack).orderBy("d2", "node_id").limit(1)


def placed(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges with the places of both ends: x, y and x2, y2."""
    a = points.select(F.col("node_id").alias("src"), "x", "y")
    b = points.select(F.col("node_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(a, "src").join(b, "dst")


def pick_edge(edges: DataFrame, points: DataFrame, x: float, y: float, radius: float = 5.0) -> DataFrame:
    """The edge whose segment is nearest and strictly nearer than ``radius``, ties by ends."""
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.lit(x) - F.col("x")) * dx + (F.lit(y) - F.col("y")) * dy) / length))).otherwise(F.lit(0.0))
    px, py = F.col("x") + t * dx - x, F.col("y") + t * dy - y
    return placed(edges, points).withColumn("distance", F.sqrt(px * px + py * py)).where(F.col("distance") < radius).orderBy("distance", "src", "dst").limit(1).select("src", "dst", "distance")


#: Cells that an edge's length is divided into, at most: longer edges lie in coarser cells.
STEPS = 32


def _segment_distance(x: Column, y: Column) -> Column:
    """From a place to the segment x, y to x2, y2."""
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("x")) * dx + (y - F.col("y")) * dy) / length))).otherwise(F.lit(0.0))
    px, py = F.col("x") + t * dx - x, F.col("y") + t * dy - y
    return F.sqrt(px * px + py * py)


def crossed_cells(lines: DataFrame, reach: float) -> DataFrame:
    """Segments (x, y, x2, y2) with a row for each cell (level, cx, cy) that their places at most ``reach`` away touch.

    A level's cells are 2 ** level wide: at least twice ``reach`` and a ``STEPS``-th of the
    segment, so that a segment of any length lies in some dozens of cells along its way.
    Segments with an end that isn't finite have none.
    """
    long = F.greatest(F.abs(F.col("x2") - F.col("x")), F.abs(F.col("y2") - F.col("y")))
    level = F.ceil(F.log2(F.greatest(F.lit(2.0 * reach), long / STEPS, F.lit(1e-9)))).cast("int")
    ends = ("x", "y", "x2", "y2")
    sized = lines.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in ends)).withColumn("level", level).withColumn("_w", F.pow(F.lit(2.0), "level"))
    cell = lambda c: F.floor(c / F.col("_w")).cast("long")
    low, high = F.least("x", "x2"), F.greatest("x", "x2")
    columns = sized.withColumn("cx", F.explode(F.sequence(cell(low - reach), cell(high + reach))))
    # the part of the segment over the column, widened by what reaches into it
    at = lambda x: F.when(F.col("x2") == F.col("x"), None).otherwise(F.col("y") + (x - F.col("x")) / (F.col("x2") - F.col("x")) * (F.col("y2") - F.col("y")))
    left, right = F.greatest(low, F.col("cx") * F.col("_w") - reach), F.least(high, (F.col("cx") + 1) * F.col("_w") + reach)
    a, b = F.coalesce(at(left), F.col("y")), F.coalesce(at(right), F.col("y2"))
    lowest, highest = F.greatest(F.least(a, b), F.least("y", "y2")), F.least(F.greatest(a, b), F.greatest("y", "y2"))
    return columns.withColumn("cy", F.explode(F.sequence(cell(F.least(lowest, highest) - reach), cell(F.greatest(lowest, highest) + reach)))).drop("_w")


def _clipped(lines: DataFrame, box: DataFrame, reach: float) -> DataFrame:
    """The parts of segments (x, y, x2, y2) inside the box (low_x, high_x, low_y, high_y) and ``reach`` around it, a little wider for rounding; segments outside go. Whole segments stand in ``line``."""
    shift = {"x": F.col("x2") - F.col("x"), "y": F.col("y2") - F.col("y")}
    inside = lines.withColumn("line", F.struct("x", "y", "x2", "y2")).crossJoin(F.broadcast(box))
    enter, leave, meets = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for c, d in shift.items():
        margin = reach + 1e-6 * (1 + F.greatest(*[F.abs(F.col(v)) for v in (c, f"{c}2", f"low_{c}", f"high_{c}")]))
        low, high = F.col(f"low_{c}") - margin, F.col(f"high_{c}") + margin
        meets = meets & (F.least(c, f"{c}2") <= high) & (F.greatest(c, f"{c}2") >= low)
        steep = F.abs(d) > 1e-9 * margin
        enter.append(F.when(steep, F.least((low - F.col(c)) / d, (high - F.col(c)) / d)))
        leave.append(F.when(steep, F.greatest((low - F.col(c)) / d, (high - F.col(c)) / d)))
    inside = inside.where(meets).withColumns({"_a": F.greatest(*enter), "_b": F.least(*leave)}).where("_a <= _b")
    ends = {c: F.col(f"line.{c}") + F.col(t) * (F.col(f"line.{c[0]}2") - F.col(f"line.{c[0]}")) for c, t in (("x", "_a"), ("y", "_a"))}
    ends |= {f"{c}2": F.col(f"line.{c}") + F.col("_b") * (F.col(f"line.{c}2") - F.col(f"line.{c}")) for c in "xy"}
    return inside.withColumns(ends).drop("_a", "_b", *box.columns)


def nearest_edges(queries: DataFrame, edges: DataFrame, points: DataFrame, radius: float = 5.0) -> DataFrame:
    """For each query (query_id, x, y) the edge (src, dst, distance) whose segment is nearest and strictly nearer than ``radius``, ties by ends.

    Only the parts of segments in the queries' box count. Places, each once for all queries
    there, and segments meet in the cells that segments cross, by equi-join, never all with
    all; a place looks into its cell of each level there is, a number bounded by the range of
    doubles. Queries without an edge are left out, and those of a place that isn't finite.
    """
    asked = queries.where("abs(x) < double('infinity') and abs(y) < double('infinity')").select("query_id", (F.col("x") + 0.0).alias("_x"), (F.col("y") + 0.0).alias("_y"))
    places = stored(asked.select("_x", "_y").distinct())
    box = places.agg(*[f(f"_{c}").alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
    finite = " and ".join(f"abs({c}) < double('infinity')" for c in ("x", "y", "x2", "y2"))
    lines = stored(crossed_cells(_clipped(placed(edges.select("src", "dst"), points.select("node_id", "x", "y")).where(finite), box, radius), radius).select("src", "dst", "line.*", "level", "cx", "cy"))
    levels = [r.level for r in lines.select("level").distinct().collect()]  # some dozens at most
    looks = places.select("_x", "_y", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    width = F.pow(F.lit(2.0), "level")
    looks = looks.withColumns({"cx": F.floor(F.col("_x") / width).cast("long"), "cy": F.floor(F.col("_y") / width).cast("long")})
    near = lines.hint("merge").join(looks, ["level", "cx", "cy"]).withColumn("distance", _segment_distance(F.col("_x"), F.col("_y"))).where(F.col("distance") < radius)
    found = near.groupBy("_x", "_y").agg(F.min(F.struct("distance", "src", "dst")).alias("m"))
    return asked.hint("merge").join(found, ["_x", "_y"]).groupBy("query_id").agg(F.min("m").alias("m")).select("query_id", "m.src", "m.dst", "m.distance")


def hits(queries: DataFrame, edges: DataFrame, points: DataFrame, node_radius: float = 20.0, edge_radius: float = 5.0, nodes_first: bool = True) -> DataFrame:
    """For each query (query_id, x, y) what lies there: ``kind`` (node or edge), node_id or src and dst, and the distance.

    A node at most ``node_radius`` away and an edge nearer than ``edge_radius`` are looked up for
    all queries at once; where both are found the node wins, or the nearer with ``nodes_first``
    off (the edge at equal distances). Queries that hit nothing are left out.
    """
    none = F.lit(None).cast("long")
    node = nearest_within(queries, points, node_radius).select("query_id", F.lit("node").alias("kind"), "node_id", none.alias("src"), none.alias("dst"), F.sqrt("d2").alias("distance"))
    edge = nearest_edges(queries, edges, points, edge_radius).select("query_id", F.lit("edge").alias("kind"), none.alias("node_id"), "src", "dst", "distance")
    order = F.struct((F.col("kind") != "node").alias("a"), "distance") if nodes_first else F.struct("distance", (F.col("kind") == "node").alias("a"))
    return node.union(edge).groupBy("query_id").agg(F.min(F.struct(order.alias("o"), "kind", "node_id", "src", "dst", "distance")).alias("m")).select("query_id", *[f"m.{c}" for c in ("kind", "node_id", "src", "dst", "distance")])


def screen_hits(screen: DataFrame, edges: DataFrame, points: DataFrame, view: Viewport, **options: bool) -> DataFrame:
    """``hits`` at places (query_id, x, y) of the screen: 20 pixels around nodes and 5 around edges, whatever the scale."""
    x, y = (F.col("x") - view.width / 2) / view.scale + view.x, (F.col("y") - view.height / 2) / view.scale + view.y
    return hits(screen.select("query_id", x.alias("x"), y.alias("y")), edges, points, 20 / view.scale, 5 / view.scale, **options)
