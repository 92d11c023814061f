"""Structure over edges: adjacency, degrees, depth, roots, bounds, and incremental changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.iterate import settle, stored
from graphloom.sources.graph import Graph, closed_edges


def neighbors(edges: DataFrame, node: int) -> DataFrame:
    """Ends of the node's outgoing edges, one row an edge."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("node_id"))


def incident(edges: DataFrame, node: int) -> DataFrame:
    return edges.where((F.col("src") == node) | (F.col("dst") == node))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, out_degree, in_degree, degree) of every node; a self loop counts once each way, twice in ``degree``."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    sums = ends.groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum(1 - F.col("o")).alias("in_degree"))
    out = nodes.select("node_id").join(sums, "node_id", "left").na.fill(0, ["out_degree", "in_degree"])
    return out.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def csr(nodes: DataFrame, edges: DataFrame, inverse: bool = False) -> DataFrame:
    """(node_id, first, targets): each node's sorted neighbours and where they begin in the list of all.

    The running count goes over range partitions first and then over one row a partition.
    """
    a, b = ("dst", "src") if inverse else ("src", "dst")
    rows = edges.groupBy(F.col(a).alias("node_id")).agg(F.sort_array(F.collect_list(b)).alias("targets"))
    rows = nodes.select("node_id").join(rows, "node_id", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<bigint>")))
    return running(rows, "node_id", F.size("targets")).withColumnRenamed("before", "first")


def running(df: DataFrame, order: str, value: Column, kind: str = "long") -> DataFrame:
    """``before``: the sum of ``value`` over all rows that come before in ``order``, with no task seeing all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.withColumn("_v", value.cast(kind)).repartitionByRange(n, order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.sum("_v").alias("n"))
    offsets = sizes.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(offsets), "_p").withColumn("before", F.col("_o") + inside).drop("_p", "_v", "_o")


def csr_faults(rows: DataFrame) -> DataFrame:
    """Rows of (node_id, first, targets) that don't begin where the row before ends.

    Lists count by their size only; rows are compared within range partitions, and the first
    of each with the last of the partition before.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.select("node_id", "first", F.struct((F.col("first") + F.size("targets")).alias("end")).alias("_e"))
    ranged = stored(ends.repartitionByRange(n, "node_id").withColumn("_p", F.spark_partition_id()))
    lasts = ranged.groupBy("_p").agg(F.max(F.struct("node_id", "_e")).alias("m")).select("_p", F.lag("m._e").over(Window.orderBy("_p")).alias("_l"))
    before = F.coalesce(F.lag("_e").over(Window.partitionBy("_p").orderBy("node_id")), F.col("_l"))
    return ranged.join(F.broadcast(lasts), "_p").select("node_id", "first", F.coalesce(before["end"], F.lit(0)).alias("expected")).where("first != expected")


def depths(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(node_id, depth): least number of edges from a source; sources are nodes without incoming edges unless given; unreached nodes have 0."""
    if sources is None:
        sources = nodes.select("node_id").join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")
    seen = sources.select("node_id", F.lit(0).alias("depth")).distinct()

    def step(state: DataFrame, turn: int) -> DataFrame:
        front = state.where(F.col("depth") == turn)
        new = front.join(edges, front.node_id == edges.src).select(F.col("dst").alias("node_id")).distinct().join(state, "node_id", "left_anti")
        return state.unionByName(new.select("node_id", F.lit(turn + 1).alias("depth")))

    found = settle(seen, step, lambda state: state.agg(F.count("*")).first()[0])
    return nodes.select("node_id").join(found, "node_id", "left").na.fill(0, ["depth"])


def finite(col: str) -> Column:
    c = F.col(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def bounds(points: DataFrame) -> DataFrame:
    """One row: the box of all finite points, nulls if there are none."""
    return points.where(finite("x") & finite("y")).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def bounds_with_margin(points: DataFrame, least: float = 100.0, part: float = 0.1) -> DataFrame:
    """The box widened by ``part`` of its longer side, by ``least`` at least."""
    box = bounds(points).withColumn("m", F.greatest(F.lit(least), part * F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))))
    return box.select(*[(F.col(c) - F.col("m")).alias(c) for c in ("min_x", "min_y")], *[(F.col(c) + F.col("m")).alias(c) for c in ("max_x", "max_y")])


def remove_nodes(graph: Graph, gone: DataFrame) -> Graph:
    """Without the nodes whose id is in ``gone`` and without their edges."""
    ids = gone.select(F.col("node_id").alias("_id"))
    edges = graph.edges.join(ids, F.col("src") == F.col("_id"), "left_anti").join(ids, F.col("dst") == F.col("_id"), "left_anti")
    return Graph(graph.nodes.join(ids, F.col("node_id") == F.col("_id"), "left_anti"), edges)


def add_edges(graph: Graph, more: DataFrame) -> Graph:
    """With those of the edges whose ends both exist."""
    return graph.with_(edges=graph.edges.unionByName(closed_edges(graph.nodes, more), allowMissingColumns=True))


def add_nodes(graph: Graph, more: DataFrame) -> Graph:
    """With the nodes whose ids are new."""
    new = more.dropDuplicates(["node_id"]).join(graph.nodes.select("node_id"), "node_id", "left_anti")
    return graph.with_(nodes=graph.nodes.unionByName(new, allowMissingColumns=True))


def remove_edges(graph: Graph, gone: DataFrame, key: str = "edge_id") -> Graph:
    return graph.with_(edges=graph.edges.join(gone.select(key), key, "left_anti"))


def compact(nodes: DataFrame) -> DataFrame:
    """(node_id, slot): the nodes numbered from 0 in the order of their ids."""
    return running(nodes.select("node_id"), "node_id", F.lit(1)).withColumnRenamed("before", "slot")


def update(nodes: DataFrame, changes: DataFrame, columns: list[str], key: str = "node_id") -> DataFrame:
    """Nodes with the non-null values of ``changes`` in place of theirs."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = nodes.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and one more than the largest node id (0 without nodes)."""
    return nodes.agg(F.count("*").alias("nodes"), (F.coalesce(F.max("node_id"), F.lit(-1)) + 1).alias("bound")).crossJoin(edges.agg(F.count("*").alias("edges"))).select("nodes", "edges", "bound")


def bounds_of(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """The box of the nodes whose ids are in ``chosen``."""
    return bounds(points.join(chosen.select("node_id"), "node_id", "left_semi"))


def set_visible(nodes: DataFrame, chosen: DataFrame, visible: bool) -> DataFrame:
    """Nodes with ``visible`` set for those in ``chosen``; without the column all are visible before."""
    before = F.coalesce(F.col("visible"), F.lit(True)) if "visible" in nodes.columns else F.lit(True)
    marked = chosen.select("node_id").distinct().withColumn("_m", F.lit(True))
    return nodes.withColumn("visible", before).join(marked, "node_id", "left").withColumn("visible", F.when(F.col("_m"), F.lit(visible)).otherwise(F.col("visible"))).drop("_m")


def visible_graph(graph: Graph) -> Graph:
    """The visible nodes and the edges between them."""
    shown = graph.nodes.where(F.coalesce(F.col("visible"), F.lit(True)))
    return Graph(shown, closed_edges(shown, graph.edges))


def placed_beside(graph: Graph, more: DataFrame, radius: float = 30.0) -> DataFrame:
    """New nodes without a place put around the mean of their neighbours' places, at an angle by id; around the origin without any."""
    ends = graph.edges.select("src", "dst").union(graph.edges.select("dst", "src"))
    known = graph.nodes.where("x is not null and y is not null").select(F.col("node_id").alias("dst"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    middle = ends.join(known, "dst").groupBy(F.col("src").alias("node_id")).agg(F.avg("nx").alias("mx"), F.avg("ny").alias("my"))
    angle = F.pmod(F.xxhash64("node_id"), F.lit(360)) * 0.017453292519943295
    out = more.join(middle, "node_id", "left")
    at = lambda own, m, f: F.coalesce(F.col(own), F.coalesce(m, F.lit(0.0)) + radius * f(angle))
    return out.withColumns({"x": at("x", "mx", F.cos), "y": at("y", "my", F.sin)}).drop("mx", "my")
