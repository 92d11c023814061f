"""Property graphs as two DataFrames: ingest, defaults, validation, identity, import and export."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of node and edge attributes.
NODE_RADIUS, EDGE_WIDTH = 5.0, 1.0
NODE_COLOR, EDGE_COLOR = (0.4, 0.6, 0.9), (0.5, 0.5, 0.5)


class GraphError(ValueError):
    """An input that can't be a graph; ``rows`` holds what is wrong with it."""

    def __init__(self, code: int, message: str, rows: DataFrame | None = None):
        super().__init__(f"[{code}] {message}")
        self.code, self.rows = code, rows


@dataclass(frozen=True)
class Graph:
    """An immutable graph: ``nodes`` has node_id, ``edges`` has src and dst; further columns are attributes."""

    nodes: DataFrame
    edges: DataFrame

    def with_(self, **frames: DataFrame) -> Graph:
        return replace(self, **frames)

    def positions(self) -> DataFrame:
        return self.nodes.select("node_id", "x", "y")

    def write(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Graph:
        return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def rgb(color: tuple[float, float, float]) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in zip("rgb", color, strict=True)])


def with_defaults(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Absent attributes filled: position 0, radius, width and colours; a type may also come from metadata."""
    n, e = set(nodes.columns), set(edges.columns)
    col = lambda have, name, default: F.coalesce(F.col(name), default) if name in have else default
    kind = [F.col("type")] * ("type" in n) + [F.col("metadata")["type"]] * ("metadata" in n)
    nodes = nodes.withColumns({"x": col(n, "x", F.lit(0.0)), "y": col(n, "y", F.lit(0.0)), "radius": col(n, "radius", F.lit(NODE_RADIUS)), "color": col(n, "color", rgb(NODE_COLOR)), "type": F.coalesce(*kind) if kind else F.lit(None).cast("string")})
    edges = edges.withColumns({"weight": col(e, "weight", F.lit(1.0)), "width": col(e, "width", F.lit(EDGE_WIDTH)), "color": col(e, "color", rgb(EDGE_COLOR))})
    return Graph(nodes, edges)


def duplicate_ids(nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """Ids that stand more than once, with their number of rows."""
    return nodes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    ids = nodes.select(F.col("node_id").alias("id"))
    out = edges.join(ids, F.col("src") == F.col("id"), "left").withColumnRenamed("id", "_s")
    return out.join(ids, F.col("dst") == F.col("id"), "left").where("_s is null or id is null").drop("_s", "id")


def closed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select(F.col("node_id").alias("id"))
    return edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")


def validate(graph: Graph, on_duplicate: str = "error", strict: bool = True, order: str = "node_id") -> Graph:
    """The graph if ids are unique and ends exist; ``on_duplicate='first'`` and ``strict=False`` mend it instead."""
    nodes = graph.nodes
    if on_duplicate == "first":
        nodes = keep_first(nodes, ["node_id"], order)
    elif not (bad := duplicate_ids(nodes)).isEmpty():
        raise GraphError(1002, "node ids repeat", bad)
    if strict and not (bad := dangling_edges(nodes, graph.edges)).isEmpty():
        raise GraphError(1003, "an edge end is no node", bad)
    return Graph(nodes, closed_edges(nodes, graph.edges))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the first in ``order``, combined before the shuffle: no key is sorted. Null orders come first."""
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(F.col(order).isNotNull().alias("a"), F.col(order).alias("b"))).alias("_r"))
    return kept.select("_r.*")


def faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, n): what keeps two tables from being a graph, a row for each fault: columns that are missing, rows without an id or an end, ids that repeat, and ends that are no node."""
    spark = nodes.sparkSession
    absent = [(f"{name} has no {c}", None, None) for name, df, need in (("nodes", nodes, ["node_id"]), ("edges", edges, ["src", "dst"])) for c in need if c not in df.columns]
    if absent:
        return spark.createDataFrame(absent, "kind string, id string, n long")
    no_id = nodes.where("node_id is null").agg(F.lit("node without id").alias("kind"), F.lit(None).cast("string").alias("id"), F.count("*").alias("n")).where("n > 0")
    no_end = [edges.where(F.col(end).isNull()).agg(F.lit(f"edge without {end}").alias("kind"), F.lit(None).cast("string").alias("id"), F.count("*").alias("n")).where("n > 0") for end in ("src", "dst")]
    twice = duplicate_ids(nodes.where("node_id is not null")).select(F.lit("id repeats").alias("kind"), F.col("node_id").cast("string").alias("id"), "n")
    ids = nodes.select(F.col("node_id").alias("_id"))
    lost = [edges.where(F.col(end).isNotNull()).join(ids, F.col(end) == F.col("_id"), "left_anti").groupBy(F.col(end).cast("string").alias("id")).agg(F.count("*").alias("n")).select(F.lit(f"{end} is no node").alias("kind"), "id", "n") for end in ("src", "dst")]
    out = no_id
    for more in (*no_end, twice, *lost):
        out = out.unionByName(more)
    return out


def load(nodes: DataFrame, edges: DataFrame, on_duplicate: str = "error", strict: bool = True, strategy: str = "phyllotaxis") -> tuple[Graph, DataFrame]:
    """A graph from tables with external ids (node_id; src, dst): checked, numbered, filled and placed; and the dictionary (ext_id, node_id).

    Missing columns, null ids, repeated ids and ends that are no node are errors whose rows
    tell them; ``on_duplicate='first'`` and ``strict=False`` keep the first of repeated ids and drop
    edges without both ends. Nodes get numbers from 0 in the order of their ids, attributes their
    defaults, and where no node lies off the origin all are placed by ``strategy`` with a radius of
    10 sqrt(n). Empty tables make an empty graph.
    """
    from graphloom.operators.placement import place, unplaced

    found = faults(nodes, edges)
    forgiven = F.lit(False)
    if on_duplicate == "first":
        forgiven = forgiven | (F.col("kind") == "id repeats")
    if not strict:
        forgiven = forgiven | F.col("kind").startswith("src") | F.col("kind").startswith("dst") | F.col("kind").startswith("edge without")
    if not (bad := found.where(~forgiven)).isEmpty():
        kind = bad.agg(F.min("kind")).first()[0]
        raise GraphError(1002 if kind == "id repeats" else 1003 if "is no node" in kind else 1001, kind, bad)
    if on_duplicate == "first":
        nodes = keep_first(nodes, ["node_id"], "node_id")
    known = dictionary(nodes, "node_id")
    own = nodes.withColumnRenamed("node_id", "_ext").join(known, F.col("_ext").cast("string") == F.col("ext_id")).drop("_ext")
    graph = with_defaults(own, encode(edges.withColumns({end: F.col(end).cast("string") for end in ("src", "dst")}), known))
    if unplaced(graph.nodes).first()[0]:
        graph = graph.with_(nodes=place(graph.nodes, strategy, order="node_id"))
    return graph, known


def undirected(edges: DataFrame) -> DataFrame:
    """Unordered pairs without self loops, each once."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a != b").distinct()


def dictionary(ids: DataFrame, col: str) -> DataFrame:
    """(ext_id, node_id): ids numbered from 0 in their order.

    They are counted over range partitions (``structure.running``): no task sees all ids, and
    the partitions are stored before they are counted, so that a retried task can't renumber.
    """
    from graphloom.operators.structure import running

    known = ids.select(F.col(col).cast("string").alias("ext_id")).where("ext_id is not null").distinct()
    return running(known, "ext_id", F.lit(1)).select("ext_id", F.col("before").alias("node_id"))


def encode(edges: DataFrame, ids: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with both ends replaced by their numbers; edges with an unknown end go."""
    for end in (src, dst):
        edges = edges.join(ids.select(F.col("ext_id").alias(end), F.col("node_id").alias("_id")), end).drop(end).withColumnRenamed("_id", end)
    return edges


def merge(graphs: list[Graph]) -> Graph:
    """One graph of all, ids moved up by the node counts of the graphs before."""
    nodes, edges, offset = [], [], 0
    for part, graph in enumerate(graphs):
        nodes.append(graph.nodes.select((F.col("node_id") + offset).alias("node_id"), F.lit(part).alias("part")))
        edges.append(graph.edges.select((F.col("src") + offset).alias("src"), (F.col("dst") + offset).alias("dst"), F.lit(part).alias("part")))
        offset += graph.nodes.count()
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return Graph(union(nodes), union(edges))


def read_json(spark: SparkSession, path: str) -> Graph:
    """A graph document with ``nodes`` and ``edges`` or ``links``; the usual field names for ids, labels, types and ends are understood."""
    doc = spark.read.json(path, multiLine=True)
    links = "edges" if "edges" in doc.columns else "links"
    node, edge = doc.select(F.posexplode("nodes").alias("ord", "n")), doc.select(F.posexplode(links).alias("ord", "e"))

    def first(df: DataFrame, field: str, names: tuple[str, ...]) -> Column:
        have = [F.col(f"{field}.{x}").cast("string") for x in names if x in df.schema[field].dataType.names]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    nodes = node.select("ord", first(node, "n", ("id", "name")).alias("node_id"), first(node, "n", ("label", "name", "id")).alias("label"), first(node, "n", ("type", "node_type")).alias("type"))
    edges = edge.select("ord", first(edge, "e", ("source", "from")).alias("src"), first(edge, "e", ("target", "to")).alias("dst"), first(edge, "e", ("type", "kind")).alias("type"))
    nodes = keep_first(nodes.where("node_id is not null"), ["node_id"], "ord")
    return Graph(nodes, keep_first(closed_edges(nodes, edges), ["src", "dst"], "ord"))


def columnar(spark: SparkSession, n_nodes: int, pairs: list[tuple[int, int]], positions: list[tuple[float, float]] | None = None) -> Graph:
    """A graph from counts and flat lists; ids are row numbers, named ``n<i>`` and ``e<i>``."""
    if positions is not None and len(positions) != n_nodes:
        raise GraphError(1001, "positions and nodes differ in number")
    if any(not 0 <= i < n_nodes for pair in pairs for i in pair):
        raise GraphError(1003, "an edge end is no node")
    nodes = spark.range(n_nodes).select(F.col("id").alias("node_id"), F.concat(F.lit("n"), "id").alias("ext_id"))
    place = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(positions or [])], "node_id long, x double, y double")
    edges = spark.createDataFrame([(i, f"e{i}", s, d) for i, (s, d) in enumerate(pairs)], "edge_id long, ext_id string, src long, dst long")
    return Graph(nodes.join(place, "node_id", "left"), edges)
