"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import color, geometry
from graphloom.operators import analytics, boundaries, density, forces, hierarchy, layers, outlines, placement, reach, relativity, spatial, structure, style, trees
from graphloom.operators.iterate import new_folder
from graphloom.plans.testgraphs import KNN, PLACED, POINTS, TRADE, TRANSITIONS, TREE, containment, knn, placed_suppliers, points, suppliers, table, trade, transitions
from graphloom.sources import graph as model
from graphloom.sources import ids
from graphloom.streaming import values

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with SQL for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4, but: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, as sums may be taken in any order; + 0.0 turns -0.0 into 0.0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


# Sources, validation, identity


@query("SELECT p_partkey AS node_id, CAST(0.0 AS DOUBLE) AS x, CAST(0.0 AS DOUBLE) AS y, CAST(5.0 AS DOUBLE) AS radius, p_type AS type FROM part")
def ingest_defaults(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_type").alias("type"))
    return model.with_defaults(parts, trade(spark, d)).nodes.select("node_id", "x", "y", "radius", "type")


@query("SELECT l_partkey AS node_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return model.duplicate_ids(trade(spark, d).withColumnRenamed("src", "node_id"))


@query(f"WITH {KNN} SELECT src, dst, weight FROM knn WHERE src % 7 = 0 OR dst % 7 = 0")
def dangling_edges(spark, d):
    return model.dangling_edges(suppliers(spark, d).where("node_id % 7 != 0"), knn(spark, d)).select("src", "dst", "weight")


@query(f"WITH {TRADE} SELECT DISTINCT src, dst FROM trade")
def dedup_edges_directed(spark, d):
    return trade(spark, d).select("src", "dst").distinct()


@query(f"WITH {KNN} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM knn WHERE src <> dst")
def dedup_edges_undirected(spark, d):
    return model.undirected(knn(spark, d))


@query("SELECT src, dst, l_quantity AS weight FROM (SELECT l_partkey AS src, l_suppkey AS dst, l_quantity, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem) q WHERE r = 1")
def edge_keepfirst(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return model.keep_first(rows, ["src", "dst"], "ord").select("src", "dst", "weight")


@query("SELECT c_name AS ext_id, CAST(row_number() OVER (ORDER BY c_name) - 1 AS BIGINT) AS node_id FROM (SELECT DISTINCT c_name FROM customer) q")
def id_dictionary(spark, d):
    return model.dictionary(table(spark, d, "customer"), "c_name")


@query("""WITH a AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name) - 1 AS node_id FROM customer WHERE c_custkey % 2 = 0),
f AS (SELECT node_id, row_number() OVER (ORDER BY node_id DESC) AS r FROM a WHERE c_custkey % 10 = 0),
n AS (SELECT c_name, row_number() OVER (ORDER BY c_name) AS r FROM customer WHERE c_custkey % 2 <> 0 OR c_custkey % 10 = 0)
SELECT c_name AS ext_id, CAST(node_id AS BIGINT) AS node_id FROM a WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_name, CAST(coalesce(node_id, (SELECT count(*) FROM a) + n.r - 1 - (SELECT count(*) FROM f)) AS BIGINT) FROM n LEFT JOIN f ON n.r = f.r""")
def id_map_growth(spark, d):
    names = table(spark, d, "customer").select("c_custkey", "c_name")
    known = ids.IdMap(spark, new_folder(spark))
    known.add(names.where("c_custkey % 2 = 0"), "c_name")
    known.remove(names.where("c_custkey % 10 = 0"), "c_name")
    known.add(names, "c_name")
    return known.entries()


@query(f"WITH {KNN}, n AS (SELECT count(*) AS n FROM supplier) SELECT src, dst, 0 AS part FROM knn UNION ALL SELECT src + n, dst + n, 1 FROM knn, n")
def merge_graphs(spark, d):
    one = model.Graph(suppliers(spark, d), knn(spark, d))
    return model.merge([one, one]).edges


# Incremental changes


@query(f"WITH {KNN} SELECT src, dst, weight FROM knn WHERE src % 3 <> 0 AND dst % 3 <> 0")
def remove_nodes_cascade(spark, d):
    g = model.Graph(suppliers(spark, d), knn(spark, d))
    return structure.remove_nodes(g, suppliers(spark, d).where("node_id % 3 = 0")).edges.select("src", "dst", "weight")


@query(f"WITH {KNN} SELECT src, dst, weight FROM knn UNION ALL SELECT k.dst, k.src + 1, k.weight FROM knn k JOIN supplier s ON k.src + 1 = s.s_suppkey")
def add_edges_checked(spark, d):
    g = model.Graph(suppliers(spark, d), knn(spark, d))
    return structure.add_edges(g, g.edges.select(F.col("dst").alias("src"), (F.col("src") + 1).alias("dst"), "weight")).edges


@query("SELECT c_custkey AS node_id, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS slot FROM customer WHERE c_custkey % 5 <> 0")
def node_remap(spark, d):
    return structure.compact(table(spark, d, "customer").select(F.col("c_custkey").alias("node_id")).where("node_id % 5 != 0"))


@query(f"WITH {POINTS} SELECT node_id, CASE WHEN node_id % 4 = 0 THEN 1.5 ELSE round(x, 4) + 0.0 END AS x, round(y, 4) + 0.0 AS y FROM points")
def set_positions(spark, d):
    p = points(spark, d).select("node_id", "x", "y")
    return rounded(structure.update(p, p.where("node_id % 4 = 0").select("node_id", F.lit(1.5).alias("x")), ["x"]))


# Structure


@query(f"WITH {KNN}, o AS (SELECT src AS node_id, count(*) AS n FROM knn GROUP BY 1), i AS (SELECT dst AS node_id, count(*) AS n FROM knn GROUP BY 1) SELECT s_suppkey AS node_id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM supplier LEFT JOIN o ON s_suppkey = o.node_id LEFT JOIN i ON s_suppkey = i.node_id")
def degrees(spark, d):
    return structure.degrees(suppliers(spark, d), knn(spark, d))


@query("SELECT p_partkey AS node_id, CAST(coalesce(sum(c) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"first\", CAST(c AS BIGINT) AS n FROM (SELECT p_partkey, count(l_partkey) AS c FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1) q")
def csr_forward(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"))
    return structure.csr(nodes, trade(spark, d)).select("node_id", "first", F.size("targets").cast("long").alias("n"))


@query(f"WITH {KNN} SELECT s_suppkey AS node_id, CAST(coalesce(sum(c) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"first\", t AS targets FROM (SELECT s_suppkey, count(src) AS c, coalesce(string_agg(CAST(src AS VARCHAR), ',' ORDER BY src), '') AS t FROM supplier LEFT JOIN knn ON s_suppkey = dst GROUP BY 1) q")
def csr_inverse(spark, d):
    return structure.csr(suppliers(spark, d), knn(spark, d), inverse=True).select("node_id", "first", F.array_join("targets", ",").alias("targets"))


@query(f"WITH {KNN}, c AS (SELECT s_suppkey AS node_id, count(src) AS n FROM supplier LEFT JOIN knn ON s_suppkey = src GROUP BY 1), f AS (SELECT node_id, n, coalesce(sum(n) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN node_id % 10 = 0 THEN 1 ELSE 0 END AS first_ FROM c), g AS (SELECT *, coalesce(lag(first_ + n) OVER (ORDER BY node_id), 0) AS want FROM f) SELECT count(*) AS faults FROM g WHERE first_ <> want")
def csr_validate(spark, d):
    """Faults of an adjacency table in which every tenth node's list begins one too late."""
    rows = structure.csr(suppliers(spark, d), knn(spark, d))
    shifted = rows.withColumn("first", F.col("first") + F.when(F.col("node_id") % 10 == 0, 1).otherwise(0))
    return structure.csr_faults(shifted).agg(F.count("*").alias("faults"))


@query(f"WITH {KNN} SELECT dst AS node_id FROM knn WHERE src = 3")
def neighbors(spark, d):
    return structure.neighbors(knn(spark, d), 3)


@query(f"WITH {KNN} SELECT src, dst, weight FROM knn WHERE src = 3 OR dst = 3")
def incident_edges(spark, d):
    return structure.incident(knn(spark, d), 3)


@query(f"WITH {POINTS} SELECT round(min(x), 4) AS min_x, round(min(y), 4) AS min_y, round(max(x), 4) AS max_x, round(max(y), 4) AS max_y FROM points")
def bounds(spark, d):
    return rounded(structure.bounds(points(spark, d)))


@query("WITH b AS (SELECT CAST(min(p_size) AS DOUBLE) AS x0, min(p_retailprice) AS y0, CAST(max(p_size) AS DOUBLE) AS x1, max(p_retailprice) AS y1 FROM part), m AS (SELECT *, greatest(100.0, 0.1 * greatest(x1 - x0, y1 - y0)) AS m FROM b) SELECT round(x0 - m, 4) AS min_x, round(y0 - m, 4) AS min_y, round(x1 + m, 4) AS max_x, round(y1 + m, 4) AS max_y FROM m")
def bounds_margin(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return rounded(structure.bounds_with_margin(p))


@query(f"WITH RECURSIVE {TREE}, walk AS (SELECT CAST(0 AS BIGINT) AS node_id, 0 AS depth UNION ALL SELECT t.dst, w.depth + 1 FROM walk w JOIN tree t ON w.node_id = t.src) SELECT node_id, depth FROM walk")
def bfs_depth(spark, d):
    return structure.depths(*containment(spark, d))


@query(f"WITH RECURSIVE {TREE}, walk AS (SELECT src AS node_id, dst AS below FROM tree UNION ALL SELECT w.node_id, t.dst FROM walk w JOIN tree t ON w.below = t.src) SELECT n.node_id, count(w.below) AS descendants FROM tnodes n LEFT JOIN walk w ON n.node_id = w.node_id GROUP BY 1")
def descendants(spark, d):
    return reach.reached_counts(*containment(spark, d))


@query(f"WITH {TREE} SELECT CAST(0 AS BIGINT) AS node_id, count(*) AS descendants FROM tree")
def root_detect(spark, d):
    return reach.root(*containment(spark, d))


# Spatial


@query(f"WITH {POINTS} SELECT node_id FROM points WHERE x BETWEEN -50 AND 80 AND y BETWEEN -20 AND 120")
def rect_select(spark, d):
    return spatial.in_rect(points(spark, d), -50, -20, 80, 120).select("node_id")


@query(f"WITH {POINTS} SELECT node_id FROM points WHERE x * x + y * y <= 10000")
def radius_select(spark, d):
    return spatial.in_radius(points(spark, d), 0.0, 0.0, 100.0).select("node_id")


@query(f"WITH {POINTS} SELECT a.node_id, b.node_id AS node_id2 FROM points a JOIN points b ON a.node_id <> b.node_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 225")
def grid_join(spark, d):
    return spatial.within_pairs(points(spark, d).select("node_id", "x", "y"), 15.0).select("node_id", "node_id2")


@query(f"WITH {POINTS} SELECT node_id, round(d2, 4) AS d2 FROM (SELECT node_id, (x - 10) * (x - 10) + (y + 5) * (y + 5) AS d2 FROM points) q ORDER BY q.d2, node_id LIMIT 7")
def nearest_k(spark, d):
    return rounded(spatial.nearest(points(spark, d), 10.0, -5.0, 7).select("node_id", "d2"))


@query(f"WITH {POINTS}, j AS (SELECT a.node_id AS query_id, b.node_id, (a.x + 3 - b.x) * (a.x + 3 - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM points a JOIN points b ON (a.x + 3 - b.x) * (a.x + 3 - b.x) + (a.y - b.y) * (a.y - b.y) <= 400) SELECT query_id, node_id, round(d2, 4) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, node_id) AS r FROM j) q WHERE r = 1")
def nearest_within(spark, d):
    p = points(spark, d)
    return rounded(spatial.nearest_within(p.select(F.col("node_id").alias("query_id"), (F.col("x") + 3).alias("x"), "y"), p, 20.0))


_SEGMENT = f"""WITH {KNN}, {PLACED}, e AS (SELECT k.src, k.dst, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy FROM knn k JOIN placed a ON k.src = a.node_id JOIN placed b ON k.dst = b.node_id),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0, least(1.0, ((12.0 - x) * dx + (7.0 - y) * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t FROM e),
q AS (SELECT src, dst, sqrt((x + t * dx - 12.0) * (x + t * dx - 12.0) + (y + t * dy - 7.0) * (y + t * dy - 7.0)) AS distance FROM t)
SELECT src, dst, round(distance, 4) AS distance FROM q WHERE q.distance < 50 ORDER BY q.distance, src, dst LIMIT 1"""


@query(_SEGMENT)
def edge_pick(spark, d):
    return rounded(spatial.pick_edge(knn(spark, d), placed_suppliers(spark, d), 12.0, 7.0, 50.0))


#: Places to pick at, one a customer, and every segment's distance from each.
_PICKS = f"""WITH {KNN}, {PLACED}, picks AS (SELECT c_custkey AS query_id, CAST(c_custkey * 37 % 211 - 105 AS DOUBLE) AS qx, CAST(c_custkey * 53 % 197 - 98 AS DOUBLE) AS qy FROM customer),
e AS (SELECT k.src, k.dst, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy FROM knn k JOIN placed a ON k.src = a.node_id JOIN placed b ON k.dst = b.node_id),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0, least(1.0, ((qx - x) * dx + (qy - y) * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t FROM e, picks),
m AS (SELECT query_id, src, dst, sqrt((x + t * dx - qx) * (x + t * dx - qx) + (y + t * dy - qy) * (y + t * dy - qy)) AS distance FROM t),
edge_hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, src, dst) AS r FROM m WHERE distance < 3) q WHERE r = 1),
node_hit AS (SELECT * FROM (SELECT query_id, node_id, sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY (x - qx) * (x - qx) + (y - qy) * (y - qy), node_id) AS r FROM picks, placed) q WHERE r = 1 AND distance <= 4)"""


def _picks(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") * 37 % 211 - 105).cast("double").alias("x"), (F.col("c_custkey") * 53 % 197 - 98).cast("double").alias("y"))


@query(f"{_PICKS} SELECT query_id, src, dst, round(distance, 4) AS distance FROM edge_hit")
def edge_hits(spark, d):
    return rounded(spatial.nearest_edges(_picks(spark, d), knn(spark, d), placed_suppliers(spark, d), 3.0))


@query(f"{_PICKS} SELECT coalesce(n.query_id, e.query_id) AS query_id, CASE WHEN n.query_id IS NULL THEN 'edge' ELSE 'node' END AS kind, coalesce(n.node_id, -1) AS node_id, CASE WHEN n.query_id IS NULL THEN src ELSE -1 END AS src, CASE WHEN n.query_id IS NULL THEN dst ELSE -1 END AS dst, round(coalesce(n.distance, e.distance), 4) AS distance FROM node_hit n FULL JOIN edge_hit e ON n.query_id = e.query_id")
def combined_hits(spark, d):
    return rounded(spatial.hits(_picks(spark, d), knn(spark, d), placed_suppliers(spark, d), 4.0, 3.0)).na.fill(-1, ["node_id", "src", "dst"])


@query(f"{_PICKS} SELECT coalesce(n.query_id, e.query_id) AS query_id, CASE WHEN n.distance < e.distance OR e.query_id IS NULL THEN 'node' ELSE 'edge' END AS kind FROM (SELECT * FROM node_hit WHERE distance <= 20 / 8.0) n FULL JOIN (SELECT * FROM edge_hit WHERE distance < 5 / 8.0) e ON n.query_id = e.query_id")
def screen_picks(spark, d):
    view = geometry.Viewport(x=3.0, y=-2.0, scale=8.0, width=640.0, height=480.0)
    screen = _picks(spark, d).select("query_id", ((F.col("x") - 3.0) * 8 + 320).alias("x"), ((F.col("y") + 2.0) * 8 + 240).alias("y"))
    return spatial.screen_hits(screen, knn(spark, d), placed_suppliers(spark, d), view, nodes_first=False).select("query_id", "kind")


# Placement

_I = "SELECT s_suppkey AS node_id, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS DOUBLE) AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM supplier"
for _name, _x, _y in (
    ("grid", "-100 + 200 / greatest(ceil(sqrt(n)) - 1, 1.0) * (i % ceil(sqrt(n)))", "-100 + 200 / greatest(ceil(sqrt(n)) - 1, 1.0) * floor(i / ceil(sqrt(n)))"),
    ("circle", "100 * cos(2 * pi() * i / n)", "100 * sin(2 * pi() * i / n)"),
    ("spiral", "100 * (i / greatest(n - 1, 1.0)) * cos(6 * pi() * (i / greatest(n - 1, 1.0)))", "100 * (i / greatest(n - 1, 1.0)) * sin(6 * pi() * (i / greatest(n - 1, 1.0)))"),
    ("phyllotaxis", "100 * sqrt(i / n) * cos(i * (pi() * (3 - sqrt(5))))", "100 * sqrt(i / n) * sin(i * (pi() * (3 - sqrt(5))))"),
):
    QUERIES[f"place_{_name}"] = lambda spark, d, s=_name: rounded(placement.place(structure.compact(suppliers(spark, d)), s, 100.0).select("node_id", "x", "y"))
    ORACLES[f"place_{_name}"] = f"WITH q AS ({_I}) SELECT node_id, round({_x}, 4) + 0.0 AS x, round({_y}, 4) + 0.0 AS y FROM q"


# Forces

_PAIR = f"WITH {KNN}, {PLACED}, deg AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM knn UNION ALL SELECT dst FROM knn) q GROUP BY 1), p AS (SELECT placed.node_id, x, y, coalesce(degree, 0) AS degree, placed.node_id % 3 AS community FROM placed LEFT JOIN deg ON placed.node_id = deg.node_id), pr AS (SELECT a.node_id, a.x - b.x AS dx, a.y - b.y AS dy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, a.degree AS g1, b.degree AS g2, a.community = b.community AS same FROM p a JOIN p b ON a.node_id <> b.node_id), ed AS (SELECT k.src, k.dst, k.weight, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM knn k JOIN p a ON k.src = a.node_id JOIN p b ON k.dst = b.node_id)"


def _pair_sql(f: str) -> str:
    return f"{_PAIR} SELECT node_id, round(sum({f} * dx / d), 4) + 0.0 AS fx, round(sum({f} * dy / d), 4) + 0.0 AS fy FROM pr WHERE d > 1e-4 AND d <= 1000 GROUP BY 1"


def _edge_sql(f: str) -> str:
    return f"{_PAIR} SELECT node_id, round(sum(s * ({f}) * dx / d), 4) + 0.0 AS fx, round(sum(s * ({f}) * dy / d), 4) + 0.0 AS fy FROM (SELECT src AS node_id, 1 AS s, dx, dy, d, weight FROM ed UNION ALL SELECT dst, -1, dx, dy, d, weight FROM ed) q WHERE d > 1e-4 GROUP BY 1"


def _bodies(spark, d, edges: DataFrame | None = None) -> DataFrame:
    p, e = placed_suppliers(spark, d).select("node_id", "x", "y"), knn(spark, d) if edges is None else edges
    return p.join(structure.degrees(p, e).select("node_id", "degree"), "node_id").withColumn("community", F.col("node_id") % 3)


@query(_pair_sql("(50 / (greatest(d, 1.0) * greatest(d, 1.0)) * d / greatest(d, 1.0))"))
def force_n2(spark, d):
    return rounded(forces.repulsion(_bodies(spark, d)))


@query(_pair_sql("(5.0 / greatest(d, 0.01) * (g1 + 1) * (g2 + 1))"))
def force_fa2(spark, d):
    return rounded(forces.degree_repulsion(_bodies(spark, d)))


@query(_pair_sql("greatest(50 * d / ((1 + d * d) * (1 + d * d)), 15.0)"))
def force_tfdp(spark, d):
    return rounded(forces.student_repulsion(_bodies(spark, d)))


@query(_pair_sql("(50 / (greatest(d, 1.0) * greatest(d, 1.0)) * sqrt(g1 + 1.0) * sqrt(g2 + 1.0) * CASE WHEN same THEN 0.5 ELSE 1.5 END)"))
def force_comm_repulsion(spark, d):
    return rounded(forces.community_repulsion(_bodies(spark, d)))


@query(_edge_sql("0.1 * (d - 30)"))
def force_springs(spark, d):
    e = knn(spark, d)
    return rounded(forces.springs(_bodies(spark, d, e), e))


@query(_edge_sql("weight * ln(1 + d)"))
def force_linlog(spark, d):
    e = knn(spark, d)
    return rounded(forces.linlog_attraction(_bodies(spark, d, e), e), 3)


ORACLES["force_linlog"] = ORACLES["force_linlog"].replace(", 4)", ", 3)")


@query(_edge_sql("0.1 * d + 8.0 * d / (1 + d * d)"))
def force_tfdp_attraction(spark, d):
    e = knn(spark, d)
    return rounded(forces.student_attraction(_bodies(spark, d, e), e))


@query(f"{_PAIR}, c AS (SELECT community, avg(x) AS mx, avg(y) AS my, count(*) AS m FROM p GROUP BY 1) SELECT node_id, round(0.1 * sqrt(degree + 1.0) / sqrt(m) * (mx - x), 4) + 0.0 AS fx, round(0.1 * sqrt(degree + 1.0) / sqrt(m) * (my - y), 4) + 0.0 AS fy FROM p JOIN c ON p.community = c.community")
def force_cluster(spark, d):
    return rounded(forces.cluster_attraction(_bodies(spark, d)))


@query(f"WITH {KNN}, {PLACED} SELECT node_id, round(0.3 * (1 - exp(-sqrt((10 - x) * (10 - x) + (20 - y) * (20 - y)) * 0.5)) * (10 - x), 4) + 0.0 AS fx, round(0.3 * (1 - exp(-sqrt((10 - x) * (10 - x) + (20 - y) * (20 - y)) * 0.5)) * (20 - y), 4) + 0.0 AS fy FROM placed WHERE node_id % 2 = 0")
def force_target(spark, d):
    p = placed_suppliers(spark, d)
    target = p.select("node_id", F.when(F.col("node_id") % 2 == 0, 10.0).alias("tx"), F.when(F.col("node_id") % 2 == 0, 20.0).alias("ty"))
    return rounded(forces.target_spring(p, target))


def _mass_sql(rounds: int) -> str:
    steps = [f"m{i} AS MATERIALIZED (SELECT node_id, 1.0 + 0.5 * coalesce(s, 0.0) AS mass FROM tnodes LEFT JOIN (SELECT src, sum(mass) AS s FROM tree JOIN m{i - 1} ON dst = node_id GROUP BY 1) q ON node_id = src)" for i in range(1, rounds + 1)]
    start = "m0 AS (SELECT node_id, 1.0 + 0.1 * coalesce(c, 0) AS mass FROM tnodes LEFT JOIN (SELECT src, count(*) AS c FROM tree GROUP BY 1) q ON node_id = src)"
    return f"WITH {TREE}, {start}, {', '.join(steps)} SELECT node_id, round(CAST(mass AS DOUBLE), 4) AS mass FROM m{rounds}"


@query(_mass_sql(20))
def mass_propagate(spark, d):
    return rounded(forces.propagate_mass(*containment(spark, d)))


_TICK = f"""{_PAIR}, f AS (SELECT node_id, sum(fx) AS fx, sum(fy) AS fy FROM (
SELECT node_id, 50 / (greatest(d, 1.0) * greatest(d, 1.0)) * dx / greatest(d, 1.0) AS fx, 50 / (greatest(d, 1.0) * greatest(d, 1.0)) * dy / greatest(d, 1.0) AS fy FROM pr WHERE d > 1e-4 AND d <= 1000
UNION ALL SELECT src, 0.1 * (d - 30) * dx / d, 0.1 * (d - 30) * dy / d FROM ed WHERE d > 1e-4
UNION ALL SELECT dst, -0.1 * (d - 30) * dx / d, -0.1 * (d - 30) * dy / d FROM ed WHERE d > 1e-4) q GROUP BY 1),
v AS (SELECT p.node_id, x, y, coalesce(fx, 0.0) - 0.01 * x AS vx, coalesce(fy, 0.0) - 0.01 * y AS vy FROM p LEFT JOIN f ON p.node_id = f.node_id),
s AS (SELECT *, CASE WHEN sqrt(vx * vx + vy * vy) > 50 THEN 50 / sqrt(vx * vx + vy * vy) ELSE 1.0 END AS k FROM v)
SELECT node_id, round(x + vx * k, 4) + 0.0 AS x, round(y + vy * k, 4) + 0.0 AS y, round(vx * k, 4) + 0.0 AS vx, round(vy * k, 4) + 0.0 AS vy FROM s"""


@query(_TICK)
def tick_integrate(spark, d):
    e, c = knn(spark, d), forces.Config()
    p = _bodies(spark, d, e)
    return rounded(forces.integrate(p, forces.MODELS["n2"](p, e, c), c).select("node_id", "x", "y", "vx", "vy"))


entry = tick_integrate


@query()
def layout_barnes_hut(spark, d):
    e = knn(spark, d)
    return forces.layout(_bodies(spark, d, e), e, "barnes-hut").select("node_id", "x", "y")


@query(f"WITH {POINTS}, pr AS (SELECT a.node_id, a.x - b.x AS dx, a.y - b.y AS dy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM points a JOIN points b ON a.node_id <> b.node_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 64), m AS (SELECT node_id, sum(0.35 * (8 - d) * dx / d) AS mx, sum(0.35 * (8 - d) * dy / d) AS my FROM pr WHERE d > 1e-4 GROUP BY 1) SELECT p.node_id, round(x + coalesce(mx, 0.0), 4) + 0.0 AS x, round(y + coalesce(my, 0.0), 4) + 0.0 AS y FROM points p LEFT JOIN m ON p.node_id = m.node_id")
def collision_grid(spark, d):
    p = points(spark, d).withColumn("radius", F.lit(4.0))
    return rounded(forces.collide(p, largest=4.0).select("node_id", "x", "y"))


# Density and order


@query(f"""WITH {POINTS}, o AS (SELECT CAST(range AS BIGINT) AS o FROM range(-3, 4)), s AS (SELECT CAST(floor(x / 20) AS BIGINT) + a.o AS cx, CAST(floor(y / 20) AS BIGINT) + b.o AS cy, x, y FROM points, o a, o b),
u AS (SELECT cx, cy, (((cx + 0.5) * 20 - x) * ((cx + 0.5) * 20 - x) + ((cy + 0.5) * 20 - y) * ((cy + 0.5) * 20 - y)) / 2500.0 AS u FROM s), w AS (SELECT *, greatest(0.0, least(1.0, (u - 0.3) / 0.7)) AS t FROM u WHERE u <= 1.2)
SELECT cx, cy, round(sum(0.1 * exp(-2 * u) * (1 - t * t * (3 - 2 * t))), 4) AS density FROM w GROUP BY 1, 2""")
def kde_grid(spark, d):
    return rounded(density.kde(points(spark, d), 20.0, 50.0))


_KDE = ORACLES["kde_grid"]


@query(f"WITH g AS ({_KDE.replace('round(sum(', '(sum(').replace('))), 4) AS density', ')))) AS density')}), m AS (SELECT max(density) AS m FROM g), t AS (SELECT CAST(unnest([0.2, 0.4, 0.6, 0.8]) AS DOUBLE) AS threshold) SELECT cx, cy, threshold FROM g, m, t WHERE abs(density / m - threshold) < 0.01")
def contour_band(spark, d):
    return density.contour_bands(density.kde(points(spark, d), 20.0, 50.0), [0.2, 0.4, 0.6, 0.8])


@query()
def contour_segments(spark, d):
    return density.marching_squares(density.kde(points(spark, d), 20.0, 50.0), [0.2, 0.4, 0.6, 0.8])


@query()
def metaball_field(spark, d):
    return rounded(density.metaball(points(spark, d), 20.0, 15.0, 10.0))


def _bits(v: str) -> str:
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = f"((({v}) | (({v}) << {shift})) & {mask})"
    return v


@query(f"WITH {POINTS}, b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y), 1.0) AS e FROM points), q AS (SELECT node_id, CAST(least(65535, greatest(0, floor((x - x0) / e * 65535))) AS BIGINT) AS a, CAST(least(65535, greatest(0, floor((y - y0) / e * 65535))) AS BIGINT) AS c FROM points, b), s AS (SELECT node_id, {_bits('a')} AS a, {_bits('c')} AS c FROM q) SELECT node_id, a | (c << 1) AS code FROM s")
def morton_code(spark, d):
    return density.morton(points(spark, d))


# Streams, colours, styles


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) q WHERE r = 1")
def stream_latest(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return values.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("""WITH r AS (SELECT event_type AS stream, user_id AS node_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value, ts AS moment, event_id AS seq FROM events WHERE event_id % 997 <> 0),
c AS (SELECT event_type AS stream, max({'moment': ts, 'seq': event_id}) AS clear FROM events WHERE event_id % 997 = 0 GROUP BY 1)
SELECT r.stream, node_id, round(value, 4) AS value, seq FROM (SELECT *, row_number() OVER (PARTITION BY stream, node_id ORDER BY moment DESC, seq DESC) AS n FROM r) r LEFT JOIN c ON r.stream = c.stream WHERE n = 1 AND value IS NOT NULL AND (clear IS NULL OR {'moment': moment, 'seq': seq} > clear)""")
def stream_keyed_state(spark, d):
    """Events as changes of keyed values: every fifth clears its key, a few their whole stream."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    changes = events.select(F.col("event_type").alias("stream"), F.when(F.col("event_id") % 997 != 0, F.col("user_id")).alias("node_id"), F.when((F.col("event_id") % 5 != 0) & (F.col("event_id") % 997 != 0), F.col("value")).alias("value"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    out = new_folder(spark)
    values.keep_values(changes, f"{out}/values", f"{out}/checkpoint").awaitTermination()
    return rounded(values.current_values(spark, f"{out}/values").select("stream", "node_id", "value", "seq"))


@query("SELECT event_id, round(greatest(0.0, least(1.0, (value - 10) / 90)), 6) AS level FROM events")
def stream_normalize(spark, d):
    return table(spark, d, "events").select("event_id", F.round(color.normalise(F.col("value"), 10.0, 100.0), 6).alias("level"))


@query("WITH t AS (SELECT event_id, greatest(0.0, least(1.0, (value - 10) / 90)) AS t FROM events) SELECT event_id, round(CASE WHEN t <= 0.5 THEN 2 * t ELSE 1.0 END, 6) AS r, round(CASE WHEN t <= 0.5 THEN 2 * t ELSE 2 - 2 * t END, 6) AS g, round(CASE WHEN t <= 0.5 THEN 1 - 2 * t ELSE 0.0 END, 6) + 0.0 AS b FROM t")
def stream_color(spark, d):
    t = color.normalise(F.col("value"), 10.0, 100.0)
    c = table(spark, d, "events").select("event_id", color.scale(t, [(0.0, (0, 0, 1, 1)), (0.5, (1, 1, 0, 1)), (1.0, (1, 0, 0, 1))]).alias("c"))
    return rounded(c.select("event_id", "c.r", "c.g", "c.b"), 6)


@query("SELECT user_id, round(least(1.0, sum(least(1.0, value / 500) * 0.05)), 6) AS level FROM events GROUP BY 1")
def stream_blend_additive(spark, d):
    level = F.least(F.lit(1.0), F.sum(F.least(F.lit(1.0), F.col("value") / 500) * 0.05))  # layers add up in any order: no user's are held at once
    return table(spark, d, "events").groupBy("user_id").agg(F.round(level, 6).alias("level"))


@query("SELECT p_partkey AS node_id, CAST(CASE WHEN p_partkey % 10 = 0 THEN 9.0 WHEN p_size > 40 THEN 7.0 ELSE 5.0 END AS DOUBLE) AS radius FROM part")
def style_precedence(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_size") > 40, "big").otherwise("small").alias("type"), F.lit(5.0).alias("radius"))
    types = spark.createDataFrame([("big", 7.0)], "type string, radius double")
    return style.styled(parts, types, parts.where("node_id % 10 = 0").select("node_id", F.lit(9.0).alias("radius")), ["radius"], "node_id").select("node_id", "radius")


@query("SELECT p_partkey AS node_id, '#' || lower(lpad(to_hex(CAST(round(p_size / 50.0 * 255) AS BIGINT)), 2, '0')) || '80ff' AS hex FROM part")
def color_to_hex(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), color.to_hex(F.col("p_size") / 50, F.lit(128 / 255), F.lit(1.0)).alias("hex"))


@query("SELECT p_partkey AS node_id, round(CAST(p_size AS DOUBLE) / 255, 6) AS r, round(CAST(p_partkey % 256 AS DOUBLE) / 255, 6) AS g FROM part")
def parse_color(spark, d):
    text = F.concat(F.lit("rgb("), F.col("p_size"), F.lit(", "), F.col("p_partkey") % 256, F.lit(", 0)"))
    return rounded(table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), color.parse(text).alias("c")).select("node_id", "c.r", "c.g"), 6)


@query("SELECT s_suppkey AS node_id FROM supplier WHERE (s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) AND s_suppkey % 5 <> 0")
def selection_diff(spark, d):
    s = suppliers(spark, d)
    return style.deselect(style.select_also(s.where("node_id % 2 = 0"), s.where("node_id % 3 = 0")), s.where("node_id % 5 = 0"))


@query(f"WITH {POINTS}, c AS (SELECT node_id, community AS priority, floor(x * 2 / 50) AS cx, floor(y * 2 / 50) AS cy FROM points WHERE x BETWEEN -200 AND 200 AND y BETWEEN -200 AND 200), b AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY priority DESC, node_id) AS r FROM c) SELECT node_id, CAST(priority AS DOUBLE) AS priority FROM b WHERE r = 1 ORDER BY b.priority DESC, node_id LIMIT 40")
def label_topk(spark, d):
    labels = points(spark, d).select("node_id", F.col("node_id").cast("string").alias("text"), F.col("community").cast("double").alias("priority"), "x", "y", F.lit(0.0).alias("min_zoom"), F.lit(9.0).alias("max_zoom"))
    return style.visible_labels(labels, 2.0, (-200, -200, 200, 200), most=40).select("node_id", "priority")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 9) AS mean FROM events")
def frame_stats(spark, d):
    return rounded(values.rolling_mean(table(spark, d, "events"), "user_id", "event_id", "value").select("event_id", "mean"), 9)


# Geometry


@query(f"WITH {POINTS} SELECT node_id, round((x - 5) * 2 + 400, 4) AS sx, round((y + 3) * 2 + 300, 4) AS sy FROM points")
def viewport_transform(spark, d):
    sx, sy = geometry.Viewport(5.0, -3.0, 2.0).to_screen().apply(F.col("x"), F.col("y"))
    return rounded(points(spark, d).select("node_id", sx.alias("sx"), sy.alias("sy")))


@query(f"WITH {KNN}, {PLACED}, t AS (SELECT range / 4.0 AS t FROM range(0, 5)), c AS (SELECT src, dst, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, CAST(t AS DOUBLE) AS t, (a.x + b.x) / 2 - (b.y - a.y) * 0.25 AS cx, (a.y + b.y) / 2 + (b.x - a.x) * 0.25 AS cy FROM knn JOIN placed a ON src = a.node_id JOIN placed b ON dst = b.node_id, t) SELECT src, dst, t, round((1 - t) * (1 - t) * x1 + 2 * t * (1 - t) * cx + t * t * x2, 4) + 0.0 AS x, round((1 - t) * (1 - t) * y1 + 2 * t * (1 - t) * cy + t * t * y2, 4) + 0.0 AS y FROM c")
def bezier_points(spark, d):
    rows = spatial.placed(knn(spark, d), placed_suppliers(spark, d)).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("t", F.col("t") / 4.0)
    x, y = geometry.curve(F.col("t"), F.col("x"), F.col("y"), F.col("x2"), F.col("y2"), 0.25)
    return rounded(rows.select("src", "dst", "t", x.alias("_x"), y.alias("_y")).withColumnsRenamed({"_x": "x", "_y": "y"}))


@query("SELECT event_id, round(1 - abs(2 * (value / 100 - floor(value / 100)) - 1), 6) AS wave FROM events")
def flow_wave(spark, d):
    return rounded(table(spark, d, "events").select("event_id", geometry.wave("triangle", F.col("value") / 100).alias("wave")), 6)


# Hierarchies


@query(f"WITH RECURSIVE {TREE}, c AS (SELECT src, 10.0 AS r2, dst FROM tree WHERE dst >= 1000), n AS (SELECT src AS node_id, sqrt(count(*) * 100.0 / 0.82) + 5 AS r FROM c GROUP BY 1), nn AS (SELECT t.src, t.dst, coalesce(n.r, 10.0) AS r FROM tree t LEFT JOIN n ON t.dst = n.node_id WHERE t.dst BETWEEN 100 AND 999), g AS (SELECT src AS node_id, greatest(sqrt(sum(r * r) / 0.82), 10.0) + 5 AS r FROM nn GROUP BY 1), gg AS (SELECT t.dst, coalesce(g.r, 10.0) AS r FROM tree t LEFT JOIN g ON t.dst = g.node_id WHERE t.dst BETWEEN 10 AND 99), z AS (SELECT greatest(sqrt(sum(r * r) / 0.82), 10.0) + 5 AS r FROM gg) SELECT CAST(0 AS BIGINT) AS node_id, round(r, 4) AS radius FROM z UNION ALL SELECT dst, round(r, 4) FROM gg UNION ALL SELECT dst, round(r, 4) FROM nn UNION ALL SELECT dst, 10.0 FROM tree WHERE dst >= 1000")
def bubble_radius(spark, d):
    return rounded(hierarchy.bubble_radii(hierarchy.spanning(*containment(spark, d), 0)).select("node_id", "radius"))


@query()
def pack_layout(spark, d):
    return hierarchy.pack_layout(hierarchy.bubble_radii(hierarchy.spanning(*containment(spark, d), 0)))


def _tidy_sql() -> str:
    """The containment tree level by level: each family's outlines (lists of lowest and highest places by depth) merged in pairs, then pairs of pairs."""
    parts = [TREE, "o3 AS (SELECT node_id, [0.0::DOUBLE] AS l, [0.0::DOUBLE] AS h FROM tnodes WHERE node_id >= 1000)"]
    for depth, (low, high) in ((3, (100, 999)), (2, (10, 99)), (1, (0, 9))):
        parts.append(f"b{depth}_0 AS MATERIALIZED (SELECT src AS parent, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS b, l, h, [{{'n': dst, 'a': 0.0::DOUBLE}}] AS m FROM tree JOIN o{depth} ON dst = node_id)")
        for turn in range(rounds := 31 if depth == 3 else 16):  # families of up to 2 ** rounds
            parts.append(f"p{depth}_{turn} AS (SELECT parent, b // 2 AS b, {', '.join(f'any_value({c}) FILTER (b % 2 = {k}) AS {c}{k}' for c in 'lhm' for k in (0, 1))} FROM b{depth}_{turn} GROUP BY 1, 2)")
            parts.append(f"q{depth}_{turn} AS (SELECT *, list_max(list_transform(range(1, least(len(l0), len(l1)) + 1), lambda i: h0[i] + CASE WHEN i = 1 THEN 1.0 ELSE 2.0 END - l1[i])) AS s FROM p{depth}_{turn})")
            parts.append(f"b{depth}_{turn + 1} AS MATERIALIZED (SELECT parent, b, list_concat(l0, list_transform(l1[len(l0) + 1:], lambda v: v + s)) AS l, list_concat(list_transform(h1, lambda v: v + s), h0[coalesce(len(h1), 0) + 1:]) AS h, list_concat(m0, list_transform(m1, lambda v: {{'n': v.n, 'a': v.a + s}})) AS m FROM q{depth}_{turn})")
        parts.append(f"f{depth} AS MATERIALIZED (SELECT *, m[len(m)].a / 2 AS mid FROM b{depth}_{rounds})")
        parts.append(f"r{depth} AS (SELECT parent, c.n AS node_id, c.a - mid AS step FROM (SELECT parent, mid, unnest(m) AS c FROM f{depth}) q)")
        parts.append(f"o{depth - 1} AS (SELECT node_id, list_concat([0.0::DOUBLE], list_transform(l, lambda v: v - mid)) AS l, list_concat([0.0::DOUBLE], list_transform(h, lambda v: v - mid)) AS h FROM tnodes LEFT JOIN f{depth} ON node_id = parent WHERE node_id BETWEEN {low} AND {high})")
    parts.append("x AS MATERIALIZED (SELECT 0 AS node_id, 0 AS depth, 0.0 AS a UNION ALL SELECT node_id, 1, step FROM r1 UNION ALL SELECT r2.node_id, 2, r1.step + r2.step FROM r2 JOIN r1 ON r2.parent = r1.node_id UNION ALL SELECT r3.node_id, 3, r1.step + r2.step + r3.step FROM r3 JOIN r2 ON r3.parent = r2.node_id JOIN r1 ON r2.parent = r1.node_id)")
    return f"WITH {', '.join(parts)} SELECT CAST(node_id AS BIGINT) AS node_id, round((a - (SELECT (min(a) + max(a)) / 2 FROM x)) * 80, 4) + 0.0 AS x, CAST(depth * 80 AS DOUBLE) AS y FROM x"


@query(_tidy_sql())
def tidy_tree(spark, d):
    return rounded(trees.tidy(hierarchy.spanning(*containment(spark, d), 0), radial=False))


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT CAST(0 AS BIGINT) AS node_id, 0 AS depth, '' AS path UNION ALL SELECT dst, depth + 1, path || lpad(CAST(dst AS VARCHAR), 12, '0') FROM w JOIN tree ON src = node_id),
o AS (SELECT node_id, depth, path, row_number() OVER (ORDER BY path) - 1 AS pre, row_number() OVER (ORDER BY path || '~') - 1 AS post FROM w)
SELECT a.node_id, a.pre, a.post, (SELECT count(*) FROM o b WHERE starts_with(b.path, a.path)) AS size, CAST(a.depth AS BIGINT) AS depth FROM o a""")
def tree_tour(spark, d):
    nodes, edges = containment(spark, d)
    return trees.tour(nodes.join(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("parent")), "node_id", "left")).select("node_id", "pre", "post", "size", "depth")


def _code(spark, d):
    """The containment tree as a code base: the root its repository, regions directories, nations files, customers symbols."""
    return hierarchy.spanning(*containment(spark, d), 0).withColumn("category", F.col("depth"))


@query(f"""WITH {TREE}, n AS (SELECT t.dst AS node_id, t.src AS parent, CASE WHEN count(c.dst) = 0 THEN 12.0 ELSE greatest(sqrt(count(c.dst) * 25.0 / 0.82), 12.0) + 8 END AS r FROM tree t LEFT JOIN tree c ON c.src = t.dst WHERE t.dst BETWEEN 100 AND 999 GROUP BY 1, 2),
g AS (SELECT t.dst AS node_id, CASE WHEN count(n.r) = 0 THEN 25.0 ELSE greatest(sqrt(sum(n.r * n.r) / 0.82), 25.0) + 15 END AS r FROM tree t LEFT JOIN n ON n.parent = t.dst WHERE t.dst BETWEEN 10 AND 99 GROUP BY 1)
SELECT CAST(0 AS BIGINT) AS node_id, round(greatest(sqrt(sum(r * r) / 0.82), 50.0) + 15, 4) AS radius FROM g UNION ALL SELECT node_id, round(r, 4) FROM g UNION ALL SELECT node_id, round(r, 4) FROM n UNION ALL SELECT dst, 5.0 FROM tree WHERE dst >= 1000""")
def codebase_radius(spark, d):
    return rounded(hierarchy.codebase_radii(_code(spark, d)).select("node_id", "radius"))


@query()
def codebase_layout(spark, d):
    return rounded(hierarchy.codebase_layout(_code(spark, d), rounds=6))


# Analytics


_WEAK = "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey % 97 + 1000000 AS b FROM orders), s AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e), n AS (SELECT src AS node_id FROM s UNION SELECT c_custkey FROM customer), r AS (SELECT node_id, node_id AS c FROM n UNION SELECT s.dst, r.c FROM r JOIN s ON r.node_id = s.src) SELECT node_id, min(c) AS component FROM r GROUP BY 1"


@query(_WEAK)
def weak_components(spark, d):
    """Customers tied by their number's rest by 97 where they have orders; customers without are alone."""
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") % 97 + 1000000).alias("dst")).distinct()
    n = e.select("src").union(e.select("dst")).union(table(spark, d, "customer").select("c_custkey")).distinct().withColumnRenamed("src", "node_id")
    return analytics.weak_components(n, e)


QUERIES["weak_components_all"], ORACLES["weak_components_all"] = weak_components, _WEAK


@query(f"WITH RECURSIVE {KNN.replace('r <= 5', 'r <= 2')}, w AS (SELECT s_suppkey AS a, s_suppkey AS b FROM supplier UNION SELECT a, dst FROM w JOIN knn ON b = src) SELECT x.a AS node_id, min(x.b) AS component FROM w x JOIN w y ON x.a = y.b AND x.b = y.a GROUP BY 1")
def strong_components(spark, d):
    return reach.strong_components(suppliers(spark, d), knn(spark, d, 2))


def _rank_sql(rounds: int) -> str:
    steps = [f"r{i} AS MATERIALIZED (SELECT n.node_id, 0.15 / c.n + 0.85 * (coalesce(s, 0.0) + l.lost / c.n) AS rank FROM nodes n LEFT JOIN (SELECT k.dst, sum(r.rank / o.n) AS s FROM knn k JOIN o ON k.src = o.src JOIN r{i - 1} r ON k.src = r.node_id GROUP BY 1) q ON n.node_id = q.dst, c, (SELECT coalesce(sum(rank), 0.0) AS lost FROM r{i - 1} WHERE node_id NOT IN (SELECT src FROM o)) l)" for i in range(1, rounds + 1)]
    return f"WITH {KNN.replace('knn AS (', 'knn AS MATERIALIZED (')}, nodes AS (SELECT s_suppkey AS node_id FROM supplier), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes), o AS (SELECT src, CAST(count(*) AS DOUBLE) AS n FROM knn GROUP BY 1), r0 AS (SELECT node_id, 1.0 / c.n AS rank FROM nodes, c), {', '.join(steps)} SELECT node_id, round(rank, 6) AS rank FROM r{rounds}"


@query(_rank_sql(20))
def pagerank(spark, d):
    return rounded(analytics.pagerank(suppliers(spark, d), knn(spark, d)), 6)


@query(_rank_sql(20))
def pagerank_20(spark, d):
    return rounded(analytics.pagerank(suppliers(spark, d), knn(spark, d)), 6)


def _katz_sql(rounds: int) -> str:
    steps = [f"r{i} AS MATERIALIZED (SELECT s_suppkey AS node_id, 1.0 + 0.05 * coalesce(s, 0.0) AS score FROM supplier LEFT JOIN (SELECT dst, sum(score) AS s FROM knn JOIN r{i - 1} ON src = node_id GROUP BY 1) q ON s_suppkey = dst)" for i in range(1, rounds + 1)]
    return f"WITH {KNN.replace('knn AS (', 'knn AS MATERIALIZED (')}, r0 AS (SELECT s_suppkey AS node_id, CAST(1.0 AS DOUBLE) AS score FROM supplier), {', '.join(steps)} SELECT node_id, round(score, 6) AS score FROM r{rounds}"


@query(_katz_sql(20))
def katz(spark, d):
    return rounded(analytics.katz(suppliers(spark, d), knn(spark, d)), 6)


@query(_katz_sql(20))
def katz_20(spark, d):
    return rounded(analytics.katz(suppliers(spark, d), knn(spark, d)), 6)


def _eigen_sql(rounds: int) -> str:
    steps = [f"w{i} AS MATERIALIZED (SELECT r.node_id, r.score + coalesce(s, 0.0) AS score FROM r{i - 1} r LEFT JOIN (SELECT dst, sum(score) AS s FROM knn JOIN r{i - 1} ON src = node_id GROUP BY 1) q ON r.node_id = dst), r{i} AS MATERIALIZED (SELECT node_id, score / (SELECT sqrt(sum(score * score)) FROM w{i}) AS score FROM w{i})" for i in range(1, rounds + 1)]
    return f"WITH {KNN.replace('knn AS (', 'knn AS MATERIALIZED (')}, r0 AS (SELECT s_suppkey AS node_id, CAST(1.0 AS DOUBLE) AS score FROM supplier), {', '.join(steps)} SELECT node_id, round(score, 6) AS score FROM r{rounds}"


@query(_eigen_sql(20))
def eigenvector(spark, d):
    return rounded(analytics.eigenvector(suppliers(spark, d), knn(spark, d)), 6)


#: Numbers of walks by length from every node; the shortest are the paths.
_WALKS = f"""{KNN}, w AS (SELECT s_suppkey AS s, s_suppkey AS t, 0 AS d, CAST(1.0 AS DOUBLE) AS n FROM supplier UNION ALL SELECT s, dst, d + 1, sum(n) FROM w JOIN knn ON t = src WHERE d < 60 GROUP BY 1, 2, 3),
p AS MATERIALIZED (SELECT s, t, min(d) AS d, arg_min(n, d) AS n FROM w GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_WALKS}, c AS (SELECT s, count(*) AS r, sum(d) AS t FROM p WHERE d > 0 GROUP BY 1), n AS (SELECT greatest(count(*) - 1, 1) AS n FROM supplier) SELECT s_suppkey AS node_id, round(coalesce(CAST(r AS DOUBLE) / t * r / n, 0.0), 6) AS closeness FROM supplier LEFT JOIN c ON s_suppkey = s, n")
def closeness(spark, d):
    return rounded(reach.closeness(suppliers(spark, d), knn(spark, d)), 6)


@query(f"WITH RECURSIVE {_WALKS}, b AS (SELECT a.t AS v, sum(a.n * b.n / c.n) AS x FROM p a JOIN p b ON a.t = b.s JOIN p c ON c.s = a.s AND c.t = b.t WHERE a.d > 0 AND b.d > 0 AND a.d + b.d = c.d GROUP BY 1) SELECT s_suppkey AS node_id, round(coalesce(x, 0.0), 4) AS betweenness FROM supplier LEFT JOIN b ON s_suppkey = v")
def betweenness(spark, d):
    return rounded(reach.betweenness(suppliers(spark, d), knn(spark, d)), 4)


@query(f"WITH {KNN}, e AS (SELECT src, dst, 1.0 AS w FROM knn UNION ALL SELECT dst, src, 1.0 FROM knn WHERE src <> dst), p AS (SELECT src % 4 AS c, sum(w) AS k, sum(CASE WHEN src % 4 = dst % 4 THEN w ELSE 0.0 END) AS i FROM e GROUP BY 1), t AS (SELECT sum(k) AS m2 FROM p) SELECT round(sum(CAST(i AS DOUBLE) / m2 - (CAST(k AS DOUBLE) / m2) * (CAST(k AS DOUBLE) / m2)), 6) AS modularity FROM p, t")
def modularity(spark, d):
    part = suppliers(spark, d).select("node_id", (F.col("node_id") % 4).alias("community"))
    return rounded(analytics.modularity(analytics.undirected_weights(knn(spark, d)), part), 6)


@query(f"WITH {KNN}, e AS (SELECT src, dst FROM knn UNION ALL SELECT dst, src FROM knn WHERE src <> dst) SELECT src % 4 AS src, dst % 4 AS dst, CAST(count(*) AS DOUBLE) AS w FROM e GROUP BY 1, 2")
def coarsen(spark, d):
    part = suppliers(spark, d).select("node_id", (F.col("node_id") % 4).alias("community"))
    return analytics.coarsen(analytics.undirected_weights(knn(spark, d)), part)


@query(f"WITH {POINTS}, b AS (SELECT community, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY 1) SELECT a.community, b.community AS other, round(least(a.x1 - b.x0, b.x1 - a.x0, a.y1 - b.y0, b.y1 - a.y0), 4) AS depth FROM b a JOIN b ON a.community <> b.community WHERE least(a.x1 - b.x0, b.x1 - a.x0, a.y1 - b.y0, b.y1 - a.y0) > 1e-9")
def boundary_overlaps(spark, d):
    """How deep the boxes of communities lie in each other."""
    box = points(spark, d).groupBy("community").agg(*[f(c).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.max, "x", "x1"), (F.min, "y", "y0"), (F.max, "y", "y1"))])
    corner = lambda k, x, y: F.struct(F.lit(k).alias("ord"), F.col(x).alias("x"), F.col(y).alias("y"))
    hulls = box.select("community", F.explode(F.array(corner(0, "x0", "y0"), corner(1, "x1", "y0"), corner(2, "x1", "y1"), corner(3, "x0", "y1"))).alias("c")).select("community", "c.*")
    return rounded(boundaries.overlapping(boundaries.rings(hulls)).select("community", "other", "depth"))


@query()
def louvain(spark, d):
    return analytics.louvain(suppliers(spark, d), knn(spark, d))


@query()
def convex_hulls(spark, d):
    return rounded(analytics.convex_hulls(points(spark, d)))


@query(f"WITH {TRANSITIONS} SELECT src, dst, weight FROM transitions")
def transition_weights(spark, d):
    return transitions(spark, d)


# Forces by density, family and mass

_FIELD = f"""WITH {POINTS}, b AS (SELECT min(x) AS lx, min(y) AS ly, greatest(max(x) - min(x), max(y) - min(y), 1.0) / 128 AS side FROM points),
o AS (SELECT node_id, CAST(least(floor((x - lx) / side), 127) AS BIGINT) AS cx, CAST(least(floor((y - ly) / side), 127) AS BIGINT) AS cy FROM points, b), st AS (SELECT CAST(range AS BIGINT) AS a FROM range(-3, 4)),
g AS (SELECT cx + p.a AS cx, cy + q.a AS cy, sum(exp(-2.0 * (p.a * p.a + q.a * q.a) / 9.0)) AS density FROM o, st p, st q WHERE p.a * p.a + q.a * q.a <= 9 GROUP BY 1, 2),
f AS (SELECT * FROM g WHERE cx BETWEEN 0 AND 127 AND cy BETWEEN 0 AND 127)
SELECT node_id, round(-25.0 * (coalesce(e.density, 0) - coalesce(w.density, 0)), 4) + 0.0 AS fx, round(-25.0 * (coalesce(n.density, 0) - coalesce(s.density, 0)), 4) + 0.0 AS fy FROM o
LEFT JOIN f e ON e.cx = o.cx + 1 AND e.cy = o.cy LEFT JOIN f w ON w.cx = o.cx - 1 AND w.cy = o.cy LEFT JOIN f n ON n.cx = o.cx AND n.cy = o.cy + 1 LEFT JOIN f s ON s.cx = o.cx AND s.cy = o.cy - 1"""


@query(_FIELD)
def force_density(spark, d):
    return rounded(forces.density_repulsion(points(spark, d)))


def _masses(spark, d, edges: DataFrame | None = None) -> DataFrame:
    return _bodies(spark, d, edges).withColumn("mass", F.col("degree").cast("double"))


@query(f"{_PAIR}, q AS (SELECT *, sqrt(x * x + y * y) AS d FROM p) SELECT node_id, round(-0.5 / sqrt(greatest(degree, 1.0)) * sqrt(d) * x / d, 4) + 0.0 AS fx, round(-0.5 / sqrt(greatest(degree, 1.0)) * sqrt(d) * y / d, 4) + 0.0 AS fy FROM q WHERE d > 1e-4")
def force_gravity_mass(spark, d):
    return rounded(relativity.mass_gravity(_masses(spark, d), 0.5))


_KIN = f"{_PAIR}, k AS (SELECT DISTINCT src, dst FROM knn WHERE src <> dst)"


@query(f"""{_KIN}, r AS (SELECT a.dst AS node_id, u.x - v.x AS dx, u.y - v.y AS dy, u.x - c.x AS rx, u.y - c.y AS ry, greatest(u.degree, 1.0) * greatest(v.degree, 1.0) AS m FROM k a JOIN k b ON a.src = b.src AND a.dst <> b.dst JOIN p u ON u.node_id = a.dst JOIN p v ON v.node_id = b.dst JOIN p c ON c.node_id = a.src),
f AS (SELECT *, 50.0 * m / greatest(sqrt(dx * dx + dy * dy), 0.01) / greatest(sqrt(dx * dx + dy * dy), 0.01) AS q, rx * rx + ry * ry AS r2 FROM r), t AS (SELECT *, CASE WHEN r2 > 1e-8 THEN q * (dx * rx + dy * ry) / r2 ELSE 0 END AS al FROM f)
SELECT node_id, round(sum(CASE WHEN r2 > 1e-8 THEN al * rx + 2.0 * (q * dx - al * rx) ELSE q * dx END), 2) + 0.0 AS fx, round(sum(CASE WHEN r2 > 1e-8 THEN al * ry + 2.0 * (q * dy - al * ry) ELSE q * dy END), 2) + 0.0 AS fy FROM t GROUP BY 1""")
def force_sibling(spark, d):
    e = knn(spark, d)
    return rounded(relativity.siblings(_masses(spark, d, e), e), 2)


@query(f"{_KIN}, n AS (SELECT src, count(*) AS n FROM k GROUP BY 1), r AS (SELECT k.dst AS node_id, c.x - u.x AS dx, c.y - u.y AS dy, n FROM k JOIN n ON k.src = n.src JOIN p u ON u.node_id = k.dst JOIN p c ON c.node_id = k.src), q AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM r) SELECT node_id, round(sum((d - 25.0 * sqrt(n)) / d * dx), 4) + 0.0 AS fx, round(sum((d - 25.0 * sqrt(n)) / d * dy), 4) + 0.0 AS fy FROM q WHERE d > 1e-4 GROUP BY 1")
def force_orbit(spark, d):
    e = knn(spark, d)
    return rounded(relativity.orbit(_bodies(spark, d, e), e))


@query(f"{_KIN} SELECT a.src AS node_id, round(sum(7.5 * greatest(u.degree, 1.0) * greatest(v.degree, 1.0) * (u.x - v.x) / ((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y))), 2) + 0.0 AS fx, round(sum(7.5 * greatest(u.degree, 1.0) * greatest(v.degree, 1.0) * (u.y - v.y) / ((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y))), 2) + 0.0 AS fy FROM k a JOIN p u ON u.node_id = a.src JOIN p v ON v.node_id = a.dst GROUP BY 1")
def force_children(spark, d):
    e = knn(spark, d)
    return rounded(relativity.children(_masses(spark, d, e), e), 2)


@query()
def force_cousins(spark, d):
    e = knn(spark, d)
    return rounded(relativity.cousins(_masses(spark, d, e), e), 2)


@query()
def force_barnes_hut(spark, d):
    """Tree forces between all points."""
    return rounded(forces.far_repulsion(points(spark, d)))


# Visibility, boxes, labels


@query(f"WITH {KNN} SELECT src, dst, weight FROM knn WHERE src % 4 <> 0 AND dst % 4 <> 0")
def hide_nodes(spark, d):
    g = model.Graph(suppliers(spark, d), knn(spark, d))
    return structure.visible_graph(g.with_(nodes=structure.set_visible(g.nodes, g.nodes.where("node_id % 4 = 0"), False))).edges.select("src", "dst", "weight")


@query(f"WITH {KNN} SELECT (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM knn) AS edges, (SELECT max(s_suppkey) + 1 FROM supplier) AS bound")
def graph_counts(spark, d):
    return structure.counts(suppliers(spark, d), knn(spark, d))


@query(f"WITH {POINTS} SELECT round(min(x), 4) AS min_x, round(min(y), 4) AS min_y, round(max(x), 4) AS max_x, round(max(y), 4) AS max_y FROM points WHERE community = 3")
def bounds_subset(spark, d):
    p = points(spark, d)
    return rounded(structure.bounds_of(p, p.where("community = 3")))


@query(f"WITH {POINTS}, b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM points) SELECT round((x0 + x1) / 2, 4) AS x, round((y0 + y1) / 2, 4) AS y, round(least(100.0, greatest(0.01, least(700.0 / (x1 - x0), 500.0 / (y1 - y0)))), 6) AS scale FROM b")
def fit_view(spark, d):
    box = structure.bounds(points(spark, d)).first()
    view = geometry.Viewport().fit(*box)
    return spark.createDataFrame([(round(view.x, 4), round(view.y, 4), round(view.scale, 6))], "x double, y double, scale double")


def _advances() -> dict[str, float]:
    return {c: 6.0 + i % 5 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#")}


_CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#"


@query(f"WITH c AS (SELECT c_custkey AS node_id, unnest(string_split(c_name, '')) AS ch FROM customer) SELECT node_id, sum(CASE WHEN strpos('{_CHARACTERS}', ch) > 0 THEN 6.0 + (strpos('{_CHARACTERS}', ch) - 1) % 5 ELSE 0.0 END)::DOUBLE AS width FROM c GROUP BY 1")
def text_width(spark, d):
    return style.text_width(table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("text")), _advances(), {})


@query()
def label_exclusion(spark, d):
    p = points(spark, d)
    labels = p.select("node_id", F.concat(F.lit("Node"), F.col("node_id")).alias("text"), F.col("community").cast("double").alias("priority"), "x", "y", F.lit(None).cast("double").alias("min_zoom"), F.lit(None).cast("double").alias("max_zoom"))
    return rounded(style.free_labels(labels, 2.0, (0.0, 0.0, 1600.0, 1200.0), style.text_width(labels, _advances(), {})))


@query("WITH t AS (SELECT c_custkey AS node_id, c_name AS text, CAST(c_nationkey AS DOUBLE) AS priority, 0 AS round FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT s_suppkey, s_name, CAST(s_nationkey AS DOUBLE), 1 FROM supplier) SELECT node_id, text, priority, CAST(round AS INTEGER) AS round FROM t WHERE node_id NOT IN (SELECT n_nationkey FROM nation)")
def label_changes(spark, d):
    """Customers as labels, suppliers added, labels of the nations' numbers removed."""
    label = lambda t, k: table(spark, d, t).select(F.col(f"{k}_custkey" if k == "c" else f"{k}_suppkey").alias("node_id"), F.col(f"{k}_name").alias("text"), F.col(f"{k}_nationkey").cast("double").alias("priority"))
    kept = style.set_labels(label("customer", "c").where("priority != 3"))
    return style.by_priority(style.remove_labels(style.add_labels(kept, label("supplier", "s")), table(spark, d, "nation").select(F.col("n_nationkey").alias("node_id"))))


_LAYERED = f"WITH {POINTS}, l AS (SELECT 'all' AS layer, node_id, x, y FROM points UNION ALL SELECT 'right', node_id, x, y FROM points WHERE x > 0 UNION ALL SELECT 'near', node_id, x, y FROM points WHERE x * x + y * y < 2500)"


def _layered(spark, d) -> DataFrame:
    near = F.col("x") * F.col("x") + F.col("y") * F.col("y") < 2500
    return layers.layer_rows(points(spark, d), {"all": None, "right": F.col("x") > 0, "near": near})


@query(f"{_LAYERED} SELECT layer, node_id FROM l")
def layer_filters(spark, d):
    return _layered(spark, d).select("layer", "node_id")


@query(f"{_LAYERED}, e AS (SELECT node_id AS src, (node_id * 7 + 1) % (SELECT count(*) FROM points) AS dst FROM points) SELECT l.layer, e.src, e.dst FROM e JOIN l ON e.src = l.node_id JOIN l m ON e.dst = m.node_id AND l.layer = m.layer WHERE l.layer <> 'near' OR e.src % 2 = 0")
def layer_edges(spark, d):
    """Edges between points, each in the layers that hold both ends."""
    n = points(spark, d).agg(F.count("*").alias("n"))
    edges = points(spark, d).crossJoin(F.broadcast(n)).select(F.col("node_id").alias("src"), ((F.col("node_id") * 7 + 1) % F.col("n")).alias("dst"))
    return layers.edge_layer_rows(edges, _layered(spark, d), {"all": None, "right": None, "near": F.col("src") % 2 == 0}).select("layer", "src", "dst")


@query(f"WITH {POINTS} SELECT node_id, round(sqrt(greatest(-110 - x, 0.0, x - 110) ** 2 + greatest(-85 - y, 0.0, y - 85) ** 2), 4) + 0.0 AS distance, x BETWEEN -110 AND 110 AND y BETWEEN -85 AND 85 AS inside FROM points")
def box_distance(spark, d):
    """Points against what a screen shows, ten units wider."""
    box, x, y = geometry.Viewport(0.0, 0.0, 4.0).box().expand(10.0), F.col("x"), F.col("y")
    return rounded(points(spark, d).select("node_id", box.distance(x, y).alias("distance"), box.contains(x, y).alias("inside")))


# Value streams, colour maps, statistics


def _streams() -> values.Streams:
    out, ramp = values.Streams(), color.gradient((0.0, 0.0, 0.0, 0.0), (1.0, 0.5, 0.0, 1.0))
    for name, mode, opacity in (("click", "additive", 1.0), ("view", "multiply", 0.5), ("error", "replace", 0.8), ("purchase", "max", 1.0)):
        out.define(values.Stream(name, 10.0, 100.0, tuple(ramp), mode, opacity))
    return out


def _stream_values(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("node_id"), F.col("event_type").alias("stream"), "ts", "event_id", "value")
    return values.latest(rows, ["node_id", "stream"], ["ts", "event_id"]).select("stream", "node_id", "value")


_LATEST = "l AS (SELECT user_id AS node_id, event_type, greatest(0.0, least(1.0, (value - 10) / 90)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) q WHERE r = 1), t AS (SELECT node_id, max(CASE WHEN event_type = 'click' THEN t END) AS t1, max(CASE WHEN event_type = 'view' THEN t END) AS t2, max(CASE WHEN event_type = 'error' THEN t END) AS t3, max(CASE WHEN event_type = 'purchase' THEN t END) AS t4 FROM l WHERE event_type <> 'signup' GROUP BY 1)"


def _fold(k: str) -> str:
    one = f"coalesce(least(1.0, {k} * t1 * t1), 0.0)"
    two = f"CASE WHEN t2 IS NULL THEN {one} ELSE {one} * (1 - 0.5 * t2 + {k} * t2 * 0.5 * t2) END"
    three = f"CASE WHEN t3 IS NULL THEN {two} ELSE ({two}) * (1 - 0.8 * t3) + {k} * t3 * 0.8 * t3 END"
    return f"CASE WHEN t4 IS NULL THEN {three} ELSE greatest({three}, {k} * t4 * t4) END"


@query(f"WITH {_LATEST} SELECT node_id, round({_fold('1.0')}, 6) AS r, round({_fold('0.5')}, 6) AS g, round(greatest(0.0, coalesce(t1, 0), coalesce(0.5 * t2, 0), coalesce(0.8 * t3, 0), coalesce(t4, 0)), 6) AS a FROM t")
def stream_blend_ordered(spark, d):
    return rounded(_streams().blended(_stream_values(spark, d)).drop("b"), 6)


@query("SELECT DISTINCT user_id AS node_id FROM events WHERE event_type IN ('click', 'error')")
def stream_affected(spark, d):
    s = _streams()
    s.change("view", enabled=False)
    s.toggle("purchase")
    return s.affected(_stream_values(spark, d))


@query(f"WITH {_LATEST} SELECT c_custkey AS node_id, round(coalesce(t2, 0.0), 6) AS intensity FROM customer LEFT JOIN t ON c_custkey = t.node_id")
def stream_intensity(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"))
    return rounded(_streams().intensity(nodes, _stream_values(spark, d), "view"), 6)


@query("SELECT event_type, user_id % 10 AS part, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def channel_mean(spark, d):
    return rounded(values.channel(table(spark, d, "events").withColumn("part", F.col("user_id") % 10), ["event_type", "part"], "avg"), 6)


@query("SELECT count(*) AS frames, round(sum(value), 4) AS total, round(max(value), 4) AS most, round(list_sort(list(value))[CAST(floor(0.99 * count(*)) AS BIGINT) + 1], 4) AS slow, round(1000 / avg(value), 6) AS fps_avg FROM events")
def frame_summary(spark, d):
    return rounded(values.frame_summary(table(spark, d, "events"), "value").select("frames", F.round("total", 4).alias("total"), F.round("most", 4).alias("most"), F.round("slow", 4).alias("slow"), "fps_avg"), 6)


_DENSE = _KDE.replace("round(sum(", "(sum(").replace("))), 4) AS density", ")))) AS density")


@query(f"WITH g AS ({_DENSE}), t AS (SELECT cx, cy, greatest(0.0, least(1.0, density / 0.5)) AS t FROM g WHERE density >= 1e-4) SELECT cx, cy, round(t, 6) AS r, round(1 - t, 6) AS g, round(sqrt(t) * 0.7, 6) AS a FROM t")
def colormap(spark, d):
    return rounded(density.colormap(density.kde(points(spark, d), 20.0, 50.0), color.heat_scale("cool"), 0.0, 0.5).drop("b"), 6)


@query("SELECT range AS i, round(CASE WHEN range / 255.0 <= 0.5 THEN 0.969 + (0.392 - 0.969) * range / 127.5 ELSE 0.392 + (0.031 - 0.392) * (range / 127.5 - 1) END, 6) AS r FROM range(256)")
def heat_lut(spark, d):
    return rounded(density.lookup_table(spark, color.heat_scale("blues")).select("i", "r"), 6)


# Communities in place

_CIRCLE = f"""WITH {POINTS}, s AS (SELECT community, count(*) AS members FROM points GROUP BY 1), i AS (SELECT *, CASE WHEN members > 1 THEN 10.0 * sqrt(members / pi()) ELSE 0.0 END AS inner_ FROM s),
a AS (SELECT *, 2 * pi() * (coalesce(sum(members) OVER (ORDER BY community ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + members / 2.0) / sum(members) OVER () AS angle, sum(2 * inner_ + 50.0) OVER () / (2 * pi()) * 1.5 AS big FROM i),
c AS (SELECT community, members, inner_, big * cos(angle) AS cx, big * sin(angle) AS cy FROM a)"""


@query(f"{_CIRCLE} SELECT community, members, round(cx, 4) + 0.0 AS cx, round(cy, 4) + 0.0 AS cy FROM c")
def community_centers(spark, d):
    return rounded(analytics.community_circle(points(spark, d)).drop("inner"))


@query(f"{_CIRCLE}, r AS (SELECT node_id, community, row_number() OVER (PARTITION BY community ORDER BY node_id) - 1 AS i FROM points) SELECT node_id, round(cx + inner_ * 1.5 * sqrt((i + 0.5) / members) * cos(i * (2 * pi() / (1 + sqrt(5)))), 4) + 0.0 AS x, round(cy + inner_ * 1.5 * sqrt((i + 0.5) / members) * sin(i * (2 * pi() / (1 + sqrt(5)))), 4) + 0.0 AS y FROM r JOIN c ON r.community = c.community")
def sunflower(spark, d):
    p = points(spark, d)
    return rounded(analytics.sunflower(p, analytics.community_circle(p)))


@query(f"WITH {POINTS} SELECT community, count(*) AS members FROM points GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def community_top5(spark, d):
    return analytics.community_sizes(points(spark, d), 5)


@query()
def community_layout(spark, d):
    return rounded(analytics.community_layout(points(spark, d)))


@query()
def leiden(spark, d):
    return analytics.louvain(suppliers(spark, d), knn(spark, d), refined=True)


@query()
def concave_hulls(spark, d):
    return rounded(outlines.concave_hulls(points(spark, d)))


@query(f"""WITH {POINTS}, held AS (SELECT DISTINCT community, CAST(floor(x / 12.5) AS BIGINT) AS a, CAST(floor(y / 12.5) AS BIGINT) AS b FROM points WHERE community IS NOT NULL AND isfinite(x) AND isfinite(y)),
near AS (SELECT i.range AS i, j.range AS j FROM range(-2, 3) AS i, range(-2, 3) AS j),
grown AS (SELECT DISTINCT community, a + i AS a, b + j AS b FROM held, near),
cells AS (SELECT community, a + i AS a, b + j AS b FROM grown, near GROUP BY 1, 2, 3 HAVING count(*) = 25),
flat AS (SELECT community, a AS x, b + k.range AS y FROM cells, range(2) AS k), tall AS (SELECT community, a + k.range AS x, b AS y FROM cells, range(2) AS k),
sides AS (SELECT community, count(*) AS n FROM flat GROUP BY community, x, y UNION ALL SELECT community, count(*) FROM tall GROUP BY community, x, y),
met AS (SELECT community, count(*) AS n, sum((i.range + j.range) % 2) AS odd FROM cells, range(2) AS i, range(2) AS j GROUP BY community, a + i.range, b + j.range),
per_met AS (SELECT community, count(*) AS v, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND odd <> 1 THEN 2 ELSE 0 END) AS corners FROM met GROUP BY 1),
per_side AS (SELECT community, count(*) AS e, count(*) FILTER (n = 1) AS rim FROM sides GROUP BY 1),
per_cell AS (SELECT community, count(*) AS f FROM cells GROUP BY 1)
SELECT community, v - e + f AS shapes, CAST(corners AS BIGINT) AS corners, f * 12.5 * 12.5 + 0.0::DOUBLE AS area, rim * 12.5 + 0.0::DOUBLE AS perimeter FROM per_met JOIN per_side USING (community) JOIN per_cell USING (community)""")
def hull_measures(spark, d):
    """Outlines traced with their holes, measured corner by corner: outer rings less holes, corners, area and perimeter. SQL counts the cells, sides and corners instead."""
    found = outlines.measures(outlines.concave_hulls(points(spark, d), holes=True))
    return rounded(found.select("community", (F.col("outer") - F.col("holes")).alias("shapes"), "corners", "area", "perimeter"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
