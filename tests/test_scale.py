"""Pair laws through the tree against all pairs, loading with faults, and plans without hot keys."""

import math
import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import control, forces, relativity, style
from graphloom.sources import graph as model
from graphloom.streaming import values


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 120), rng.gauss(0, 90), rng.randrange(6), rng.choice([1, 2, 3, None])) for i in range(700)]
    rows += [(700 + i, 40.0, -25.0, 1, 1) for i in range(60)]  # a pile of points at one place
    return spark.createDataFrame(rows, "node_id long, x double, y double, degree long, community long").repartition(3).cache()


@pytest.mark.parametrize("pair", [(forces.degree_repulsion, forces.far_degree_repulsion), (forces.student_repulsion, forces.far_student_repulsion), (forces.community_repulsion, forces.far_community_repulsion)], ids=["degree", "t-fdp", "community"])
def test_laws_through_the_tree(cloud, pair):
    exact, far = ({r.node_id: (r.fx, r.fy) for r in f(cloud).collect()} for f in pair)
    assert set(exact) <= set(far)
    a, b = np.array([exact[i] for i in exact]), np.array([far[i] for i in exact])
    assert np.linalg.norm(a - b) / np.linalg.norm(a) < 0.05


def test_a_pile_is_one_spot(spark):
    """Tens of thousands of points at one place meet as one: no pairs among them."""
    pile = spark.range(30_000).select(F.col("id").alias("node_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    points = pile.union(spark.createDataFrame([(99_999, 10.0, 0.0)], "node_id long, x double, y double"))
    found = forces.far_repulsion(points)
    one = found.where("node_id = 99999").first()
    assert one.fx == pytest.approx(30_000 * 50 / 100) and one.fy == 0
    nodes, spots, levels = forces._tree(points, F.lit(1.0), F.lit(0))
    assert spots.count() == 2 and nodes.count() == 30_001
    assert found.where("node_id < 30000").agg(F.countDistinct("fx")).first()[0] == 1
    dense = spark.createDataFrame([(i, i * 1e-9, 0.0) for i in range(200)] + [(200, 1000.0, 1000.0)], "node_id long, x double, y double")
    nodes, spots, levels = forces._tree(dense, F.lit(1.0), F.lit(0))
    assert levels == forces.DEEPEST and spots.count() == 2  # closer than the deepest cell: one spot


def test_relativity_is_the_sum_of_its_forces(spark):
    rng = random.Random(2)
    points = spark.createDataFrame([(i, rng.uniform(-50, 50), rng.uniform(-50, 50), 0.0, 0.0) for i in range(9)], "node_id long, x double, y double, vx double, vy double")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6), (5, 7), (5, 8)], "src long, dst long")
    heavy = points.join(forces.propagate_mass(points, edges), "node_id")
    place, want = {r.node_id: (r.x, r.y) for r in points.collect()}, {}
    for f in (relativity.orbit(heavy, edges), relativity.siblings(heavy, edges), relativity.children(heavy, edges), relativity.mass_gravity(heavy)):
        for r in f.collect():
            x, y = want.get(r.node_id, (0.0, 0.0))
            want[r.node_id] = (x + r.fx, y + r.fy)
    for a, b in [(r.src, r.dst) for r in edges.collect()]:  # the full distance along each edge
        for i, j in ((a, b), (b, a)):
            want[i] = tuple(w + q - p for w, p, q in zip(want[i], place[i], place[j], strict=True))
    c = forces.Config()
    total = forces._sum(reduce(DataFrame.unionByName, forces.MODELS["relativity"](points, edges, c)))
    for r in total.collect():
        assert (r.fx, r.fy) == pytest.approx(want[r.node_id], rel=1e-6)
    more = relativity.relativity(heavy, edges, with_cousins=True, density=5.0)
    assert len(more) == 7 and forces.layout(points, edges, "relativity", 2).count() == 9


def test_tree_models_run(cloud, spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(0, 60, 2)], "src long, dst long, weight double")
    points = cloud.where("node_id < 80").withColumn("vx", F.lit(0.0)).withColumn("vy", F.lit(0.0))
    for name in ("force-atlas2-tree", "linlog-tree", "t-fdp-tree", "community-tree"):
        found = forces.layout(points, edges, name, 1)
        assert found.where("isnan(x) or isnan(y)").isEmpty() and found.count() == 80


def test_pins_are_a_join(spark):
    points = spark.createDataFrame([(i, float(i), 0.0, 5.0) for i in range(6)], "node_id long, x double, y double, radius double")
    run = control.Simulation(points, spark.createDataFrame([], "src long, dst long, weight double"), "n2")
    for i in (1, 4):
        run.pin(i)
    found = {r.node_id: r.x for r in run.run(1).collect()}
    assert found[1] == 1.0 and found[4] == 4.0 and found[0] != 0.0


def test_load_checks_numbers_and_places(spark):
    nodes = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", None)], "node_id string, type string")
    edges = spark.createDataFrame([("a", "b"), ("c", "a")], "src string, dst string")
    graph, known = model.load(nodes, edges)
    assert dict(map(tuple, known.collect())) == {"a": 0, "b": 1, "c": 2}
    assert sorted((r.src, r.dst, r.weight) for r in graph.edges.collect()) == [(0, 1, 1.0), (2, 0, 1.0)]
    rows = {r.ext_id: r for r in graph.nodes.collect()}
    assert [rows[i].radius for i in "abc"] == [5.0] * 3 and math.hypot(rows["c"].x, rows["c"].y) == pytest.approx(10 * math.sqrt(3) * math.sqrt(2 / 3))
    placed = nodes.withColumn("x", F.lit(1.0)).withColumn("y", F.lit(2.0))
    assert {(r.x, r.y) for r in model.load(placed, edges)[0].nodes.collect()} == {(1.0, 2.0)}
    nothing, _ = model.load(nodes.limit(0), edges.limit(0))
    assert nothing.nodes.count() == nothing.edges.count() == 0


def test_load_tells_faults(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "node_id string")
    edges = spark.createDataFrame([("a", "z"), (None, "b"), ("a", "b"), ("q", None)], "src string, dst string")
    found = sorted((r.kind, r.id, r.n) for r in model.faults(nodes, edges).collect())
    assert found == [("dst is no node", "z", 1), ("edge without dst", None, 1), ("edge without src", None, 1), ("id repeats", "a", 2), ("node without id", None, 1), ("src is no node", "q", 1)]
    assert [r.kind for r in model.faults(nodes.withColumnRenamed("node_id", "id"), edges.drop("src")).collect()] == ["nodes has no node_id", "edges has no src"]
    clean = nodes.where("node_id is not null")
    with pytest.raises(model.GraphError) as told:
        model.load(clean, edges)
    assert told.value.code == 1003 and told.value.rows.count() == 5
    with pytest.raises(model.GraphError) as told:
        model.load(clean, edges, strict=False)
    assert told.value.code == 1002
    with pytest.raises(model.GraphError):
        model.load(nodes, edges, "first", strict=False)
    graph, known = model.load(clean, edges, "first", strict=False)
    assert known.count() == 2 and [(r.src, r.dst) for r in graph.edges.collect()] == [(0, 1)]


def test_no_window_over_a_key(spark):
    rows = spark.createDataFrame([(1, 5, {"k": "late"}), (1, 2, {"k": "first"}), (2, None, None), (1, 2, {"k": "first"})], "key long, ord long, tags map<string,string>")
    kept = model.keep_first(rows, ["key"], "ord")
    assert kept.columns == rows.columns and sorted((r.key, r.ord, (r.tags or {}).get("k")) for r in kept.collect()) == [(1, 2, "first"), (2, None, None)]
    assert "Window" not in kept._jdf.queryExecution().toString()


def test_ranks_by_histograms(spark):
    rng = random.Random(1)
    drawn = [rng.gauss(0, 1) for _ in range(300)] + [0.5] * 40 + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in [*drawn, None]], "v double")
    for rank in (0, 1, 17, 170, 330, len(drawn) - 1):
        assert values.of_rank(df, "v", rank, bins=7) == sorted(drawn)[rank]
    assert "percentile" not in values.frame_summary(df, "v")._jdf.queryExecution().toString()
    empty = values.frame_summary(df.limit(0), "v").first()
    assert empty.frames == 0 and empty.slow is None


def test_text_width_in_the_jvm(spark):
    rows = spark.createDataFrame([(1, "abba"), (2, ""), (3, None), (4, "éz"), (5, "a")], "node_id long, text string")
    found = style.text_width(rows, {"a": 2.0, "b": 3.0, "é": 1.5}, {("a", "b"): -0.5, ("b", "a"): 0.25})
    assert {r.node_id: r.width for r in found.collect()} == {1: 9.75, 2: 0.0, 3: 0.0, 4: 1.5, 5: 2.0}
    assert "Python" not in found._jdf.queryExecution().toString()
    assert {r.width for r in style.text_width(rows, {}, {}).collect()} == {0.0}


def test_tree_forces_over_blocks(spark, monkeypatch):
    """Blocks of any height give the same forces, and no row is made for a pair of spots."""
    rng = random.Random(9)
    rows = [(i, rng.gauss(0, 50) * rng.random() ** 2, rng.gauss(0, 80) * rng.random() ** 2) for i in range(900)]
    points = spark.createDataFrame(rows, "node_id long, x double, y double").repartition(3).cache()
    found = []
    for below in (1, 3, 20):
        monkeypatch.setattr(forces, "BELOW", below)
        pushed = forces.far_repulsion(points)
        found.append(np.array([(r.fx, r.fy) for r in pushed.orderBy("node_id").collect()]))
        assert "FlatMapGroupsInArrow" in pushed._jdf.queryExecution().optimizedPlan().toString()
    assert found[0].shape == (900, 2)
    for other in found[1:]:
        np.testing.assert_allclose(found[0], other, rtol=1e-9, atol=1e-12)
