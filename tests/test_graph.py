"""Graph operators on small fixtures with known answers."""

import math

import numpy as np
import pytest

from graphloom.functions.geometry import Affine, Viewport
from graphloom.operators import analytics, forces, hierarchy, reach, structure
from graphloom.plans import catalogue, testgraphs
from graphloom.sources import graph as model
from graphloom.streaming import values


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src long, dst long")


def nodes_of(spark, n):
    return spark.range(n).withColumnRenamed("id", "node_id")


def test_validate_rejects_and_mends(spark):
    nodes = spark.createDataFrame([(1,), (1,), (2,)], "node_id long")
    g = model.Graph(nodes, edges_of(spark, [(1, 2), (1, 9)]))
    with pytest.raises(model.GraphError):
        model.validate(g)
    with pytest.raises(model.GraphError):
        model.validate(g, on_duplicate="first")
    mended = model.validate(g, on_duplicate="first", strict=False)
    assert mended.nodes.count() == 2 and mended.edges.count() == 1


def test_bounds_of_nothing_are_null(spark):
    empty = spark.createDataFrame([(1, float("nan"), 1.0)], "node_id long, x double, y double")
    assert structure.bounds(empty).first()[0] is None


def test_two_cliques(spark):
    clique = lambda ids: [(a, b) for a in ids for b in ids if a != b]
    edges = edges_of(spark, clique([0, 1, 2]) + clique([3, 4, 5]) + [(2, 3)])
    found = dict(analytics.louvain(nodes_of(spark, 6), edges, passes=4, levels=2).collect())
    assert len({found[i] for i in (0, 1, 2)}) == 1 and len({found[i] for i in (3, 4, 5)}) == 1 and found[0] != found[5]


def test_components(spark):
    edges = edges_of(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (4, 5)])
    assert dict(analytics.weak_components(nodes_of(spark, 7), edges).collect()) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6}
    assert dict(reach.strong_components(nodes_of(spark, 7), edges).collect()) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}


def test_whole_jobs_against_brute_force(spark, sf):
    """All orders are edges, and the centralities take 20 rounds."""
    label = {}

    def top(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for (c,) in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect():
        top(c)
    for (c,) in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().collect():
        a, b = sorted((top(c), top(c % 97 + 1000000)))
        label[b] = a
    assert dict(catalogue.QUERIES["weak_components_all"](spark, sf).collect()) == {i: top(i) for i in label}

    nodes = [r[0] for r in testgraphs.suppliers(spark, sf).collect()]
    links = [(r.src, r.dst) for r in testgraphs.knn(spark, sf).collect()]
    at = {n: i for i, n in enumerate(nodes)}
    into = np.zeros((len(nodes), len(nodes)))
    for a, b in links:
        into[at[b], at[a]] += 1
    out = into.sum(0)
    rank, score, katz = np.full(len(nodes), 1 / len(nodes)), np.ones(len(nodes)), np.ones(len(nodes))
    for _ in range(20):
        rank = 0.15 / len(nodes) + 0.85 * (into @ (rank / np.maximum(out, 1)) + rank[out == 0].sum() / len(nodes))
        score = score + into @ score
        score /= np.sqrt((score**2).sum())
        katz = 1 + 0.05 * into @ katz
    for name, want in (("pagerank_20", rank), ("eigenvector", score), ("katz_20", katz)):
        got = dict(catalogue.QUERIES[name](spark, sf).collect())
        assert [got[n] for n in nodes] == pytest.approx(want, abs=2e-6)


def test_betweenness_of_a_chain(spark):
    found = dict(reach.betweenness(nodes_of(spark, 4), edges_of(spark, [(0, 1), (1, 2), (2, 3)])).collect())
    assert found == {0: 0.0, 1: 2.0, 2: 2.0, 3: 0.0}


def test_bubbles(spark):
    tree = hierarchy.spanning(nodes_of(spark, 6), edges_of(spark, [(0, i) for i in range(1, 6)]), 0)
    radii = {r.node_id: r.radius for r in hierarchy.bubble_radii(tree).collect()}
    assert radii[0] == pytest.approx(29.6932, abs=1e-4) and radii[5] == 10.0


def test_large_families_are_pushed_apart(spark):
    """Three passes of all discs at once, against a plain loop; 2100 children are above the size where passes once stopped."""
    sizes = [(i, 0, 1, 1.0 + (i * 7919 % 13) * 0.5) for i in range(1, 2101)] + [(i, 1, 2, 3.0) for i in range(3000, 3005)]
    found = {r.node_id: (r.x, r.y) for r in hierarchy.pack_layout(spark.createDataFrame([(0, None, 0, 50.0), *sizes], "node_id long, parent long, depth int, radius double"), spread=1.0).collect()}
    discs = sorted((-r, i) for i, p, _, r in sizes if p == 0)
    r = np.array([-d[0] for d in discs])
    reach, angle = np.concatenate([[0], np.cumsum(r / np.sqrt(np.arange(len(r)) + 1))[:-1]]), np.arange(len(r)) * math.pi * (3 - math.sqrt(5))
    at = np.stack([reach * np.cos(angle), reach * np.sin(angle)], 1)
    start = at
    for _ in range(3):
        gap = at[:, None] - at[None]
        d = np.maximum(np.hypot(gap[..., 0], gap[..., 1]), 1e-9)
        over = np.tril(np.maximum(r[:, None] + r - d, 0), -1)
        at = at + (gap / d[..., None] * over[..., None]).sum(1)
    assert not np.allclose(at, start)
    assert np.allclose(at, [found[i] for _, i in discs], atol=1e-6) and len(found) == 2106


def test_csr_faults_cross_partitions(spark):
    """A fault is found wherever partitions part, and no window takes all rows or any list."""
    rows = spark.range(40).selectExpr("id AS node_id", "id * 2 + CASE WHEN id = 25 THEN 1 ELSE 0 END AS first", "array(id, id + 1) AS targets")
    found = structure.csr_faults(rows)
    assert sorted(map(tuple, found.collect())) == [(25, 51, 50), (26, 52, 53)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "targets" not in plan and "windowspecdefinition(node_id" not in plan


def test_additive_blend_is_a_sum(spark, sf):
    plan = catalogue.QUERIES["stream_blend_additive"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_cycles_end(spark):
    assert hierarchy.spanning(nodes_of(spark, 3), edges_of(spark, [(0, 1), (1, 2), (2, 0), (1, 1)]), 0).count() == 3


def test_far_repulsion_is_near_the_exact_one(spark):
    rows = [(i, 37.0 * (i % 10) + i * 0.3, 41.0 * (i // 10)) for i in range(60)]
    points = spark.createDataFrame(rows, "node_id long, x double, y double")
    exact = {r.node_id: r for r in forces.repulsion(points).collect()}
    close = {r.node_id: r for r in forces.far_repulsion(points).collect()}
    error = sum(math.hypot(exact[i].fx - close[i].fx, exact[i].fy - close[i].fy) for i in exact)
    assert error < 0.1 * sum(math.hypot(r.fx, r.fy) for r in exact.values())


def test_pinned_nodes_stay(spark):
    points = spark.createDataFrame([(0, 0.0, 1.0, True), (1, 5.0, 0.0, False)], "node_id long, x double, y double, pin boolean")
    moved = {r.node_id: r for r in forces.integrate(points, [forces.repulsion(points)], pinned="pin").collect()}
    assert (moved[0].x, moved[0].y, moved[0].vx) == (0.0, 1.0, 0.0) and moved[1].x > 5.0


def test_affine_round_trip():
    t = Viewport(3.0, 4.0, 2.0).to_screen().then(Affine.rotation(0.3))
    x, y = t.inverse().apply(*t.apply(7.0, -2.0))
    assert (x, y) == (pytest.approx(7.0), pytest.approx(-2.0)) and Affine(0, 0, 0, 0).inverse() is None


def test_json_graph(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a"}, {"id": "b"}, {"id": "a"}], "links": [{"source": "a", "target": "b"}, {"source": "a", "target": "z"}]}')
    g = model.read_json(spark, str(tmp_path / "g.json"))
    assert g.nodes.count() == 2 and [(r.src, r.dst) for r in g.edges.collect()] == [("a", "b")]


def test_stream_upsert(spark, tmp_path):
    source = tmp_path / "in"
    schema = "node_id long, seq long, value double"
    for number, rows in enumerate([[(1, 1, 5.0), (2, 2, 6.0)], [(1, 3, 9.0), (3, 4, 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        values.upsert(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["node_id"], ["seq"]).awaitTermination()
        found = {r.node_id: r.value for r in spark.read.parquet(str(tmp_path / f"out/v{number}")).collect()}
    assert found == {1: 9.0, 2: 6.0, 3: 1.0}


def test_shared_parts_are_counted_once_a_query_and_in_pieces(spark, sf, monkeypatch):
    """A query that takes the supplier graph twice reads the order lines for it once; parts whose suppliers fill several lists give the same pairs."""
    from collections import Counter, defaultdict

    plan = catalogue.QUERIES["add_edges_checked"](spark, sf)._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "l_partkey" not in plan
    parts = defaultdict(set)
    for r in testgraphs.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").collect():
        parts[r[0]].add(r[1])
    shared = Counter((a, b) for some in parts.values() for a in some for b in some if a != b)
    want = set()
    for src in {a for a, _ in shared}:
        best = sorted((-n, b) for (a, b), n in shared.items() if a == src)[:5]
        want |= {(src, b, float(-n)) for n, b in best}
    for listed in (1000, 2):
        monkeypatch.setattr(testgraphs, "LISTED", listed)
        assert {(r.src, r.dst, r.weight) for r in testgraphs.knn(spark, sf).collect()} == want


def test_partners_are_counted_in_pieces(monkeypatch):
    """A supplier's lists that come over many pieces count as if they came at once; ties go to the smaller id."""
    monkeypatch.setattr(testgraphs, "HELD", 3)
    whole = [7, 1, 2, 7, 3, 2, 9, 1, 7, 2, 4]
    one = testgraphs._Partners(7)
    for at in range(0, len(whole), 2):
        one.add(np.array(whole[at : at + 2], np.int64))
    dst, n = one.best(3)
    assert dst.tolist() == [2, 1, 3] and n.tolist() == [3, 2, 1]
    alone = testgraphs._Partners(7)
    alone.add(np.array([7, 7], np.int64))
    assert alone.best(5)[0].tolist() == []
