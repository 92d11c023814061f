"""Layouts, streams and analytics against brute force on small inputs."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import color
from graphloom.operators import analytics, control, density, forces, hierarchy, outlines, placement, reach, relativity, structure, style
from graphloom.sources import generators
from graphloom.streaming import values


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def scattered(spark, n, seed, clusters=6):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 200, (clusters, 2))[rng.integers(0, clusters, n)] + rng.normal(0, 12, (n, 2))
    return at, frame(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "node_id long, x double, y double")


def test_tree_forces_are_near_the_exact_ones(spark):
    at, points = scattered(spark, 400, 1)
    diff = at[:, None] - at[None]
    d = np.sqrt((diff**2).sum(-1)) + np.eye(len(at)) * 1e12
    want = (diff * (50 / np.maximum(d, 1) ** 2 / np.maximum(d, 1) * (d <= 1000))[..., None]).sum(1)
    got = np.array([r[1:] for r in forces.far_repulsion(points).orderBy("node_id").collect()])
    assert np.linalg.norm(got - want) < 0.05 * np.linalg.norm(want)
    exact = np.array([r[1:] for r in forces.far_repulsion(points, forces.Config(theta=0.1)).orderBy("node_id").collect()])
    assert np.linalg.norm(exact - want) < 1e-3 * np.linalg.norm(want)


def test_tree_forces_have_no_nested_loop(spark):
    _, points = scattered(spark, 300, 2)
    plan = forces.far_repulsion(points)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_points_at_one_place_end(spark):
    points = frame(spark, [(i, 1.0, 1.0) for i in range(5)] + [(9, 50.0, 50.0)], "node_id long, x double, y double")
    found = {r.node_id: (r.fx, r.fy) for r in forces.far_repulsion(points).collect()}
    assert found[9][0] > 0 and all(found[i][0] < 0 for i in range(5))


def test_relativity_cousins(spark):
    edges = frame(spark, [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)], "src long, dst long")
    points = frame(spark, [(i, float(i), float(i * i), 1.0) for i in range(6)], "node_id long, x double, y double, mass double")
    found = {r.node_id: (r.fx, r.fy) for r in relativity.cousins(points, edges).collect()}
    assert set(found) == {3, 4, 5}
    dx, dy = 3 - 5, 9 - 25
    d = math.hypot(dx, dy)
    assert found[3] == pytest.approx((25 / d * dx / d, 25 / d * dy / d))
    assert len(relativity.relativity(points, edges, with_cousins=True)) == 6  # their sum is tested in test_scale.py


def test_control():
    alpha = control.Alpha(decay=control.decay_for(300))
    for _ in range(300):
        alpha.tick()
    assert alpha.value <= 0.0011 and control.ticks_for(control.decay_for(300)) in (300, 301)
    alpha.reheat(0.5)
    assert alpha.value == 0.5 and not alpha.cold
    assert [control.EnergyWindow(2).add(e) for e in (0.0,)] == [False]
    still = control.Still()
    assert [still.add(m) for m in (0.1, 5.0, 0.1, 0.1, 0.1)] == [False, False, False, False, True]
    assert control.adapted(0.3, 2.0, 1.0) == 0.4 and control.adapted(0.6, 2.0, 1.0) == 0.6
    assert forces.progressive_damping(0.4, 1.0) == pytest.approx(0.6) and forces.progressive_damping(0.9, 0.0) == 0.05


def test_settings_are_clamped():
    c = forces.clamped({"theta": 9.0, "density_grid": 100, "tfdp_beta": 20.0, "collision_strength": -1.0})
    assert (c.theta, c.density_grid, c.collision_strength) == (2.0, 128, 0.0) and c.tfdp_alpha * (1 + c.tfdp_beta) < 1
    with pytest.raises(ValueError):
        forces.clamped({"no": 1})
    for preset in control.PRESETS.values():
        forces.clamped(preset)
    assert [forces.recommended(n) for n in (10, 9_999, 10**6)] == ["n2", "barnes-hut", "density"]


def test_simulation(spark):
    g = generators.tree_graph(spark, 7, 2)
    points = placement.place(structure.compact(g.nodes), "phyllotaxis", 100.0).select("node_id", "x", "y")
    sim = control.Simulation(points, g.edges, "n2")
    assert not sim.tick()
    sim.start()
    sim.pin(3)
    before = {r.node_id: (r.x, r.y) for r in sim.state.collect()}
    assert sim.tick() and sim.ticks == 1
    after = {r.node_id: (r.x, r.y) for r in sim.state.collect()}
    assert after[3] == before[3] and after[0] != before[0]
    sim.pause()
    assert not sim.tick()
    sim.stop()
    assert sim.alpha.value == 0.0


def test_labels_as_the_greedy_does(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(1, 12), float(rng.randint(0, 5)), rng.uniform(-300, 300), rng.uniform(-200, 200), None, None) for i in range(150)]
    labels = frame(spark, rows, "node_id long, text string, priority double, x double, y double, min_zoom double, max_zoom double")
    widths = style.text_width(labels, {"x": 7.0}, {})
    got = [r.node_id for r in style.free_labels(labels, 1.5, (0.0, 0.0, 800.0, 500.0), widths, most=30).collect()]
    taken, want = set(), []
    for i, text, _, x, y, *_ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if abs(x) > 800 / 3 or abs(y) > 500 / 3 or len(want) == 30:
            continue
        w, left, top = 7.0 * len(text), x * 1.5 + 400 - 3.5 * len(text), y * 1.5 + 260
        cells = {(a, b) for a in range(math.floor((left - 4) / 50), math.floor((left + w + 4) / 50) + 1) for b in range(math.floor((top - 4) / 50), math.floor((top + 16.8 + 4) / 50) + 1)}
        if not cells & taken:
            taken |= cells
            want.append(i)
    assert got == want and 0 < len(want)


def test_contours_pass_the_threshold(spark):
    cells = {(x, y): math.exp(-((x - 3) ** 2 + (y - 4) ** 2) / 6) for x in range(9) for y in range(9)}
    grid = frame(spark, [(x, y, v) for (x, y), v in cells.items()], "cx long, cy long, density double")
    got = density.marching_squares(grid, [0.5]).collect()
    ends = [p for r in got for p in ((round(r.x1, 6), round(r.y1, 6)), (round(r.x2, 6), round(r.y2, 6)))]
    assert got and all(ends.count(p) == 2 for p in ends)  # one closed line
    for x, y in ends:
        a, b = (math.floor(x - 0.5), math.floor(y - 0.5)), (math.ceil(x - 0.5 - 1e-9), math.ceil(y - 0.5 - 1e-9))
        t = (x - 0.5 - a[0]) + (y - 0.5 - a[1])
        assert cells[a] + (cells[b] - cells[a]) * t == pytest.approx(0.5, abs=1e-5)


def test_metaball_and_its_kinds(spark):
    points = frame(spark, [(1, 0.0, 0.0), (2, 12.0, 0.0)], "node_id long, x double, y double")
    field = {(r.cx, r.cy): r.field for r in density.metaball(points, 4.0, 8.0, 10.0).collect()}

    def smin(a, b):
        h = max(0.0, min(1.0, 0.5 + 0.5 * (b - a) / 10.0))
        return b * (1 - h) + a * h - 10.0 * h * (1 - h)

    for (cx, cy), v in field.items():
        x, y = (cx + 0.5) * 4, (cy + 0.5) * 4
        near = [d for d in (math.hypot(x, y) - 8, math.hypot(x - 12, y) - 8) if d <= 10]
        assert v == pytest.approx(near[0] if len(near) == 1 else smin(*near))
    shown = density.classify(spark.createDataFrame([(0, 0, -9.0), (1, 0, 1.0), (2, 0, 5.0)], "cx long, cy long, field double")).collect()
    assert [(r.kind, r.alpha) for r in sorted(shown)] == [("inside", 1.0), ("rim", 0.15)]


def test_streams_are_managed(spark):
    s = values.Streams()
    s.define(values.Stream("a"))
    with pytest.raises(ValueError):
        s.define(values.Stream("a"))
    with pytest.raises(ValueError):
        values.Stream("b", mode="no")
    s.define(values.Stream("b", mode="replace", stops=tuple(color.gradient((1, 0, 0, 1), (1, 0, 0, 1)))))
    v = frame(spark, [("a", 1, 0.0), ("b", 2, 0.5)], "stream string, node_id long, value double")
    assert {(r.stream, r.n) for r in s.info(v).collect()} == {("a", 1), ("b", 1)}
    nodes = frame(spark, [(i, 0.2, 0.2, 0.2, 1.0) for i in (1, 2, 3)], "node_id long, r double, g double, b double, a double")
    assert {r.node_id: r.r for r in s.applied(nodes, v).collect()}[2] == 1.0
    s.toggle("b")
    assert {r.node_id: r.r for r in s.applied(nodes, v).collect()}[2] == 0.2
    s.remove("b")
    assert not s.has("b") and s.affected(v).count() == 1


def _reach(edges, n):
    out = {i: set() for i in range(n)}
    for a, b in edges:
        out[a].add(b)
    dist = {}
    for s in range(n):
        seen, front = {s: 0}, [s]
        while front:
            front = [b for a in front for b in out[a] if b not in seen and not seen.update({b: seen[a] + 1})]
        dist[s] = seen
    return dist


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(8)
    edges = sorted({(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(22)) if a != b} | {(10, 11), (11, 12), (12, 13)})
    return edges, spark.range(14).withColumnRenamed("id", "node_id"), frame(spark, edges, "src long, dst long")


def test_strong_components(small):
    edges, nodes, e = small
    d = _reach(edges, 14)
    want = {i: min(j for j in range(14) if j in d[i] and i in d[j]) for i in range(14)}
    assert {r.node_id: r.component for r in reach.strong_components(nodes, e).collect()} == want


def test_closeness_and_betweenness(small):
    edges, nodes, e = small
    d = _reach(edges, 14)
    for r in reach.closeness(nodes, e).collect():
        far = [v for k, v in d[r.node_id].items() if k != r.node_id]
        assert r.closeness == pytest.approx(len(far) / sum(far) * len(far) / 13 if far else 0.0)
    out = {i: [b for a, b in edges if a == i] for i in range(14)}

    def paths(a, b):
        return [[a]] if a == b else [[a, *p] for c in out[a] if b in d[c] and d[c][b] == d[a][b] - 1 for p in paths(c, b)]

    want = dict.fromkeys(range(14), 0.0)
    for a, b in itertools.permutations(range(14), 2):
        if b in d[a]:
            found = paths(a, b)
            for p in found:
                for v in p[1:-1]:
                    want[v] += 1 / len(found)
    for r in reach.betweenness(nodes, e).collect():
        assert r.betweenness == pytest.approx(want[r.node_id])


def test_pagerank_settles(small):
    edges, nodes, e = small
    got = {r.node_id: r.rank for r in analytics.pagerank(nodes, e, iterations=100, tolerance=1e-3).collect()}
    rank, out = np.full(14, 1 / 14), Counter(a for a, _ in edges)
    for _ in range(200):
        new = np.full(14, 0.15 / 14 + 0.85 * sum(rank[i] for i in range(14) if not out[i]) / 14)
        for a, b in edges:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    assert sum(got.values()) == pytest.approx(1.0) and all(got[i] == pytest.approx(rank[i], abs=2e-3) for i in range(14))


@pytest.mark.parametrize("refined", [False, True])
def test_planted_communities_are_found(spark, refined):
    rows = {(a, b) for c in range(3) for a in range(c * 6, c * 6 + 6) for b in range(a + 1, c * 6 + 6)} | {(0, 6), (6, 12), (12, 0)}
    edges = frame(spark, sorted(rows), "src long, dst long")
    found = {r.node_id: r.community for r in analytics.louvain(spark.range(18).withColumnRenamed("id", "node_id"), edges, refined=refined).collect()}
    assert found == {i: i // 6 * 6 for i in range(18)}


def test_hulls(spark):
    rng = np.random.default_rng(5)
    at = rng.uniform(0, 100, (120, 2))
    at = at[~((at[:, 0] > 30) & (at[:, 0] < 70) & (at[:, 1] > 25))]  # a U
    points = frame(spark, [(i, 1, float(x), float(y)) for i, (x, y) in enumerate(at)], "node_id long, community long, x double, y double")
    area = lambda ring: 0.5 * abs(sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:] + ring[:1], strict=True)))
    convex = analytics.convex_hulls(points).orderBy("ord").collect()
    for a, b in zip(convex, convex[1:] + convex[:1], strict=True):
        assert all((b.x - a.x) * (y - a.y) - (b.y - a.y) * (x - a.x) >= -1e-9 for x, y in at)
    concave = outlines.concave_hulls(points, 25.0).orderBy("ord").collect()
    assert len(concave) > len(convex) and area(concave) < 0.9 * area(convex)
    assert len({(r.ring_x, r.ring_y) for r in concave}) == 1 and not any(r.hole for r in concave)
    pair = frame(spark, [(1, 7, 0.0, 0.0), (2, 7, 10.0, 0.0), (3, 8, 12.0, 0.0)], "node_id long, community long, x double, y double")
    shapes = analytics.hull_shapes(analytics.convex_hulls(pair), pair)
    moves = {r.community: (r.dx, r.dy) for r in analytics.hulls_apart(shapes).collect()}
    assert moves[7][0] == -moves[8][0] < 0


def test_community_layout_is_bounded(spark):
    n = frame(spark, [(i, i % 7) for i in range(700)], "node_id long, community long")
    far = analytics.community_layout(n).agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)), F.count("*")).first()
    assert far[0] <= 10 * math.sqrt(700) * 1.5 + 1e-6 and far[1] == 700


def test_generators_agree_with_themselves(spark):
    for make in (lambda: generators.random_graph(spark, 50, 80), lambda: generators.social_graph(spark, 60), lambda: generators.spiral_graph(spark, 30), lambda: generators.contour_points(spark, 40), lambda: generators.random_tree(spark, 40, across=0.2), lambda: generators.large_graph(spark, 100)):
        one, two = make(), make()
        assert sorted(map(tuple, one.nodes.collect())) == sorted(map(tuple, two.nodes.repartition(5).collect()))
        assert sorted(map(tuple, one.edges.collect())) == sorted(map(tuple, two.edges.collect()))
    tree = generators.random_tree(spark, 40)
    assert tree.edges.count() == 39 and hierarchy.spanning(tree.nodes, tree.edges, 0).count() == 40
