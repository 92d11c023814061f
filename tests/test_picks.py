"""Segments laid into cells: every place near a segment finds it, at every length and slope."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.geometry import Viewport
from graphloom.operators import spatial


def distance(px, py, x, y, x2, y2):
    dx, dy = x2 - x, y2 - y
    length = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - x) * dx + (py - y) * dy) / length)) if length else 0.0
    return math.hypot(x + t * dx - px, y + t * dy - py)


@pytest.fixture(scope="module")
def drawn():
    rng = random.Random(6)
    places = {i: (rng.uniform(-300, 300), rng.uniform(-300, 300)) for i in range(60)}
    places |= {60: (0.0, 0.0), 61: (0.0, 250.0), 62: (250.0, 0.0), 63: (5000.0, 4000.0), 64: (0.0, 0.0), 65: (1e-3, 40000.0)}
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(60, 61), (60, 62), (60, 63), (60, 64), (60, 65), (61, 61)]
    return places, sorted(set(edges))


def frames(spark, drawn):
    places, edges = drawn
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in places.items()] + [(99, float("nan"), 0.0)], "node_id long, x double, y double")
    return spark.createDataFrame([*edges, (60, 99), (60, 1234)], "src long, dst long"), points


def test_nearest_edges_as_brute_force(spark, drawn):
    places, edges = drawn
    e, points = frames(spark, drawn)
    rng = random.Random(7)
    picks = [(i, rng.uniform(-320, 320), rng.uniform(-320, 320)) for i in range(400)] + [(400, 0.0, 0.0), (401, 2500.0, 2001.0), (402, 0.5, 39999.0), (403, float("nan"), 1.0), (404, None, 1.0), (405, 1e9, 1e9)]
    queries = spark.createDataFrame(picks, "query_id long, x double, y double")
    for radius in (3.0, 25.0):
        want = {}
        for q, x, y in picks:
            if x is None or math.isnan(x):
                continue
            near = [(distance(x, y, *places[a], *places[b]), a, b) for a, b in edges]
            if min(near)[0] < radius:
                want[q] = min(near)
        found = {r.query_id: (r.distance, r.src, r.dst) for r in spatial.nearest_edges(queries, e, points, radius).collect()}
        assert set(found) == set(want) and len(want) > 40
        for q, (d, a, b) in want.items():
            assert found[q][0] == pytest.approx(d, abs=1e-9)
            assert distance(*next((x, y) for i, x, y in picks if i == q), *places[found[q][1]], *places[found[q][2]]) == pytest.approx(d, abs=1e-9)


def test_cells_stay_few(spark, drawn):
    e, points = frames(spark, drawn)
    cells = spatial.crossed_cells(spatial.placed(e, points), 3.0).groupBy("src", "dst").count()
    assert cells.agg(F.max("count")).first()[0] <= 6 * spatial.STEPS


def test_node_or_edge(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 100.0, 0.0)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    at = spark.createDataFrame([(1, 3.0, 1.0), (2, 50.0, 2.0), (3, 50.0, 50.0), (4, 100.0, -4.0)], "query_id long, x double, y double")
    kinds = lambda **o: {r.query_id: r.kind for r in spatial.hits(at, edges, points, 6.0, 5.0, **o).collect()}
    assert kinds() == {1: "node", 2: "edge", 4: "node"}
    assert kinds(nodes_first=False) == {1: "edge", 2: "edge", 4: "edge"}
    screen = spark.createDataFrame([(1, 400.0, 300.0), (2, 500.0, 301.0), (3, 10.0, 10.0)], "query_id long, x double, y double")
    found = {r.query_id: (r.kind, r.distance) for r in spatial.screen_hits(screen, edges, points, Viewport(scale=2.0)).collect()}
    assert found == {1: ("node", 0.0), 2: ("edge", 0.5)}


def test_picks_at_few_places_meet_few_segments(spark):
    """Long segments over a small box of queries: only their parts in the box lie in cells, and a place is looked up once for all its queries."""
    rng = random.Random(8)
    places = {i: (rng.uniform(-4000, 4000), rng.uniform(-4000, 4000)) for i in range(200)}
    edges = sorted({(rng.randrange(200), rng.randrange(200)) for _ in range(300)})
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in places.items()], "node_id long, x double, y double")
    lines = spatial.placed(spark.createDataFrame(edges, "src long, dst long"), points)
    box = spark.createDataFrame([(-50.0, 50.0, -40.0, 60.0)], "low_x double, high_x double, low_y double, high_y double")
    parts = spatial._clipped(lines, box, 3.0)
    assert spatial.crossed_cells(parts, 3.0).count() * 20 < spatial.crossed_cells(lines, 3.0).count()
    spots = [(rng.uniform(-50, 50), rng.uniform(-40, 60)) for _ in range(40)]
    picks = [(i, *spots[i % 40]) for i in range(400)]
    found = {r.query_id: (r.src, r.dst, r.distance) for r in spatial.nearest_edges(spark.createDataFrame(picks, "query_id long, x double, y double"), spark.createDataFrame(edges, "src long, dst long"), points, 30.0).collect()}
    for i, x, y in picks:
        near = min((distance(x, y, *places[a], *places[b]), a, b) for a, b in edges)
        assert found.get(i, (None,))[:2] == near[1:] if near[0] < 30 else i not in found
