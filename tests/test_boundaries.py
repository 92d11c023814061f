"""Overlaps of convex rings against brute force, and frames that part them."""

import math
import random

import pytest

from graphloom.operators import boundaries
from graphloom.operators.boundaries import Boundaries, Physics

HULL = "community long, ord int, x double, y double"


def ngon(c, x, y, r, n, turn=0.0):
    return [(c, k, x + r * math.cos(turn + 2 * math.pi * k / n), y + r * math.sin(turn + 2 * math.pi * k / n)) for k in range(n)]


def corners(rows):
    out = {}
    for c, k, x, y in sorted(rows):
        out.setdefault(c, []).append((x, y))
    return out


def way_out(a, b):
    """The least way that parts two convex rings, over the normals of all sides; 0 or less if they are apart."""
    best = math.inf
    for ring in (a, b):
        for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1], strict=True):
            nx, ny = (v - y), (x - u)
            size = math.hypot(nx, ny)
            s, t = ([(p * nx + q * ny) / size for p, q in r] for r in (a, b))
            best = min(best, max(s) - min(t), max(t) - min(s))
    return best


def crowd(seed, n=14):
    rng = random.Random(seed)
    return [p for c in range(n) for p in ngon(c, rng.uniform(-60, 60), rng.uniform(-60, 60), rng.choice([3, 12, 30]), rng.randrange(3, 9), rng.random())]


def test_overlaps_as_brute_force(spark):
    rows = crowd(1) + ngon(50, 500, 500, 10, 4) + ngon(51, 500, 500, 2, 4) + ngon(60, 900, 0, 5, 4) + ngon(61, 900, 0, 5, 4) + ngon(70, 0, 900, math.sqrt(2), 4, math.pi / 4) + ngon(71, 2, 900, math.sqrt(2), 4, math.pi / 4)
    ring = corners(rows)
    want = {(a, b): way_out(ring[a], ring[b]) for a in ring for b in ring if a != b and way_out(ring[a], ring[b]) > 1e-9}
    found = {(r.community, r.other): r for r in boundaries.overlapping(boundaries.rings(spark.createDataFrame(rows, HULL))).collect()}
    assert {k: r.depth for k, r in found.items()} == pytest.approx(want) and len(want) > 20
    assert (50, 51) in found and (60, 61) in found and (70, 71) not in found  # inside, equal, only touching
    for (a, b), r in found.items():
        back = found[b, a]
        assert (r.ux, r.uy) == (-back.ux, -back.uy) and math.hypot(r.ux, r.uy) == pytest.approx(1)
        moved = [(x + (r.depth + 1e-6) * r.ux, y + (r.depth + 1e-6) * r.uy) for x, y in ring[a]]
        assert way_out(moved, ring[b]) <= 1e-9  # this way parts them


def test_frames_part_all(spark):
    rows = crowd(2, 8)
    run = Boundaries(spark.createDataFrame(rows, HULL), Physics(strength=1.0))
    for _ in range(3):
        moves = run.update().collect()
        assert moves and all(math.hypot(r.mx, r.my) <= 10 + 1e-9 for r in moves)
    assert run.has_overlaps and run.iteration == 3
    assert run.settle(60) < 60 and not run.has_overlaps
    ring = {r.community: [(p.x, p.y) for p in r.ring] for r in run.shapes().collect()}
    assert all(way_out(ring[a], ring[b]) <= 1e-6 for a in ring for b in ring if a < b)
    points = spark.createDataFrame([(i, i % 9) for i in range(30)], "node_id long, community long")
    offsets = {r.community: (r.dx, r.dy) for r in run.state.collect()}
    moves = {r.node_id: (r.dx, r.dy) for r in run.node_moves(points).collect()}
    assert moves == {i: offsets[i % 9] for i in range(30) if i % 9 in offsets and offsets[i % 9] != (0.0, 0.0)}


def test_switches_and_few(spark):
    two = spark.createDataFrame(ngon(1, 0, 0, 10, 4) + ngon(2, 5, 0, 10, 4), HULL)
    off = Boundaries(two, Physics(enabled=False))
    assert off.update().count() == 0 and off.iteration == 1
    off.configure(enabled=True, strength=9.0, most=1.0)
    assert off.physics.strength == 1.0 and off.update().count() == 2
    one = Boundaries(spark.createDataFrame(ngon(1, 0, 0, 10, 4), HULL))
    assert one.settle() == 0
    none = Boundaries(spark.createDataFrame([], HULL))
    assert none.settle() == 0
    thin = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 3.0, 0.0), (2, 1, 5.0, 0.0)], HULL)
    sizes = {r.community: len(r.ring) for r in boundaries.rings(thin).collect()}
    assert sizes == {1: 8, 2: 8} and Boundaries(thin).update().count() == 2
