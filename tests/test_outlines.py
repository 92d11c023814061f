"""Outlines traced in parts, against a walk over the whole grid."""

import random

import pytest

from graphloom.operators import outlines
from graphloom.plans import catalogue

STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


def walked(cells):
    """The rings of one community's cells as sets of (ring, corners from the least one)."""
    sides = set()
    for a, b in cells:
        for x, y, d, other in ((a, b, 0, (a, b - 1)), (a + 1, b, 1, (a + 1, b)), (a + 1, b + 1, 2, (a, b + 1)), (a, b + 1, 3, (a - 1, b))):
            if other not in cells:
                sides.add((x, y, d))
    found = set()
    while sides:
        start = at = min(sides)
        corners = []
        while True:
            sides.discard(at)
            x, y, d = at
            x, y = x + STEPS[d][0], y + STEPS[d][1]
            # the last side may be the start again, which is no longer among the open ones
            to = next(e for e in [(x, y, (d - 1) % 4), (x, y, d), (x, y, (d + 1) % 4)] if e in sides or e == start)
            if to[2] != d:
                corners.append((x, y))
            if to == start:
                break
            at = to
        found.add((start[2] == 1, rotated(corners)))
    return found


def rotated(corners):
    i = min(range(len(corners)), key=lambda k: (corners[k], corners[(k + 1) % len(corners)]))
    return tuple(corners[i:] + corners[:i])


def traced(rows):
    rings = {}
    for r in rows:
        rings.setdefault((r.community, r.ring_x, r.ring_y), []).append(r)
    out = {}
    for (community, x, y), corners in rings.items():
        corners.sort(key=lambda r: r.ord)
        assert [r.ord for r in corners] == list(range(len(corners)))
        assert min((r.x, r.y) for r in corners) == (x, y) and len({r.hole for r in corners}) == 1
        out.setdefault(community, set()).add((corners[0].hole, rotated([(r.x, r.y) for r in corners])))
    return out


@pytest.mark.parametrize("part", [2, 5, 128])
def test_rings_as_walked(spark, part):
    rng = random.Random(part)
    cells = {k: {(rng.randrange(-9, 9), rng.randrange(-9, 9)) for _ in range(n)} for k, n in ((1, 1), (2, 60), (3, 180), (4, 400))}
    cells[5] = {(a, b) for a in range(12) for b in range(12) if (a + b) % 2}  # corners only
    cells[6] = {(a, 0) for a in range(40)} | {(a, 2) for a in range(40)} | {(0, 1), (39, 1)}  # one long hole
    df = spark.createDataFrame([(k, a, b) for k, at in cells.items() for a, b in at], "community long, a long, b long")
    found = traced(outlines.rings(df, part).collect())
    assert found == {k: walked(at) for k, at in cells.items()}


def test_hulls_close_gaps_and_hold_all_members(spark):
    rng = random.Random(4)
    at = [(rng.uniform(-80, 80), rng.uniform(-80, 80)) for _ in range(300)]
    rows = [(1, x, y, "c") for x, y in at] + [(1, 500.0, 500.0, "c")] * 3 + [(None, 0.0, 0.0, None), (1, float("nan"), 0.0, None), (1, 0.0, None, None), (1, float("inf"), 1.0, None)]
    points = spark.createDataFrame(rows, "community long, x double, y double, hole string")
    rings = {}
    for r in outlines.concave_hulls(points, 40.0).collect():
        assert r.hole is False
        rings.setdefault((r.ring_x, r.ring_y), []).append((r.ord, r.x, r.y))
    shapes = [[p[1:] for p in sorted(ring)] for ring in rings.values()]

    def inside(x, y):
        odd = False
        for ring in shapes:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (y1 > y) != (y2 > y) and x < x1:  # sides run along the axes
                    odd = not odd
        return odd

    assert all(inside(x, y) for x, y in [*at, (500.0, 500.0)])
    assert [(500.0, 500.0), (510.0, 500.0), (510.0, 510.0), (500.0, 510.0)] in [s[i:] + s[:i] for s in shapes for i in range(len(s))]
    assert outlines.concave_hulls(points.limit(0)).count() == 0
    with pytest.raises(ValueError):
        outlines.concave_hulls(points, 0.0)


def test_a_community_larger_than_a_part(spark):
    """A frame of a million members, with a hole: no part holds it, and its sides are exact."""
    n = 1000
    points = spark.range(n * n).selectExpr("7L AS community", f"CAST(id % {n} AS DOUBLE) AS x", f"CAST(id DIV {n} AS DOUBLE) AS y").where("x < 300 OR x >= 700 OR y < 300 OR y >= 700")
    found = outlines.measures(outlines.concave_hulls(points, 8.0, holes=True)).collect()
    assert [tuple(r) for r in found] == [(7, 1, 1, 8, 1000.0**2 - 400.0**2, 4 * 1000.0 + 4 * 400.0)]


def test_measures_agree_with_counts(spark, sf):
    assert {"concave_hulls", "hull_measures"} <= set(catalogue.queries()) and "hull_measures" in catalogue.oracle_sql()
    assert catalogue.queries()["hull_measures"](spark, sf).count() > 0
