"""Code bases as discs within discs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import hierarchy
from graphloom.operators.hierarchy import Codebase

SCHEMA = "node_id long, parent long, depth int, category int"


def code(seed=4):
    rng, rows, top = random.Random(seed), [(0, None, 0, 0)], 1
    for _ in range(5):
        d, top = top, top + 1
        rows.append((d, 0, 1, 1))
        for _ in range(rng.choice([1, 2, 9])):
            f, top = top, top + 1
            rows.append((f, d, 2, 2))
            for _ in range(rng.choice([0, 1, 2, 30])):
                rows.append((top, f, 3, rng.choice([3, 4, None])))
                top += 1
    return rows


def sequential_radii(rows, c=Codebase()):
    kids, radius = {}, {}
    for n, p, *_ in rows:
        kids.setdefault(p, []).append(n)
    category = {n: 4 if k is None else k for n, _, _, k in rows}
    base = lambda n: [2 * c.directory_radius, c.directory_radius, c.file_radius, c.symbol_radius, c.symbol_radius][category[n]]
    for n, *_ in sorted(rows, key=lambda r: -r[2]):
        own = kids.get(n)
        pad = c.directory_padding if category[n] <= 1 else c.file_padding
        radius[n] = max(math.sqrt(sum(radius[k] ** 2 for k in own) / c.fill), base(n)) + pad if own else base(n)
    return radius


def test_radii_by_category(spark):
    rows = code()
    found = {r.node_id: r.radius for r in hierarchy.codebase_radii(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == pytest.approx(sequential_radii(rows))


def test_children_stay_inside_and_come_apart(spark):
    rows = code()
    c = Codebase(fill=0.5, spread=1.0)  # room enough for all
    found = {r.node_id: r for r in hierarchy.codebase_layout(spark.createDataFrame(rows, SCHEMA), c, rounds=15).collect()}
    assert len(found) == len(rows)
    kids = {}
    for n, p, *_ in rows:
        kids.setdefault(p, []).append(n)
    for p, own in kids.items():
        if p is None:
            continue
        for k in own:
            assert math.hypot(found[k].x - found[p].x, found[k].y - found[p].y) + found[k].radius <= found[p].radius + 1e-6
        if len(own) == 1:
            assert (found[own[0]].x, found[own[0]].y) == (found[p].x, found[p].y)
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                over = found[a].radius + found[b].radius - math.hypot(found[a].x - found[b].x, found[a].y - found[b].y)
                assert over <= 0.2 * min(found[a].radius, found[b].radius)


def test_overlaps_as_all_pairs(spark):
    rng = random.Random(1)
    discs = [(p, i, rng.uniform(0.5, 6), rng.uniform(-20, 20), rng.uniform(-20, 20)) for p in (1, 2) for i in range(60)] + [(3, 0, 1.0, 0.0, 0.0), (3, 1, 1.0, 0.0, 0.0)]
    found = {(r.parent, r.i, r.i2): (r.over, r.ux, r.uy) for r in hierarchy.overlaps(spark.createDataFrame(discs, "parent long, i long, radius double, dx double, dy double")).collect()}
    want = {(p, i, j): r + s - math.hypot(x - u, y - v) for p, i, r, x, y in discs for q, j, s, u, v in discs if p == q and i != j and r + s - math.hypot(x - u, y - v) > 1e-9}
    assert {k: v[0] for k, v in found.items()} == pytest.approx(want) and len(want) > 50
    assert found[3, 0, 1][1] == -found[3, 1, 0][1] and math.hypot(*found[3, 0, 1][1:]) == pytest.approx(1)


def test_codebase_of_a_graph(spark):
    nodes = spark.createDataFrame([(0, "repository"), (1, "directory"), (2, "file"), (3, "method"), (4, "note"), (9, "file")], "node_id long, type string")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (2, 4), (3, 3), (2, 77)], "src long, dst long")
    found = {r.node_id: r for r in hierarchy.codebase_graph(nodes, edges).collect()}
    assert set(found) == {0, 1, 2, 3, 4} and found[0].radius > found[1].radius > found[2].radius > found[3].radius == found[4].radius == 5.0
    assert hierarchy.codebase_graph(nodes, edges.limit(0)).count() == 0
    kinds = spark.createDataFrame([(k,) for k in ("repository", "directory", "file", "interface", "poem", None)], "k string").select(hierarchy.category_of(F.col("k")).alias("c"))
    assert [r.c for r in kinds.collect()] == [0, 1, 2, 3, 4, 4]
