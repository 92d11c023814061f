"""Tours and tidy trees against sequential walks."""

import math
import random

import pytest

from graphloom.operators import trees

SCHEMA = "node_id long, parent long, depth int"


def children_of(rows):
    out = {}
    for node, parent, *_ in sorted(rows):
        out.setdefault(parent, []).append(node)
    return out


def random_tree(n, seed, wide=3.0):
    rng = random.Random(seed)
    rows = [(0, None, 0)]
    for i in range(1, n):
        parent = rows[int(len(rows) * rng.random() ** wide)]
        rows.append((i, parent[0], parent[2] + 1))
    return rows


def walk(rows):
    """(root, pre, post, size, depth) by a sequential depth-first walk."""
    kids, out, post = children_of(rows), {}, 0
    for root in kids[None]:
        stack, pre, post = [(root, 0, False)], 0, 0
        while stack:
            node, depth, after = stack.pop()
            if after:
                out[node] += (post, pre - out[node][1], depth)
                post += 1
                continue
            out[node] = (root, pre)
            pre += 1
            stack.append((node, depth, True))
            stack += [(k, depth + 1, False) for k in reversed(kids.get(node, []))]
    return out


@pytest.mark.parametrize("rows", [random_tree(400, 1), random_tree(300, 2, 0.5), [(i, i - 1 if i else None, i) for i in range(700)], [(i, 0 if i else None, min(i, 1)) for i in range(500)], [(5, None, 0)], [(1, None, 0), (2, None, 0), (3, 2, 1), (9, 99, 0)]], ids=["random", "deep", "chain", "hub", "one", "forest"])
def test_tour_is_a_walk(spark, rows):
    found = {r.node_id: tuple(r)[1:] for r in trees.tour(spark.createDataFrame([r[:2] for r in rows], "node_id long, parent long")).collect()}
    ids = {r[0] for r in rows}
    assert found == walk([(n, p if p in ids else None) for n, p, _ in rows])


def test_tour_takes_an_order_and_refuses_circles(spark):
    rows = spark.createDataFrame([(0, None, 0), (1, 0, 9), (2, 0, 5), (3, 2, 1)], "node_id long, parent long, at int")
    assert {r.node_id: r.pre for r in trees.tour(rows, "at").collect()} == {0: 0, 2: 1, 3: 2, 1: 3}
    with pytest.raises(ValueError):
        trees.tour(spark.createDataFrame([(0, None), (1, 2), (2, 1)], "node_id long, parent long")).count()


def test_families_need_no_window(spark):
    rows = trees.siblings(spark.createDataFrame([(i, 0) for i in range(1, 50)], "node_id long, parent long"))
    assert sorted((r.node_id, r.place) for r in rows.collect()) == [(i, i - 1) for i in range(1, 50)]


def sequential(rows, sibling=1.0, subtree=2.0):
    """Outlines as lists by depth; families merged in pairs, the right block moved as one."""
    kids, step = children_of(rows), {}

    def outline(node):
        blocks = [(outline(k), [(k, 0.0)]) for k in kids.get(node, [])]
        while len(blocks) > 1:
            out = []
            for left, right in zip(blocks[::2], blocks[1::2], strict=False):
                (a, am), (b, bm) = left, right
                move = max(x[1] + (subtree if d else sibling) - y[0] for d, (x, y) in enumerate(zip(a, b, strict=False)))
                both = [(a[d][0] if d < len(a) else b[d][0] + move, b[d][1] + move if d < len(b) else a[d][1]) for d in range(max(len(a), len(b)))]
                out.append((both, am + [(k, x + move) for k, x in bm]))
            blocks = out + blocks[len(out) * 2 :]
        if not blocks:
            return [(0.0, 0.0)]
        (lines, members), = blocks
        middle = members[-1][1] / 2
        step.update({k: x - middle for k, x in members})
        return [(0.0, 0.0)] + [(a - middle, b - middle) for a, b in lines]

    root = kids[None][0]
    outline(root)
    place = {root: 0.0}
    for node, parent, _ in sorted(rows, key=lambda r: r[2]):
        if parent is not None:
            place[node] = place[parent] + step[node]
    return place


@pytest.mark.parametrize("rows", [random_tree(150, 3, 1.5), random_tree(120, 4, 4.0), [(i, 0 if i else None, min(i, 1)) for i in range(300)], [(i, i - 1 if i else None, i) for i in range(6)]], ids=["random", "wide", "hub", "chain"])
def test_contours(spark, rows):
    found = {r.node_id: r for r in trees.contours(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = sequential(rows)
    assert {i: r.across for i, r in found.items()} == pytest.approx(want)
    kids = children_of(rows)
    for depth in {r[2] for r in rows}:  # no two nodes of a depth are closer than asked
        level = sorted((found[n].across, p) for n, p, d in rows if d == depth)
        assert all(b[0] - a[0] >= (1.0 if a[1] == b[1] else 2.0) - 1e-9 for a, b in zip(level, level[1:], strict=False))
    assert all(found[p].across == pytest.approx((found[k[0]].across + found[k[-1]].across) / 2) for p, k in kids.items() if p is not None)


def graph(spark, n, edges):
    return spark.range(n).withColumnRenamed("id", "node_id"), spark.createDataFrame(edges, "src long, dst long")


def laid(spark, n, edges, **options):
    return {r.node_id: (r.x, r.y) for r in trees.tidy_graph(*graph(spark, n, edges), **options).collect()}


def test_reference_cases(spark):
    place = laid(spark, 3, [(0, 1), (0, 2)], root=0, level=100.0, radial=False)
    assert place == {0: (0.0, 0.0), 1: (-50.0, 100.0), 2: (50.0, 100.0)}
    deeper = laid(spark, 6, [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)], root=0, level=50.0, radial=False)
    assert [deeper[i][1] for i in range(6)] == [0, 50, 50, 100, 100, 100]
    ring = laid(spark, 5, [(0, i) for i in range(1, 5)], root=0, level=100.0)
    assert ring[0] == (0.0, 0.0) and all(math.hypot(*ring[i]) == pytest.approx(200) for i in range(1, 5))
    assert laid(spark, 3, [(0, 1), (0, 2)], radial=False)[0][1] == 0  # the root is found
    assert set(laid(spark, 3, [(0, 1), (1, 2), (2, 0)], root=0, radial=False)) == {0, 1, 2}
    assert set(laid(spark, 3, [(0, 1), (0, 999)], root=0)) == {0, 1}
    assert set(laid(spark, 2, [(0, 0), (0, 1)], root=0)) == {0, 1}
    lopsided = laid(spark, 5, [(0, 1), (0, 2), (1, 3), (3, 4)], root=0, level=50.0, radial=False)
    assert lopsided[4][1] == 150 and lopsided[1][0] == lopsided[3][0] == lopsided[4][0] < lopsided[2][0]
    assert laid(spark, 1, [(0, 0)], root=0) == {}


def test_tidy_sql_merges_families_of_any_size():
    """The SQL of tidy_tree over one nation of 20,000 customers: no family is left in several blocks."""
    duckdb = pytest.importorskip("duckdb")
    from graphloom.plans import catalogue

    c = duckdb.connect()
    c.execute("CREATE TABLE region AS SELECT 0 AS r_regionkey")
    c.execute("CREATE TABLE nation AS SELECT 0 AS n_nationkey, 0 AS n_regionkey")
    c.execute("CREATE TABLE customer AS SELECT range AS c_custkey, 0 AS c_nationkey FROM range(20000)")
    rows = c.execute(f"SELECT x FROM ({catalogue.ORACLES['tidy_tree']}) q WHERE node_id >= 1000 ORDER BY node_id").fetchall()
    assert [x for (x,) in rows] == [80 * (i - 19999 / 2) for i in range(20000)]
