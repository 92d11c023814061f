"""Components, reached counts and centralities against walks from every node, and how rounds and errors grow."""

import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.operators import iterate, reach
from graphloom.operators import walks as inside


def graph(spark, n, edges):
    return spark.range(n).withColumnRenamed("id", "node_id"), spark.createDataFrame([*edges], "src long, dst long").repartition(3)


def walks(n, edges):
    out = [set() for _ in range(n)]
    for a, b in edges:
        if a < n and b < n:
            out[a].add(b)
    found = []
    for s in range(n):
        seen, front, turn = {s: 0}, [s], 0
        while front:
            turn += 1
            front = [b for b in {b for a in front for b in out[a]} if b not in seen]
            seen.update(dict.fromkeys(front, turn))
        found.append(seen)
    return found


def tangled(n, m, seed):
    """Random edges, loops, repeats, an end that is no node, a circle, chains and a hub."""
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(3, 3), (5, 6), (5, 6), (1, n + 50)]
    edges += [(i, i + 1) for i in range(n, n + 12)] + [(n + 12, n)]  # a circle on its own
    edges += [(0, n + 20), *((i, i + 1) for i in range(n + 20, n + 28)), (n + 28, 2)]  # a chain between two
    return n + 40, edges + [(n + 30, i) for i in range(0, n, 2)]


def least_mutual(seen):
    return {i: min(j for j in s if i in seen[j]) for i, s in enumerate(seen)}


@pytest.mark.parametrize(("n", "m", "seed"), [(40, 60, 1), (50, 20, 3)])
def test_components(spark, n, m, seed):
    n, edges = tangled(n, m, seed)
    assert {r.node_id: r.component for r in reach.strong_components(*graph(spark, n, edges)).collect()} == least_mutual(walks(n, edges))


def test_counts(spark):
    n, edges = tangled(20, 24, 2)
    nodes, e = graph(spark, n, edges)
    counts = {i: len(s) - 1 for i, s in enumerate(walks(n, edges))}
    assert {r.node_id: r.descendants for r in reach.reached_counts(nodes, e, batch=25).collect()} == counts
    assert all(abs(r.descendants - counts[r.node_id]) <= max(1, 0.1 * counts[r.node_id]) for r in reach.reached_estimates(nodes, e).collect())


@pytest.mark.parametrize("batch", [2, 1000])
def test_root(spark, batch):
    edges = [(0, 3), (1, 3), (3, 4), (1, 5), (5, 1), (2, 6), (6, 4), (4, 7), (7, 8), (8, 4), (9, 7)]
    counts = [len(s) - 1 for s in walks(10, edges)]
    best = min((-counts[i], i) for i in (0, 2, 9))
    assert tuple(reach.root(*graph(spark, 10, edges), batch=batch).first()) == (best[1], -best[0])


def test_edges_without_nodes(spark):
    nodes, none = graph(spark, 3, [])
    assert sorted(map(tuple, reach.strong_components(nodes, none).collect())) == [(0, 0), (1, 1), (2, 2)]
    assert sorted(map(tuple, reach.reached_counts(nodes, none).collect())) == [(0, 0), (1, 0), (2, 0)]
    circle = graph(spark, 3, [(0, 1), (1, 2), (2, 0)])
    assert sorted(map(tuple, reach.reached_counts(*circle).collect())) == [(0, 2), (1, 2), (2, 2)]
    assert tuple(reach.root(*circle).first()) == (0, 2)


def test_a_long_chain_takes_log_rounds(spark, monkeypatch):
    written = []
    add = iterate._WRITTEN.append
    monkeypatch.setattr(iterate, "new_folder", lambda s, f=iterate.new_folder: (written.append(1), f(s))[1])
    n = 10_000
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    chain = spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst")
    assert add and reach.strong_components(nodes, chain).where("node_id = component").count() == n
    assert len(written) < 45
    ring = chain.union(spark.createDataFrame([(n - 1, 0)], "src long, dst long"))
    assert reach.strong_components(nodes, ring).where("component = 0").count() == n


def test_centralities_by_batches(spark):
    n, edges = 14, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6), (6, 7), (7, 3), (8, 0), (9, 9), (1, 99)]
    nodes, e = graph(spark, n, edges)
    seen = walks(n, edges)
    want = {i: (r := len(s) - 1) and r / sum(s.values()) * r / (n - 1) for i, s in enumerate(seen)}
    assert {r.node_id: r.closeness for r in reach.closeness(nodes, e, batch=9).collect()} == pytest.approx(want)
    about = {r.node_id: r.closeness for r in reach.closeness_estimates(nodes, e).collect()}
    assert all(abs(about[i] - want[i]) <= 0.1 * want[i] for i in range(n))
    one, many = ({r.node_id: r.betweenness for r in reach.betweenness(nodes, e, batch=b).collect()} for b in (1000, 9))
    assert one == pytest.approx(many)
    rough = {r.node_id: r.betweenness for r in reach.betweenness_estimates(nodes, e, error=0.5, doubt=0.5).collect()}
    assert rough != one and all(abs(rough[i] - one[i]) <= 0.5 * n * (n - 2) for i in range(n))


def test_closeness_packs_sources_into_bits(spark, monkeypatch):
    """200 sources are four chunks of bits in one batch: no pairs of source and node are stored, and the values are exact."""
    rng = random.Random(12)
    edges = sorted({(rng.randrange(200), rng.randrange(200)) for _ in range(420)})
    monkeypatch.setattr(reach, "distances", None)
    nodes, e = graph(spark, 200, edges)
    want = {i: (r := len(s) - 1) and r / sum(s.values()) * r / 199 for i, s in enumerate(walks(200, edges))}
    assert {r.node_id: r.closeness for r in reach.closeness(nodes, e).collect()} == pytest.approx(want)


def test_betweenness_takes_batches_by_their_pairs(spark, monkeypatch):
    """Sources that reach little share batches: 40 sources from a first batch of 2 take three batches, each up to eight times the one before."""
    calls, real = [], reach.distances
    monkeypatch.setattr(reach, "distances", lambda edges, some: calls.append(some.count()) or real(edges, some))
    nodes, e = graph(spark, 40, [(i, i + 1) for i in range(0, 39, 4)] + [(i + 1, i + 2) for i in range(0, 37, 4)])
    found = {r.node_id: r.betweenness for r in reach.betweenness(nodes, e, batch=2).collect()}
    assert calls == [2, 16, 22] and found == {i: float(i % 4 == 1) for i in range(40)}


def shares(n, edges):
    """Betweenness by all pairs; an edge that repeats is a path of its own."""
    seen, own = walks(n, edges), [(a, b) for a, b in edges if a < n and b < n]
    paths = []
    for s, d in enumerate(seen):
        found = dict.fromkeys(d, 0) | {s: 1}
        for v in sorted(d, key=d.get):
            for a, b in own:
                if a == v and d[b] == d[v] + 1:
                    found[b] += found[v]
        paths.append(found)
    total = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        for v in seen[s]:
            for t in seen[v]:
                if v != s and t not in (s, v) and seen[s][v] + seen[v][t] == seen[s][t]:
                    total[v] += paths[s][v] * paths[v][t] / paths[s][t]
    return total


@pytest.mark.parametrize(("shared", "walked"), [(5_000, 10**9), (20, 10**9), (1, 300)], ids=["together", "alone", "dealt"])
def test_betweenness_walks_components_in_tasks(spark, monkeypatch, shared, walked):
    """No pair of source and node is a row, however components are bundled and their sources dealt."""
    monkeypatch.setattr(reach, "distances", None)
    monkeypatch.setattr(inside, "SHARED", shared)
    monkeypatch.setattr(inside, "WALKED", walked)
    n, edges = tangled(30, 45, 5)
    nodes, e = graph(spark, n, edges)
    assert {r.node_id: r.betweenness for r in reach.betweenness(nodes, e).collect()} == pytest.approx(shares(n, edges))
    assert (inside.placed(e).agg({"parts": "max"}).first()[0] > 1) == (walked == 300)


def test_betweenness_joins_what_no_task_holds(spark, monkeypatch):
    """The large component goes by joins, the circle in a task; both count."""
    calls, real = [], reach.distances
    monkeypatch.setattr(reach, "distances", lambda edges, some: calls.append(some.count()) or real(edges, some))
    monkeypatch.setattr(inside, "HELD", 12)
    n, edges = 12, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 0), (3, 5), (3, 5), (8, 9), (9, 10), (10, 8)]
    nodes, e = graph(spark, n, edges)
    assert dict(reach.betweenness(nodes, e).collect()) == pytest.approx(shares(n, edges)) and calls == [6]
    some = nodes.where("node_id % 4 = 0")
    joined = dict(reach.betweenness(nodes, e, some).collect())
    monkeypatch.setattr(inside, "HELD", 100)
    assert dict(reach.betweenness(nodes, e, some).collect()) == pytest.approx(joined) and calls == [6, 2]


def close(n, edges):
    return {i: (r := len(s) - 1) and r / sum(s.values()) * r / (n - 1) for i, s in enumerate(walks(n, edges))}


@pytest.mark.parametrize(("shared", "walked"), [(5_000, 10**9), (20, 10**9), (1, 20)], ids=["together", "alone", "dealt"])
def test_closeness_walks_components_in_tasks(spark, monkeypatch, shared, walked):
    """No rounds of walks are stored, however components are bundled and their sources dealt; more sources than one long has bits."""
    monkeypatch.setattr(reach, "_packed", None)
    monkeypatch.setattr(inside, "SHARED", shared)
    monkeypatch.setattr(inside, "WALKED", walked)
    n, edges = tangled(90, 130, 6)
    nodes, e = graph(spark, n, edges)
    assert {r.node_id: r.closeness for r in reach.closeness(nodes, e).collect()} == pytest.approx(close(n, edges))


def test_closeness_joins_what_no_task_holds(spark, monkeypatch):
    calls, real = [], reach._packed
    monkeypatch.setattr(reach, "_packed", lambda nodes: calls.append(nodes.count()) or real(nodes))
    monkeypatch.setattr(inside, "HELD", 12)
    n, edges = 12, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 0), (3, 5), (3, 5), (8, 9), (9, 10), (10, 8)]
    assert dict(reach.closeness(*graph(spark, n, edges)).collect()) == pytest.approx(close(n, edges)) and calls == [6]


def test_walks_hold_a_few_sources_at_a_time(monkeypatch):
    rng, n = np.random.default_rng(3), 50
    src, dst, own = rng.integers(0, n, 120), rng.integers(0, n, 120), np.arange(n)
    group = inside._Group(pa.table({"src": np.concatenate([src, own]), "dst": np.concatenate([dst, own]), "source": np.arange(120 + n) >= 120}))
    want = list(shares(n, list(zip(src.tolist(), dst.tolist(), strict=True))).values())
    for step, parts in ((10, n), (10**6, 1)):
        monkeypatch.setattr(inside, "STEP", step)
        some = group.walks(1)
        assert len(some) == parts and sum(inside._shares(group, s) for s in some) == pytest.approx(want)
    back, seen = inside._Group(pa.table({"src": np.concatenate([src, own]), "dst": np.concatenate([dst, own]), "source": np.arange(120 + n) >= 120}), back=True), walks(n, list(zip(src.tolist(), dst.tolist(), strict=True)))
    for each in (1, 7, n):
        number, total = (sum(c) for c in zip(*(inside._sums(back, back.sources[i : i + each]) for i in range(0, n, each)), strict=True))
        assert number.tolist() == [len(s) - 1 for s in seen] and total.tolist() == [sum(s.values()) for s in seen]
