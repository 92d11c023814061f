"""The supplier graph by brute force, and how often a part's list is sent."""

import random
from collections import Counter

import numpy as np
import pytest

from graphloom.plans import testgraphs


def brute(lines, k=5):
    """Each supplier's partners that share most parts, ties by id."""
    parts = {}
    for p, s in lines:
        if p is not None and s is not None:
            parts.setdefault(p, set()).add(s)
    shared = Counter((a, b) for own in parts.values() for a in own for b in own if a != b)
    best = {}
    for (a, b), n in sorted(shared.items(), key=lambda r: (r[0][0], -r[1], r[0][1])):
        best.setdefault(a, []).append((a, b, float(n)))
    return sorted(row for rows in best.values() for row in rows[:k])


def write(spark, lines, path):
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").repartition(3).write.parquet(f"{path}/lineitem.parquet")


@pytest.mark.parametrize("limits", [{}, {"NEXT": 3, "HELD": 20, "LISTED": 4}, {"PAIRS": 1}], ids=["as it is", "small", "one supplier a run"])
def test_graph(spark, tmp_path, monkeypatch, limits):
    """Ids below zero and far apart, repeats, nulls, a part of one supplier and one of all."""
    rng = random.Random(4)
    ids = [*range(-5, 12), 255, 256, 2**40, 2**40 + 1, 2**62]
    lines = [(rng.randrange(25), rng.choice(ids)) for _ in range(160)] + [(99, s) for s in ids] + [(100, 3), (None, 3), (4, None), (2, 5), (2, 5)]
    write(spark, lines, tmp_path)
    for name, value in limits.items():
        monkeypatch.setattr(testgraphs, name, value)
    assert sorted(map(tuple, testgraphs.knn(spark, str(tmp_path)).collect())) == brute(lines)


def test_a_run_of_suppliers_gets_a_list_once(spark, tmp_path, monkeypatch):
    """30 parts of 20 suppliers: two rows a part, one for each run of ids, and not one for each supplier."""
    lines = [(p, s) for p in range(30) for s in [*range(15), *range(1000, 1005)]]
    write(spark, lines, tmp_path)
    sent, frame = [], type(spark.range(1))
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, *rest: sent.append(df.count()) or real(df, *rest))
    assert sorted(map(tuple, testgraphs.knn(spark, str(tmp_path)).collect())) == brute(lines)
    assert sent == [60]


def test_partners_counted_with_their_last_list(monkeypatch):
    """A supplier whose last list fills its room has nothing left to count."""
    monkeypatch.setattr(testgraphs, "HELD", 3)
    one = testgraphs._Partners(7)
    one.add(np.array([1, 2, 2, 7], np.int64))
    assert [c.tolist() for c in one.best(5)] == [[2, 1], [2, 1]]
