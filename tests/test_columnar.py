"""Flat arrays in files, read in parts and checked."""

import json

import numpy as np
import pytest

from graphloom.sources import columnar
from graphloom.sources.graph import GraphError


def write(folder, meta, files=1, **arrays):
    (folder / "meta.json").write_text(json.dumps(meta))
    for name, values in arrays.items():
        (folder / name).mkdir(exist_ok=True)
        rows = np.asarray(values).reshape(-1, columnar.ARRAYS[name][0])
        for k, part in enumerate(np.array_split(rows, files)):
            (folder / name / f"part-{k:03}.bin").write_bytes(part.astype(columnar.ARRAYS[name][2]).tobytes())


def test_arrays_in_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(columnar, "ROWS", 7)
    n, m = 50, 120
    rng = np.random.default_rng(1)
    places, pairs, colors = rng.normal(size=(n, 2)).astype("f4"), rng.integers(0, n, (m, 2)), rng.random((n, 3)).astype("f4")
    write(tmp_path, {"nodeCount": n, "edgeCount": m}, 6, positions=places, edgePairs=pairs, nodeColors=colors, edgeWidths=np.arange(m))
    graph = columnar.read_columnar(spark, str(tmp_path))
    nodes = sorted(graph.nodes.collect(), key=lambda r: r.node_id)
    assert [r.ext_id for r in nodes] == [f"n{i}" for i in range(n)] and {r.radius for r in nodes} == {5.0}
    assert np.allclose([(r.x, r.y) for r in nodes], places) and np.allclose([tuple(r.color) for r in nodes], colors)
    edges = sorted(graph.edges.collect(), key=lambda r: r.edge_id)
    assert [(r.src, r.dst) for r in edges] == list(map(tuple, pairs.tolist())) and [r.width for r in edges] == list(range(m))
    assert edges[3].ext_id == "e3" and tuple(edges[0].color) == (0.5, 0.5, 0.5)
    assert columnar.array_rows(spark, str(tmp_path), "edgePairs").rdd.getNumPartitions() > 1


def test_nothing_but_counts(spark, tmp_path):
    write(tmp_path, {"nodeCount": 3})
    graph = columnar.read_columnar(spark, str(tmp_path))
    assert graph.edges.count() == 0 and {(r.x, r.y) for r in graph.nodes.collect()} == {(0.0, 0.0)}


@pytest.mark.parametrize(("meta", "arrays", "want"), [
    ({"nodeCount": 3, "edgeCount": 1}, {"positions": [0.0] * 4}, [("positions", "length", 6, 4)]),
    ({"nodeCount": 3, "edgeCount": 2}, {"edgePairs": [0, 1], "nodeRadii": [1.0]}, [("edgePairs", "length", 4, 2), ("nodeRadii", "length", 3, 1)]),
    ({"nodeCount": 3, "edgeCount": 2}, {"edgePairs": [0, 3, 4, 1]}, [("edgePairs", "an end is no node", 3, 2)]),
    ({"edgeCount": 2}, {}, [("meta", "counts", 0, None)]),
    ({"nodeCount": -1}, {}, [("meta", "counts", 0, -1)]),
])
def test_faults(spark, tmp_path, meta, arrays, want):
    write(tmp_path, meta, **arrays)
    assert sorted(map(tuple, columnar.columnar_faults(spark, str(tmp_path)).collect())) == want
    with pytest.raises(GraphError) as told:
        columnar.read_columnar(spark, str(tmp_path))
    assert told.value.rows.count() == len(want)


def test_a_torn_file(spark, tmp_path):
    write(tmp_path, {"nodeCount": 4, "edgeCount": 0}, positions=[0.0] * 8)
    (tmp_path / "positions" / "part-000.bin").write_bytes(b"\0" * 12)
    (tmp_path / "positions" / "part-001.bin").write_bytes(b"\0" * 20)
    assert [tuple(r) for r in columnar.columnar_faults(spark, str(tmp_path)).collect()] == [("positions", "file ends within a row", 0, 2)]
