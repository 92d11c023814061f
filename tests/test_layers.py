"""Layers, their settings, label tables and boxes on small examples; their queries are held against SQL with the others."""

import math

from pyspark.sql import functions as F

from graphloom.functions.geometry import Box, Viewport
from graphloom.operators import layers, style


def test_layers_take_rows_by_predicate(spark):
    nodes = spark.createDataFrame([(1, 1.0), (2, None), (3, -1.0)], "node_id long, v double")
    rows = layers.layer_rows(nodes, {"a": None, "b": F.col("v") > 0})
    assert sorted((r.layer, r.node_id) for r in rows.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    edges = spark.createDataFrame([(1, 2), (1, 1)], "src long, dst long")
    assert sorted(map(tuple, layers.edge_layer_rows(edges, rows, {"a": None, "b": None}).select("layer", "src", "dst").collect())) == [("a", 1, 1), ("a", 1, 2), ("b", 1, 1)]


def test_settings_tell_their_faults():
    assert not layers.Heat().faults() and not layers.Contour().faults() and not layers.Blobs().faults()
    assert len(layers.Heat(radius=0, intensity=-1, opacity=1.1, resolution=2.5).faults()) == 4
    assert layers.Contour(thresholds=()).faults() == ["thresholds needs a value"]
    assert len(layers.Contour(thresholds=(0.5, 1.5), stroke=0, opacity=float("nan")).faults()) == 3
    assert len(layers.Blobs(threshold=2, blend=-1, opacity=-1, radius=0, outline=-1).faults()) == 5


def test_labels_are_set_added_and_removed(spark):
    row = lambda *r: spark.createDataFrame(list(r), "node_id long, text string, priority double")
    table = style.add_labels(style.set_labels(row((1, "a", 1.0), (2, "b", 5.0))), row((3, "c", 5.0), (1, "d", 9.0)))
    assert [r.text for r in style.by_priority(table).collect()] == ["d", "b", "c", "a"]
    left = style.remove_labels(table, spark.createDataFrame([(1,), (1,)], "node_id long"))
    assert [r.text for r in style.by_priority(left).collect()] == ["b", "c"]
    assert [(r.text, r.round) for r in style.add_labels(left.limit(0), row((4, "e", 0.0))).collect()] == [("e", 0)]


def test_boxes(spark):
    box = Box(0.0, 0.0, 4.0, 2.0)
    assert box.middle() == (2.0, 1.0) and box.expand(1.0) == Box(-1.0, -1.0, 5.0, 3.0)
    assert box.scale(100, 100, 10) == 20.0 and Box(0.0, 0.0, 0.0, 2.0).scale(100, 100) == 1.0
    assert Viewport(scale=8.0).level() == 3.0 and Viewport().box() == Box(-400.0, -300.0, 400.0, 300.0)
    at = spark.createDataFrame([(7.0, 6.0), (4.0, 2.0)], "x double, y double")
    far = at.select(box.distance(F.col("x"), F.col("y")).alias("d"), box.contains(F.col("x"), F.col("y")).alias("i")).collect()
    assert math.isclose(far[0].d, 5.0) and not far[0].i and far[1].d == 0.0 and far[1].i
