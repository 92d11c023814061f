"""Communities: planted ones come back, and the rules of levels."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import analytics


@pytest.mark.parametrize("refined", [False, True])
def test_planted_communities_in_a_ring(spark, refined):
    count, size = 4, 40
    ids = spark.range(count * size)
    place = F.floor(F.col("id") / size).cast("long")
    inner = ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("j")).select("src", (F.floor(F.col("src") / size).cast("long") * size + F.pmod(F.xxhash64("src", "j"), F.lit(size))).alias("dst")).where("src != dst")
    bridges = spark.range(count).select((F.col("id") * size).alias("src"), ((F.col("id") + 1) % count * size).alias("dst"))
    seen = []
    nodes = ids.select(F.col("id").alias("node_id"))
    found = analytics.louvain(nodes, inner.union(bridges), refined=refined, progress=lambda level, q: seen.append(q))
    groups = found.join(ids.select(F.col("id").alias("node_id"), place.alias("planted")), "node_id").groupBy("community", "planted").count().collect()
    assert sum(max(r["count"] for r in groups if r["planted"] == p) for p in range(count)) >= 0.95 * count * size
    assert len({r["community"] for r in groups}) <= 2 * count
    # what the moves report is the modularity of the result
    q = analytics.modularity(analytics.undirected_weights(inner.union(bridges)), found).first()[0]
    assert q == pytest.approx(max(seen), abs=1e-9)


def test_one_community_or_no_edges_leave_nodes_alone(spark):
    nodes = spark.createDataFrame([(i,) for i in range(3)], "node_id long")
    triangle = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    alone = [(0, 0), (1, 1), (2, 2)]
    assert sorted(map(tuple, analytics.louvain(nodes, triangle).collect())) == alone
    assert sorted(map(tuple, analytics.louvain(nodes, triangle.limit(0)).collect())) == alone


def test_loops_and_a_hub(spark):
    edges = [(0, i) for i in range(1, 9)] + [(i, i) for i in range(1, 9)] + [(20, 21), (21, 22), (22, 20)]
    nodes = spark.createDataFrame([(i,) for i in [*range(9), 20, 21, 22, 30]], "node_id long")
    found = dict(analytics.louvain(nodes, spark.createDataFrame(edges, "src long, dst long")).collect())
    assert found[20] == found[21] == found[22] == 20 and found[30] == 30 and len(found) == 13


def test_a_half_pass_shuffles_once_for_its_nodes_and_measures_as_it_writes(spark, monkeypatch):
    edges = spark.range(40).selectExpr("id AS src", "(id * 7 + 3) % 40 AS dst").union(spark.range(40).selectExpr("id AS src", "id - id % 8 AS dst"))
    nodes, plans = spark.range(40).withColumnRenamed("id", "node_id"), []
    moved, stored = analytics._moved, analytics.stored

    def watched(*args):
        plans.append(moved(*args))
        return plans[-1]

    def write(df):
        spark.sparkContext.setJobGroup("written", "")
        out = stored(df)
        spark.sparkContext.setJobGroup("read", "")
        return out

    monkeypatch.setattr(analytics, "_moved", watched)
    monkeypatch.setattr(analytics, "stored", write)
    graph = stored(analytics.undirected_weights(edges))
    found, q = analytics._settled(graph, nodes.selectExpr("node_id", "node_id AS community"), 1.0, 100, 1e-4)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("read")) <= 2  # the sums of the start, none a half pass
    assert plans[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 2
    monkeypatch.setattr(analytics, "PLAIN", 0)
    again, q2 = analytics._settled(graph, nodes.selectExpr("node_id", "node_id AS community"), 1.0, 100, 1e-4)
    assert q == pytest.approx(q2) and sorted(found.collect()) == sorted(again.collect())
