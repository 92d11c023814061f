"""Keyed stream state and the growing dictionary against plain dicts."""

import datetime
import random

import pytest

from graphloom.sources.ids import IdMap
from graphloom.streaming import values

START = datetime.datetime(2024, 1, 1)
CHANGE = "stream string, node_id long, value double, at timestamp, seq long"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def feed(spark, source, out, rows):
    """A batch of its own, read by a query that starts again from its checkpoint."""
    spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(source)
    changes = spark.readStream.schema(CHANGE).parquet(source)
    values.keep_values(changes, f"{out}/values", f"{out}/checkpoint").awaitTermination()
    return {(r.stream, r.node_id): r.value for r in values.current_values(spark, f"{out}/values").collect()}


def test_state_survives_restarts_clears_and_late_rows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert feed(spark, source, out, [("a", 1, 1.0, at(0), 1), ("a", 2, 2.0, at(1), 2), ("b", 1, 3.0, at(2), 3), ("a", 1, 5.0, at(0), 4)]) == {("a", 1): 5.0, ("a", 2): 2.0, ("b", 1): 3.0}
    # a clear, an earlier row that comes late, a repeated one, and rows without a place in time
    assert feed(spark, source, out, [("a", 2, None, at(4), 5), ("a", 1, 4.0, at(0), 2), ("b", 1, 3.0, at(2), 3), ("b", 9, 1.0, None, 3), (None, 9, 1.0, at(5), 3)]) == {("a", 1): 5.0, ("b", 1): 3.0}
    # a value older than the clear stays cleared, a newer one is set again; NaN clears too
    assert feed(spark, source, out, [("a", 2, 7.0, at(3), 6), ("b", 1, float("nan"), at(6), 7)]) == {("a", 1): 5.0}
    assert feed(spark, source, out, [("a", 2, 8.0, at(7), 8), ("b", 4, 1.0, at(7), 9)]) == {("a", 1): 5.0, ("a", 2): 8.0, ("b", 4): 1.0}
    # a whole stream is cleared; what is newer stays
    assert feed(spark, source, out, [("a", None, None, at(8), 10), ("a", 3, 1.5, at(9), 11)]) == {("a", 3): 1.5, ("b", 4): 1.0}
    # far behind the watermark nothing changes any more
    feed(spark, source, out, [("c", 1, 1.0, at(600), 12)])
    assert feed(spark, source, out, [("b", 1, 2.0, at(10), 13), ("b", 2, 2.0, at(601), 14)]) == {("a", 3): 1.5, ("b", 4): 1.0, ("c", 1): 1.0, ("b", 2): 2.0}


def test_stream_as_a_fold(spark, tmp_path):
    rng, model, cleared, seq = random.Random(5), {}, {}, 0
    for _ in range(3):
        rows = []
        for _ in range(200):
            seq += 1
            stream, node, value = rng.choice("ab"), rng.randrange(12), rng.choice([None, 1.0, 2.0, 3.0])
            if rng.random() < 0.02:
                node = value = None
            rows.append((stream, node, value, at(rng.randrange(9)), seq))
        for stream, node, value, when, number in rows:
            if node is None:
                cleared[stream] = max(cleared.get(stream, (START, 0)), (when, number))
            elif (when, number) > model.get((stream, node), (START, -1, 0))[:2]:
                model[stream, node] = (when, number, value)
        rng.shuffle(rows)
        found = feed(spark, str(tmp_path / "in"), str(tmp_path / "out"), rows)
        want = {k: v[2] for k, v in model.items() if v[2] is not None and v[:2] > cleared.get(k[0], (START, -1))}
        assert found == want


def test_id_map_as_a_dict(spark, tmp_path):
    known, rng = IdMap(spark, str(tmp_path / "ids")), random.Random(9)
    number, free, bound = {}, [], 0
    frame = lambda some: spark.createDataFrame([(x,) for x in some], "ext_id string").repartition(3)
    assert known.entries().collect() == [] and known.size() == 0
    for turn in range(6):
        some = [f"n{rng.randrange(60)}" for _ in range(25)]
        if turn % 3 == 1:
            gone = sorted((x for x in set(some) if x in number), key=number.get)
            free += [number.pop(x) for x in gone]
            known.remove(frame([*some, "unknown", None]))
        else:
            for x in sorted(set(some) - set(number)):
                if free:
                    number[x] = free.pop()
                else:
                    number[x], bound = bound, bound + 1
            known.add(frame([*some, *some[:3], None]))
        if turn == 3:
            known.compact()
        assert dict(map(tuple, IdMap(spark, known.path).entries().collect())) == number
    assert known.size() == len(number)
    asked = {r.ext_id: r.node_id for r in known.get(frame(["n1", "n2", "nowhere"])).collect()}
    assert asked == {x: number.get(x) for x in ("n1", "n2", "nowhere")}
    back = {r.node_id: r.ext_id for r in known.get_ids(spark.range(bound + 2).withColumnRenamed("id", "node_id")).collect()}
    assert back == {i: next((x for x, k in number.items() if k == i), None) for i in range(bound + 2)}
    copy = IdMap(spark, str(tmp_path / "copy"))
    copy.set(known.entries())
    assert dict(map(tuple, copy.entries().collect())) == number
    copy.set(spark.createDataFrame([("n1", 500), ("new", number[(other := next(x for x in number if x != "n1"))])], "ext_id string, node_id long"))
    moved = dict(map(tuple, copy.entries().collect()))
    assert moved["n1"] == 500 and moved["new"] == number[other] and other not in moved
    with pytest.raises(ValueError):
        copy.set(spark.createDataFrame([("x", 1), ("x", 2)], "ext_id string, node_id long"))
    known.clear()
    assert known.size() == 0
    known.add(frame(["b", "a"]))
    assert dict(map(tuple, known.entries().collect())) == {"a": 0, "b": 1}


def test_a_lost_change_leaves_the_versions_before(spark, tmp_path):
    known = IdMap(spark, str(tmp_path / "ids"))
    known.add(spark.createDataFrame([("a",)], "ext_id string"))
    (tmp_path / "ids" / "v2").mkdir()
    (tmp_path / "ids" / "v2" / "part-0.parquet").write_bytes(b"half written")
    assert dict(map(tuple, known.entries().collect())) == {"a": 0}
    known.add(spark.createDataFrame([("b",), ("a",)], "ext_id string"))
    assert dict(map(tuple, known.entries().collect())) == {"a": 0, "b": 1}
