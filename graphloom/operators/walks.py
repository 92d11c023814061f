"""Walks from every node, inside tasks where a component fits one: Spark finds the components and deals their edges and sources out."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.analytics import weak_components
from graphloom.operators.iterate import stored

#: Nodes and edges of a component that a task holds.
HELD = 4_000_000
#: Nodes and edges of the small components that share a group, about.
SHARED = 5_000
#: Steps (a source times the nodes and edges around it) of a group, about, and groups that a component is dealt to at most.
WALKED, MOST = 50_000_000, 256
#: Steps that a task holds at a time, or one source's.
STEP = 500_000
#: Sources that one long holds as bits.
BITS = 64
#: Partitions of groups at most.
TASKS = 1000


def placed(edges: DataFrame, each: int = 1) -> DataFrame:
    """(node_id, fits, shared, bundle, parts), stored: where the ends of edges go.

    A component of up to ``HELD`` nodes and edges ``fits`` a task. Small ones go together, in
    bundles by hash; others are bundles of their own, whose sources are dealt to ``parts``
    groups by the steps that their walks take, where ``each`` sources cost as much as one walk.
    """
    ends = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("m")).union(edges.select("dst", F.lit(0))).groupBy("node_id").agg(F.sum("m").alias("m"))
    of = stored(ends.join(weak_components(ends.select("node_id"), edges), "node_id"))
    sizes = stored(of.groupBy("component").agg(F.count("*").alias("n"), (F.count("*") + F.sum("m")).alias("size")))
    shared = F.col("size") < SHARED
    bundles = math.ceil((sizes.where(shared).agg(F.sum("size")).first()[0] or 0) / SHARED) or 1
    parts = F.least(F.lit(MOST), F.ceil(F.col("n").cast("double") * F.col("size") / (each * WALKED)), "n").cast("int")
    plan = sizes.select("component", (F.col("size") <= HELD).alias("fits"), shared.alias("shared"), F.when(shared, F.pmod(F.xxhash64("component"), F.lit(bundles))).otherwise(F.col("component")).alias("bundle"), F.when(shared, F.lit(1)).otherwise(parts).alias("parts"))
    return stored(of.join(plan, "component").select("node_id", "fits", "shared", "bundle", "parts"))


def _grouped(at: DataFrame, edges: DataFrame, sources: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over each group of those that fit: all edges of its bundle, and its own sources as edges from a node to itself that are marked."""
    own = at.where("fits")
    away = edges.join(own.withColumnRenamed("node_id", "src"), "src").select("shared", "bundle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "src", "dst", F.lit(False).alias("source"))
    begun = sources.join(own, "node_id").select("shared", "bundle", F.pmod(F.xxhash64("node_id", F.lit(17)), F.col("parts")).cast("int").alias("part"), F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(True).alias("source"))
    groups = own.groupBy("shared", "bundle").agg(F.max("parts").alias("n")).agg(F.sum("n")).first()[0] or 1
    tasks = max(int(at.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups, TASKS))
    keys = ["shared", "bundle", "part"]
    return away.union(begun).repartition(tasks, *keys).groupBy(*keys).applyInArrow(run, schema)


class _Group:
    """A group's edges from numbered nodes, in the order of their beginnings, and its sources."""

    def __init__(self, table: pa.Table, back: bool = False):
        src, dst, source = (table.column(c).to_numpy() for c in ("src", "dst", "source"))
        self.ids, at = np.unique(np.concatenate([src, dst]).astype(np.int64), return_inverse=True)
        a, b = at[: len(src)], at[len(src) :]
        self.sources, self.n = a[source], len(self.ids)
        a, b = (b[~source], a[~source]) if back else (a[~source], b[~source])
        self.to, self.first = b[np.argsort(a, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(a, minlength=self.n))])
        self.slot = np.zeros(0, np.int64)

    def ahead(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where edges lead from ``keys`` (walk * n + node), and the place of the key that each comes from."""
        node = keys % self.n
        first = self.first[node]
        size = self.first[node + 1] - first
        place = np.repeat(np.arange(len(keys)), size)
        edge = np.arange(len(place)) + (first - np.cumsum(size) + size)[place]
        return (keys - node)[place] + self.to[edge], place

    def different(self, keys: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
        """The different ones of ``keys``, all below ``room``, and where each key is among them."""
        if len(self.slot) < room:
            self.slot = np.zeros(room, np.int64)
        turn = np.arange(len(keys))
        self.slot[keys] = turn
        found = keys[self.slot[keys] == turn]
        self.slot[found] = np.arange(len(found))
        return found, self.slot[keys]

    def walks(self, each: int) -> list[np.ndarray]:
        """The sources, in parts whose walks hold about ``STEP`` steps where ``each`` sources are one walk."""
        some = each * max(1, STEP // max(self.n + len(self.to), 1))
        return [self.sources[i : i + some] for i in range(0, len(self.sources), some)]


def _shares(group: _Group, some: np.ndarray) -> np.ndarray:
    """Each node's shares of shortest paths from ``some``: paths are counted away from the sources, shares summed on the way back."""
    room = len(some) * group.n
    distance, paths, share = np.full(room, -1, np.int32), np.zeros(room), np.zeros(room)
    level, levels = np.arange(len(some)) * group.n + some, []
    distance[level], paths[level] = 0, 1.0
    while len(level):
        levels.append(level)
        ends, place = group.ahead(level)
        new = distance[ends] < 0
        more = paths[level][place[new]]
        level, at = group.different(ends[new], room)
        paths[level], distance[level] = np.bincount(at, more, len(level)), len(levels)
    for depth in range(len(levels) - 2, 0, -1):
        ends, place = group.ahead(levels[depth])
        after = distance[ends] == depth + 1
        ends, place = ends[after], place[after]
        share[levels[depth]] = paths[levels[depth]] * np.bincount(place, (1 + share[ends]) / paths[ends], len(levels[depth]))
    return share.reshape(len(some), group.n).sum(0)


def path_shares(at: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node_id, betweenness): a row for each node of a group, its shares of the shortest paths from the group's sources."""

    def run(table: pa.Table) -> pa.Table:
        group = _Group(table)
        total = np.zeros(group.n)
        for some in group.walks(1):
            total += _shares(group, some)
        return pa.table({"node_id": group.ids, "betweenness": total})

    return _grouped(at, edges, sources, run, "node_id long, betweenness double")


def _sums(group: _Group, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``some`` each node is reached from, and the sum of their distances; ``BITS`` walks go together as bits of one long."""
    chunks = -(-len(some) // BITS)
    room = chunks * group.n
    seen, sent, number, total = np.zeros(room, np.uint64), np.zeros(room, np.uint64), np.zeros(group.n, np.int64), np.zeros(group.n, np.int64)
    turn = np.arange(len(some))
    level = turn // BITS * group.n + some
    bits, depth = np.left_shift(np.uint64(1), (turn % BITS).astype(np.uint64)), 0
    seen[level] = bits
    while len(level):
        depth += 1
        ends, place = group.ahead(level)
        np.bitwise_or.at(sent, ends, bits[place])
        level, _ = group.different(ends, room)
        bits = sent[level] & ~seen[level]
        sent[level] = 0
        level, bits = level[bits != 0], bits[bits != 0]
        seen[level] |= bits
        met = np.bincount(level % group.n, np.bitwise_count(bits), group.n).astype(np.int64)
        number += met
        total += depth * met
    return number, total


def distance_sums(at: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, r, t): a row for each node of a group, how many of the group's nodes it reaches and the sum of its distances to them.

    The walks go back over the edges, from the nodes reached, so that counts of bits are each node's own.
    """

    def run(table: pa.Table) -> pa.Table:
        group = _Group(table, back=True)
        number, total = np.zeros(group.n, np.int64), np.zeros(group.n, np.int64)
        for some in group.walks(BITS):
            more = _sums(group, some)
            number, total = number + more[0], total + more[1]
        return pa.table({"node_id": group.ids, "r": number, "t": total})

    return _grouped(at, edges, at.select("node_id"), run, "node_id long, r long, t long")
