"""What nodes reach: strong components, reached counts, closeness and betweenness, without the closure of all pairs."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import walks
from graphloom.operators.iterate import Pile, stored
from graphloom.operators.structure import running
from graphloom.operators.trees import tour
from graphloom.operators.walks import BITS
from graphloom.sources.graph import closed_edges

#: Sources whose rows are held at once.
BATCH = 1000
#: Registers of a sketch as a power of two: a standard error of 1.04 / 2 ** 6.
REGISTERS = 12


# Strong components


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Edges with each path through nodes of one edge in and one out replaced by one edge, those nodes with the ends of their path, and the circles among them.

    Pointers to the next node and to the one before double in each round, so that a path takes
    rounds as its length's logarithm. What still runs on then is a circle of its own and is
    named by its smallest node.
    """
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n"), F.first("src").alias("before")).where("n = 1").select("node_id", "before")
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"), F.first("dst").alias("after")).where("n = 1").select("node_id", "after")
    inner = stored(into.join(out, "node_id").select("node_id", "before", "after", F.col("node_id").alias("least")))
    n = inner.count()
    if not n:
        return edges, inner, None
    inside = stored(inner.select("node_id"))
    keys = inside.select(F.col("node_id").alias("k"), F.lit(True).alias("on"))
    state = inner
    for turn in itertools.count():
        hop = state.select(F.col("node_id").alias("k"), F.col("before").alias("b2"), F.col("after").alias("a2"), F.col("least").alias("l2"))
        state = state.join(hop.select(F.col("k").alias("before"), "b2"), "before", "left").join(hop.select(F.col("k").alias("after"), "a2", "l2"), "after", "left")
        state = stored(state.select("node_id", F.coalesce("b2", "before").alias("before"), F.coalesce("a2", "after").alias("after"), F.least("least", F.coalesce("l2", "least")).alias("least")))
        going = state.join(keys, F.col("after") == F.col("k"), "left_semi")
        if 2 ** (turn + 1) >= n or going.isEmpty():
            break
    on = state.join(keys, F.col("after") == F.col("k"), "left").select("node_id", "before", "after", "least", F.col("on").isNotNull().alias("on"))
    state = stored(on)
    paths, circles = state.where(~F.col("on")).drop("on"), state.where("on").select("node_id", F.col("least").alias("label"))
    kept = edges.join(inside, F.col("src") == F.col("node_id"), "left_anti").join(inside, F.col("dst") == F.col("node_id"), "left_anti")
    new = paths.where("before != after").select(F.col("before").alias("src"), F.col("after").alias("dst"))
    return stored(kept.union(new).distinct()), paths.select("node_id", "before", "after"), circles


def _flags(edges: DataFrame, pivots: DataFrame) -> DataFrame:
    """(node_id, pivot, way): what pivots reach forward (way 0) and what reaches them (1), both in the same rounds, one a step."""
    ways = stored(edges.select("src", "dst", F.lit(0).alias("way")).union(edges.select("dst", "src", F.lit(1))))
    seen = Pile(pivots.select("node_id", F.col("node_id").alias("pivot"), F.explode(F.array(F.lit(0), F.lit(1))).alias("way")))
    while not seen.last.isEmpty():
        front = seen.last.withColumnRenamed("node_id", "src")
        new = front.join(ways, ["src", "way"]).select(F.col("dst").alias("node_id"), "pivot", "way").distinct()
        seen.add(new.join(seen.all().select("node_id", "way"), ["node_id", "way"], "left_anti"))
    return seen.all()


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest id of a node's strongly connected component.

    In each round paths are contracted, nodes without edges in or out go as components of their
    own, and each part that is left takes a pivot, the node of most edges in times edges out.
    What the pivot reaches and what reaches it are found at once in all parts; both together
    are its component, and the other three sets are parts of their own, since no component lies
    across them. Rounds are few (about the logarithm of the nodes); each takes as many steps
    as its parts are wide once paths are contracted.
    """
    ids = stored(nodes.select("node_id").distinct())
    rest = stored(closed_edges(ids, edges.select("src", "dst").where("src != dst").distinct()))
    part, labels, paths = None, [], []
    for _ in itertools.count():
        rest, path, circles = _contracted(rest)
        if circles is not None:
            paths.append(path)
            labels.append(circles)
        ins = rest.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("ins"))
        outs = rest.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("outs"))
        core = stored(ins.join(outs, "node_id").select("node_id", (F.col("ins") * F.col("outs")).alias("weight")))
        rest = stored(rest.join(core, F.col("src") == F.col("node_id"), "left_semi").join(core, F.col("dst") == F.col("node_id"), "left_semi"))
        if rest.isEmpty():
            break
        core = core.withColumn("part", F.lit(0).cast("long")) if part is None else core.join(part, "node_id")
        pivots = stored(core.groupBy("part").agg(F.max(F.struct("weight", F.xxhash64("node_id").alias("h"), "node_id")).alias("m")).select(F.col("m.node_id").alias("node_id")))
        flags = _flags(rest, pivots).groupBy("node_id").agg(F.min("pivot").alias("pivot"), F.sum(F.col("way") + 1).alias("code"))
        split = stored(core.join(flags, "node_id", "left").select("node_id", "part", "pivot", F.coalesce("code", F.lit(0)).alias("code")))
        labels.append(split.where("code = 3").select("node_id", F.col("pivot").alias("label")))
        part = stored(split.where("code != 3").select("node_id", F.xxhash64("part", "code").alias("part")))
        a, b = (part.select(F.col("node_id").alias(end), F.col("part").alias(f"part_{end}")) for end in ("src", "dst"))
        rest = stored(rest.join(a, "src").join(b, "dst").where("part_src = part_dst").select("src", "dst"))
    found = ids.select("node_id", F.col("node_id").alias("label"))
    if labels:
        first, *others = labels
        for other in others:
            first = first.union(other)
        found = stored(ids.join(first, "node_id", "left").select("node_id", F.coalesce("label", "node_id").alias("label")))
    for path in reversed(paths):  # a node of a path shares its ends' component if they share one
        ends = [found.select(F.col("node_id").alias(end), F.col("label").alias(f"label_{end}")) for end in ("before", "after")]
        inner = path.join(ends[0], "before").join(ends[1], "after").where("label_before = label_after").select("node_id", F.col("label_before").alias("new"))
        found = stored(found.join(inner, "node_id", "left").select("node_id", F.coalesce("new", "label").alias("label")))
    least = found.groupBy("label").agg(F.min("node_id").alias("component"))
    return found.join(least, "label").select("node_id", "component")


# Reached counts


def batches(sources: DataFrame, batch: int = BATCH) -> Iterator[DataFrame]:
    """The ids in parts of about ``batch``, by hash: every id in one part."""
    n = sources.count()
    parts = math.ceil(n / batch)
    if parts < 2:
        yield sources
        return
    dealt = stored(sources.withColumn("_part", F.pmod(F.xxhash64("node_id", F.lit(17)), F.lit(parts))))
    for k in range(parts):
        yield dealt.where(F.col("_part") == k).drop("_part")


def condensed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, component), and the edges (src, dst) between components, each once."""
    of = stored(strong_components(nodes, edges))
    a, b = (of.select(F.col("node_id").alias(end), F.col("component").alias(f"c_{end}")) for end in ("src", "dst"))
    return of, stored(edges.select("src", "dst").join(a, "src").join(b, "dst").where("c_src != c_dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct())


def reached_counts(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, batch: int = BATCH) -> DataFrame:
    """(node_id, descendants): exactly how many other nodes each of ``sources`` (all nodes unless given) reaches; safe on cycles.

    In a forest these are sizes from one tour, in log rounds. Otherwise strong components
    are single nodes with weights, and the walk from sources, a batch at a time, sums the weights
    it meets: pairs are held for one batch only. ``reached_estimates`` needs no pairs.
    """
    chosen = (sources if sources is not None else nodes).select("node_id").distinct()
    own = stored(closed_edges(nodes, edges.select("src", "dst").where("src != dst").distinct()))
    if own.groupBy("dst").count().where("count > 1").isEmpty():
        try:
            sizes = tour(nodes.select("node_id").distinct().join(own.select(F.col("dst").alias("node_id"), F.col("src").alias("parent")), "node_id", "left"))
            return chosen.join(sizes.select("node_id", (F.col("size") - 1).alias("descendants")), "node_id")
        except ValueError:  # a circle
            pass
    of, between = condensed(nodes, own)
    weights = stored(of.groupBy("component").agg(F.count("*").alias("weight")))
    start = stored(chosen.join(of, "node_id").select(F.col("component").alias("node_id")).distinct())
    sums = None
    for some in batches(start, batch):
        seen = Pile(some.select(F.col("node_id").alias("source"), "node_id"))
        while not seen.last.isEmpty():
            new = seen.last.join(between, F.col("node_id") == F.col("src")).select("source", F.col("dst").alias("node_id")).distinct()
            seen.add(new.join(seen.all(), ["source", "node_id"], "left_anti"))
        one = seen.all().join(weights, F.col("node_id") == F.col("component")).groupBy("source").agg((F.sum("weight") - 1).alias("descendants"))
        if sums is None:
            sums = Pile(one)
        else:
            sums.add(one)
    return chosen.join(of, "node_id").join(sums.all(), F.col("component") == F.col("source")).select("node_id", "descendants")


def reached_estimates(nodes: DataFrame, edges: DataFrame, registers: int = REGISTERS) -> DataFrame:
    """(node_id, descendants): about how many other nodes a node reaches, with a standard error of 1.04 / 2 ** (registers / 2), 1.6 % unless given.

    Each strong component sends the sketch of the ids it holds to the components before it, those
    that grew in the round before only; rounds are the longest way between components. A row is a
    node and its sketch of at most 2 ** registers bytes: no pairs, and hubs are combined before
    the shuffle.
    """
    of, between = condensed(nodes, edges)
    state = stored(of.groupBy(F.col("component").alias("node_id")).agg(F.hll_sketch_agg("node_id", registers).alias("sketch")).select("node_id", "sketch", F.hll_sketch_estimate("sketch").alias("n"), F.lit(True).alias("grew")))
    while not (front := state.where("grew")).isEmpty():
        sent = front.select(F.col("node_id").alias("dst"), "sketch").join(between, "dst").groupBy(F.col("src").alias("node_id")).agg(F.hll_union_agg("sketch").alias("more"))
        both = state.join(sent, "node_id", "left").withColumn("all", F.when(F.col("more").isNull(), F.col("sketch")).otherwise(F.hll_union("sketch", "more")))
        state = stored(both.select("node_id", F.col("all").alias("sketch"), F.hll_sketch_estimate("all").alias("now"), "n").select("node_id", "sketch", F.greatest("now", "n").alias("n"), (F.col("now") > F.col("n")).alias("grew")))
    return of.join(state.select(F.col("node_id").alias("component"), "n"), "component").select("node_id", (F.col("n") - 1).alias("descendants"))


def root(nodes: DataFrame, edges: DataFrame, batch: int = BATCH) -> DataFrame:
    """The node without parents that reaches most with that number, of these the smallest id; the smallest id of all where every node has parents.

    Only nodes without parents are counted. Where they are more than ``batch``, estimates
    leave out those that are over six standard errors below the largest.
    """
    free = stored(nodes.select("node_id").distinct().join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti"))
    if free.isEmpty():
        free = stored(nodes.orderBy("node_id").limit(1).select("node_id"))
    elif free.count() > batch:
        about = stored(reached_estimates(nodes, edges).join(free, "node_id", "left_semi"))
        least = (about.agg(F.max("descendants")).first()[0] + 1) * (1 - 12 * 1.04 / 2 ** (REGISTERS / 2)) - 1
        free = stored(about.where(F.col("descendants") >= least).select("node_id"))
    return reached_counts(nodes, edges, free, batch).orderBy(F.desc("descendants"), "node_id").limit(1)


# Centralities


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node_id, distance, paths): least numbers of edges and how many shortest paths, from every source."""
    seen, turn = Pile(sources.select(F.col("node_id").alias("source"), "node_id", F.lit(0).alias("distance"), F.lit(1.0).alias("paths"))), 0
    while not seen.last.isEmpty():
        turn += 1
        new = seen.last.join(edges, F.col("node_id") == F.col("src")).groupBy("source", F.col("dst").alias("node_id")).agg(F.sum("paths").alias("paths"))
        seen.add(new.join(seen.all().select("source", "node_id"), ["source", "node_id"], "left_anti").withColumn("distance", F.lit(turn)))
    return seen.all()


def _packed(nodes: DataFrame) -> DataFrame:
    """(node_id, chunk, bit): nodes numbered in the order of their ids, ``BITS`` a chunk."""
    return running(nodes.select("node_id").distinct(), "node_id", F.lit(1)).select("node_id", F.floor(F.col("before") / BITS).cast("long").alias("chunk"), (F.col("before") % BITS).cast("int").alias("bit"))


def closeness(nodes: DataFrame, edges: DataFrame, batch: int | None = None) -> DataFrame:
    """(node_id, closeness): reached / sum of distances, scaled by the share of nodes reached; 0 if none. Exact.

    Components that fit a task are walked there (``walks.distance_sums``), so that neither pairs
    of source and node nor rounds of them are stored; larger ones, and all if ``batch`` is given,
    go by joins.
    """
    n, edges = nodes.count(), stored(closed_edges(nodes, edges.select("src", "dst").distinct()))
    if batch is not None:
        return _close(nodes, _joined_sums(nodes, edges, batch), n)
    at = walks.placed(edges, BITS // 4)
    sums = stored(walks.distance_sums(at, edges).where("r > 0").groupBy("node_id").agg(F.sum("r").alias("r"), F.sum("t").alias("t")))
    large = at.where("not fits").select("node_id")
    if not large.isEmpty():
        sums = sums.union(_joined_sums(large, stored(edges.join(large, F.col("src") == F.col("node_id"), "left_semi")), 1000 * BITS))
    return _close(nodes, sums, n)


def _joined_sums(nodes: DataFrame, edges: DataFrame, batch: int) -> DataFrame:
    """(node_id, r, t): how many nodes each reaches and the sum of its distances, where it reaches any.

    Walks of ``BITS`` sources go together, as bits of one long: a row is a node and the sources
    of a chunk that reach it first in this step. So a row stands for up to 64 pairs of source and
    node, pairs are only counted where they are, and ``batch`` sources go at a time.
    """
    dealt, sums = stored(_packed(nodes)), None
    last = (dealt.agg(F.max("chunk")).first()[0] or 0) + 1
    each = max(1, batch // BITS)
    for low in range(0, last, each):
        some = dealt.where(F.col("chunk").between(low, low + each - 1))
        own = F.expr("shiftleft(1L, bit)")
        first = stored(some.select("node_id", "chunk", own.alias("new"), F.lit(0).alias("distance")))
        seen, front, turn = first.select("node_id", "chunk", F.col("new").alias("seen")), first, 0
        met = Pile(first)
        while not front.isEmpty():
            turn += 1
            sent = front.select(F.col("node_id").alias("src"), "chunk", "new").join(edges, "src").groupBy(F.col("dst").alias("node_id"), "chunk").agg(F.bit_or("new").alias("sent"))
            both = stored(seen.join(sent, ["node_id", "chunk"], "full").select("node_id", "chunk", F.coalesce("seen", F.lit(0).cast("long")).alias("_s"), F.coalesce("sent", F.lit(0).cast("long")).alias("_n")).select("node_id", "chunk", F.col("_s").bitwiseOR(F.col("_n")).alias("seen"), F.col("_n").bitwiseAND(F.bitwise_not("_s")).alias("new"), F.lit(turn).alias("distance")))
            seen, front = both.select("node_id", "chunk", "seen"), met.add(both.where("new != 0"))
        bits = F.expr(f"filter(sequence(0, {BITS - 1}), b -> shiftright(new, b) & 1 = 1)")
        pairs = met.all().where("distance > 0").select("chunk", "distance", F.explode(bits).alias("bit"))
        one = pairs.groupBy("chunk", "bit").agg(F.count("*").alias("r"), F.sum("distance").alias("t")).join(some, ["chunk", "bit"]).select("node_id", "r", "t")
        if sums is None:
            sums = Pile(one)
        else:
            sums.add(one)
    return sums.all()


def _close(nodes: DataFrame, sums: DataFrame, n: int) -> DataFrame:
    return nodes.select("node_id").join(sums, "node_id", "left").select("node_id", F.coalesce(F.col("r") / F.col("t") * F.col("r") / max(n - 1, 1), F.lit(0.0)).alias("closeness"))


def closeness_estimates(nodes: DataFrame, edges: DataFrame, registers: int = REGISTERS) -> DataFrame:
    """(node_id, closeness) from sketches of the nodes within 1, 2, ... steps: each round a node takes its neighbours' sketches of the round before.

    Rounds are the longest distance; what a round adds is counted at its distance. Counts err as
    those of ``reached_estimates``, and no pairs are held.
    """
    n, links = nodes.count(), stored(closed_edges(nodes, edges.select("src", "dst").where("src != dst").distinct()))
    state = nodes.groupBy("node_id").agg(F.hll_sketch_agg("node_id", registers).alias("sketch"))
    state = stored(state.select("node_id", "sketch", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("t"), F.lit(True).alias("grew")))
    for turn in itertools.count(1):
        if state.where("grew").isEmpty():
            break
        sent = links.join(state.select(F.col("node_id").alias("dst"), "sketch"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.hll_union_agg("sketch").alias("more"))
        both = state.join(sent, "node_id", "left").withColumn("all", F.when(F.col("more").isNull(), F.col("sketch")).otherwise(F.hll_union("sketch", "more"))).withColumn("now", F.hll_sketch_estimate("all"))
        state = stored(both.select("node_id", F.col("all").alias("sketch"), F.greatest("n", "now").alias("n"), (F.col("t") + turn * F.greatest(F.col("now") - F.col("n"), F.lit(0))).alias("t"), (F.col("now") > F.col("n")).alias("grew")))
    return _close(nodes, state.where("t > 0").select("node_id", (F.col("n") - 1).alias("r"), "t"), n)


#: Pairs of source and node that a batch of betweenness holds, about.
PAIRS = 20_000_000


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, batch: int | None = None, pairs: int = PAIRS) -> DataFrame:
    """(node_id, betweenness): shares of shortest paths through a node, summed over pairs from ``sources`` (all nodes unless given). Exact.

    Components that fit a task are walked there (``walks.path_shares``), so that no pair of source
    and node is a row; larger ones, and all if ``batch`` is given, go by joins.
    """
    edges = stored(closed_edges(nodes, edges.select("src", "dst")))
    chosen = (sources if sources is not None else nodes).select("node_id")
    if batch is not None:
        sums = _joined_shares(edges, chosen, batch, pairs)
    else:
        at = walks.placed(edges)
        sums = stored(walks.path_shares(at, edges, chosen.distinct()))
        large = at.where("not fits").select("node_id")
        if not large.isEmpty():
            some = stored(edges.join(large, F.col("src") == F.col("node_id"), "left_semi"))
            sums = sums.union(_joined_shares(some, stored(chosen.join(large, "node_id", "left_semi")), BATCH, pairs))
    return nodes.select("node_id").join(sums.groupBy("node_id").agg(F.sum("betweenness").alias("betweenness")), "node_id", "left").na.fill(0.0, ["betweenness"])


def _joined_shares(edges: DataFrame, sources: DataFrame, batch: int, pairs: int) -> DataFrame:
    """(node_id, betweenness), a row for each node that a batch of sources meets; all pairs of a batch are rows.

    Sources come in the order of a hash: ``batch`` of them first, then as many at a time as hold
    about ``pairs`` pairs by what the batch before met, at most eight times as many as that.
    """
    sums = None
    order = F.struct(F.xxhash64("node_id", F.lit(17)).alias("h"), "node_id").alias("_at")
    dealt = stored(running(sources.select("node_id", order), "_at", F.lit(1)).select("node_id", "before"))
    total, begun = dealt.count(), 0
    while begun < max(total, 1):
        found = distances(edges, dealt.where(F.col("before").between(begun, begun + batch - 1)).select("node_id"))
        begun, batch = begun + batch, max(1, min(8 * batch, int(pairs * batch / max(found.count(), 1))))
        depth = found.agg(F.max("distance")).first()[0] or 0
        level = found.where(F.col("distance") == depth).withColumn("share", F.lit(0.0))
        shares = Pile(level.select("node_id", "source", "paths", "share"))
        for d in range(depth - 1, 0, -1):
            low = shares.last.select("source", F.col("node_id").alias("dst"), F.col("paths").alias("p2"), F.col("share").alias("s2"))
            up = low.join(edges, "dst").groupBy("source", F.col("src").alias("node_id")).agg(F.sum((1 + F.col("s2")) / F.col("p2")).alias("add"))
            here = found.where(F.col("distance") == d).join(up, ["source", "node_id"], "left")
            shares.add(here.withColumn("share", F.col("paths") * F.coalesce("add", F.lit(0.0))))
        one = (shares.all() if depth else shares.all().limit(0)).groupBy("node_id").agg(F.sum("share").alias("betweenness"))
        if sums is None:
            sums = Pile(one)
        else:
            sums.add(one)
    return sums.all()


def betweenness_estimates(nodes: DataFrame, edges: DataFrame, error: float = 0.02, doubt: float = 0.1, seed: int = 42, batch: int | None = None) -> DataFrame:
    """(node_id, betweenness) from a sample of sources, scaled up.

    By Hoeffding's bound ln(2 n / doubt) / (2 error ** 2) sources, taken by a seeded hash, are
    enough for all nodes' values to be within error * n * (n - 2) of the exact ones with a
    chance of 1 - doubt; where that is all of them, the values are exact.
    """
    n = nodes.count()
    k = math.ceil(math.log(2 * max(n, 1) / doubt) / (2 * error * error))
    if k >= n:
        return betweenness(nodes, edges, batch=batch)
    some = stored(nodes.select("node_id").orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(k))
    return betweenness(nodes, edges, some, batch).withColumn("betweenness", F.col("betweenness") * (n / k))
