"""Concave hulls: outlines of the cells that communities occupy, traced in parts and joined at the parts' borders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.iterate import stored

#: Cells along a side of a part; a part has at most twice their square as sides of outlines.
PART = 128
#: Where a side of a direction leads: east, north, west, south.
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))

_EDGE = "struct<x:long,y:long,d:int>"
_TRACED = f"community long, head {_EDGE}, pos long, x long, y long, turn boolean, low {_EDGE}, to {_EDGE}, n long"


def occupied(points: DataFrame, side: float) -> DataFrame:
    """(community, a, b): the cells of width ``side`` that hold a member. Rows without a community or finite place are left out."""
    finite = F.col("community").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))  # NaN is above infinity
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    return points.where(finite).select(F.col("community").cast("long").alias("community"), cell("x").alias("a"), cell("y").alias("b")).distinct()


def closed(cells: DataFrame, reach: int) -> DataFrame:
    """Cells grown by ``reach`` cells on all sides and shrunk again, one axis after the other: gaps narrower than twice that close, and no cell is lost."""
    steps, all_ = F.sequence(F.lit(-reach), F.lit(reach)), 2 * reach + 1
    moved = lambda df, c: df.withColumn("_s", F.explode(steps)).withColumn(c, F.col(c) + F.col("_s")).drop("_s")
    for axis in ("a", "b"):
        cells = moved(cells, axis).distinct()
    for axis in ("a", "b"):
        cells = moved(cells, axis).groupBy("community", "a", "b").agg(F.count("*").alias("_n")).where(F.col("_n") == all_).drop("_n")
    return cells


def sides(cells: DataFrame) -> DataFrame:
    """(community, x, y, d): the sides that cells (community, a, b) don't share with another, from their first corner, with the cell on the left."""
    a, b = F.col("a"), F.col("b")
    side = lambda x, y, d, flat, kx, ky: F.struct(x.alias("x"), y.alias("y"), F.lit(d).alias("d"), F.lit(flat).alias("flat"), kx.alias("kx"), ky.alias("ky"))
    four = F.array(side(a, b, 0, True, a, b), side(a + 1, b, 1, False, a + 1, b), side(a + 1, b + 1, 2, True, a, b + 1), side(a, b + 1, 3, False, a, b))
    rows = cells.select("community", F.explode(four).alias("s")).select("community", "s.*")
    return rows.groupBy("community", "flat", "kx", "ky").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("x", "y", "d")]).where("_n = 1").select("community", "x", "y", "d")


def followers(rows: DataFrame) -> DataFrame:
    """``rows`` of sides with ``nx, ny, nd``, the side that each leads to. Where two cells meet at a corner alone the outline turns right, so that they are one shape; a corner begins two sides at most."""
    step = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in STEPS]), F.col("d") + 1)
    ends = rows.withColumns({"nx": F.col("x") + step(0), "ny": F.col("y") + step(1)})
    begun = rows.groupBy("community", F.col("x").alias("nx"), F.col("y").alias("ny")).agg(F.min("d").alias("_d1"), F.max("d").alias("_d2"))
    right = F.pmod(F.col("d") - 1, F.lit(4))
    return ends.join(begun, ["community", "nx", "ny"]).withColumn("nd", F.when((F.col("_d1") == right) | (F.col("_d2") == right), right).otherwise(F.col("_d1"))).drop("_d1", "_d2")


def _chains(group: pd.DataFrame) -> pd.DataFrame:
    """A part's sides as chains: rows for the corners where they turn and for each chain's last side."""
    here = list(zip(group["x"].tolist(), group["y"].tolist(), group["d"].tolist(), strict=True))
    after = dict(zip(here, zip(group["nx"].tolist(), group["ny"].tolist(), group["nd"].tolist(), strict=True), strict=True))
    led_to = set(after.values())
    open_ = sorted(after)
    community, out, seen = int(group["community"].iloc[0]), [], set()
    for head in [e for e in open_ if e not in led_to] + open_:  # what is left after the open chains are circles
        if head in seen:
            continue
        at, low, turns = head, head, 0
        while True:
            seen.add(at)
            low, to = min(low, at), after[at]
            turn, last = to[2] != at[2], to == head or to not in after
            if turn or last:
                out.append((community, head, turns, to[0], to[1], turn, low if last else None, to if last else None, turns + turn if last else None))
            turns += turn
            if last:
                break
            at = to
    frame = pd.DataFrame(out, columns=["community", "head", "pos", "x", "y", "turn", "low", "to", "n"])
    for c in ("head", "low", "to"):
        frame[c] = [None if e is None else dict(zip("xyd", e, strict=True)) for e in frame[c]]
    return frame.astype({"n": "Int64"})


def _all(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for more in tables[1:]:
        whole = whole.union(more)
    return whole


def _named(chains: DataFrame) -> DataFrame:
    """``least``: the least side of each chain's ring. Pointers double in each round, so that rounds are the logarithm of a ring's chains."""
    state = stored(chains.select("community", "head", "to", F.col("low").alias("least")))
    while True:
        other = state.select("community", F.col("head").alias("to"), F.col("to").alias("_beyond"), F.col("least").alias("_l"))
        less = F.col("_l") < F.col("least")
        state = stored(state.join(other, ["community", "to"]).select("community", "head", F.col("_beyond").alias("to"), F.when(less, F.col("_l")).otherwise(F.col("least")).alias("least"), less.alias("_moved")))
        if state.where("_moved").isEmpty():  # a window of all rings' chains has their least
            return state.select("community", "head", "least")
        state = state.drop("_moved")


def _ranked(chains: DataFrame) -> DataFrame:
    """(community, head, least, before): the corners of a ring before each chain, counted from the chain with its least side by doubling pointers to the chain before. Chains that are done leave the joins' key, so that no key is hot."""
    prior = chains.select("community", F.col("to").alias("head"), F.col("head").alias("to"), F.col("n").alias("before"))
    rows = stored(chains.select("community", "head", "low", "least").join(prior, ["community", "head"]))
    begins = F.col("low") == F.col("least")
    done = [rows.where(begins).select("community", "head", "least", F.lit(0).cast("long").alias("before"))]
    ahead = rows.where(~begins).select("community", "head", "least", "to", "before")
    none = F.lit(None).cast(_EDGE)
    while not ahead.isEmpty():
        known = _all(done).select("community", "head", none.alias("to"), "before").union(ahead.select("community", "head", "to", "before"))
        other = known.select("community", F.col("head").alias("to"), F.col("to").alias("_beyond"), F.col("before").alias("_b"))
        jumped = stored(ahead.join(other, ["community", "to"]).select("community", "head", "least", F.col("_beyond").alias("to"), (F.col("before") + F.col("_b")).alias("before")))
        done.append(jumped.where("to is null").drop("to"))
        ahead = jumped.where("to is not null")
    return _all(done)


def rings(cells: DataFrame, part: int = PART) -> DataFrame:
    """(community, ring_x, ring_y, hole, ord, x, y): the corners of all outlines of cells (community, a, b), in cells.

    Outer rings run counter-clockwise, holes clockwise; ``ring_x, ring_y`` is the ring's least
    corner and names it. Each part of ``part`` by ``part`` cells traces the chains of sides
    within it; chains are then joined over the parts' borders and numbered by doubling pointers.
    No task holds more than a part, however large a community is. Cells that touch, at corners
    included, share a ring. Without cells there are no rows.
    """
    tile = lambda c: F.floor(F.col(c) / part)
    edges = followers(stored(sides(cells)))
    traced = stored(edges.groupBy("community", tile("x").alias("_tx"), tile("y").alias("_ty")).applyInPandas(_chains, _TRACED))
    chains = stored(traced.where("to is not null").select("community", "head", "to", "low", "n"))
    ranked = _ranked(chains.join(_named(chains), ["community", "head"]))
    at = traced.where("turn").select("community", "head", "pos", "x", "y").join(ranked, ["community", "head"])
    return at.select("community", F.col("least.x").alias("ring_x"), F.col("least.y").alias("ring_y"), (F.col("least.d") == 1).alias("hole"), (F.col("before") + F.col("pos")).alias("ord"), "x", "y")


def concave_hulls(points: DataFrame, longest: float = 50.0, reach: int = 2, holes: bool = False) -> DataFrame:
    """(community, ring_x, ring_y, hole, ord, x, y): outlines around each community's members (community, x, y).

    Members lie in cells of ``longest / (2 * reach)``, and gaps between cells narrower than
    ``longest`` along an axis close; parts that are farther apart have rings of their own. All
    members lie within. ``longest`` is the concavity: smaller ones follow the members more
    closely. ``holes`` adds the rings of holes. A lone member has its cell as outline, repeated
    members count once, rows without a community or finite place are left out, an empty table
    gives no rows, other columns are ignored.
    """
    if not longest > 0 or reach < 1:
        raise ValueError("longest must be above 0 and reach 1 or more")
    side = longest / (2 * reach)
    found = rings(closed(occupied(points, side), reach))
    scaled = found.withColumns({c: F.col(c) * side for c in ("ring_x", "ring_y", "x", "y")})
    return scaled if holes else scaled.where("not hole")


def measures(corners: DataFrame) -> DataFrame:
    """(community, outer, holes, corners, area, perimeter) of outlines; areas of holes count below zero. Sums over corners and those that follow them, met by their numbers."""
    key = ["community", "ring_x", "ring_y"]
    sizes = corners.groupBy(*key).agg(F.count("*").alias("_n"))
    numbered = corners.join(sizes, key)
    ahead = numbered.select(*key, F.pmod(F.col("ord") - 1, F.col("_n")).alias("ord"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    both = corners.join(ahead, [*key, "ord"])
    cross: Column = (F.col("x") * F.col("_y") - F.col("_x") * F.col("y")) / 2
    long = F.abs(F.col("x") - F.col("_x")) + F.abs(F.col("y") - F.col("_y"))
    return both.groupBy("community").agg(F.count_if((F.col("ord") == 0) & ~F.col("hole")).alias("outer"), F.count_if((F.col("ord") == 0) & F.col("hole")).alias("holes"), F.count("*").alias("corners"), F.sum(cross).alias("area"), F.sum(long).alias("perimeter"))
