"""Styles by precedence, selections and visible labels."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.iterate import stored


def styled(items: DataFrame, types: DataFrame, own: DataFrame, columns: list[str], key: str, kind: str = "type") -> DataFrame:
    """``columns`` of each item from its own values, else its type's, else what it has; NaN counts as absent."""
    t = types.select(kind, *[F.col(c).alias(f"_t_{c}") for c in columns])
    o = own.select(key, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"_o_{c}") for c in columns])
    out = items.join(t, kind, "left").join(o, key, "left")
    return out.withColumns({c: F.coalesce(f"_o_{c}", f"_t_{c}", c) for c in columns}).drop(*[f"_{x}_{c}" for c in columns for x in "to"])


def select_also(selection: DataFrame, more: DataFrame, key: str = "node_id") -> DataFrame:
    return selection.select(key).union(more.select(key)).distinct()


def deselect(selection: DataFrame, gone: DataFrame, key: str = "node_id") -> DataFrame:
    return selection.select(key).join(gone.select(key), key, "left_anti")


def add_labels(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The label table (node_id, text, priority, round) with the rows of ``more`` (node_id, text, priority) as a next round; a node may have several labels. An empty table is what ``labels.limit(0)`` or ``set_labels`` of no rows gives."""
    last = labels.agg(F.coalesce(F.max("round"), F.lit(-1)).alias("_last"))
    return labels.unionByName(more.crossJoin(F.broadcast(last)).withColumn("round", (F.col("_last") + 1).cast("int")).drop("_last"))


def set_labels(more: DataFrame) -> DataFrame:
    """A label table (node_id, text, priority, round) that holds only the rows of ``more``."""
    return more.withColumn("round", F.lit(0).cast("int"))


def remove_labels(labels: DataFrame, gone: DataFrame) -> DataFrame:
    """The label table without all labels of the nodes of ``gone``."""
    return labels.join(gone.select("node_id").distinct(), "node_id", "left_anti").select(*labels.columns)


def by_priority(labels: DataFrame) -> DataFrame:
    """Labels in the order in which they are drawn: the highest priority first, earlier rounds before later ones, then by id."""
    return labels.orderBy(F.desc_nulls_last("priority"), "round", "node_id", "text")


def visible_labels(labels: DataFrame, zoom: float, box: tuple[float, float, float, float], cell: float = 50.0, most: int = 1000, least_zoom: float = 0.3) -> DataFrame:
    """Labels (node_id, text, priority, x, y, min_zoom, max_zoom) to draw: in view, one for each screen cell by priority, ``most`` in all.

    The best label of a cell is a maximum a cell; the cap is the feature, a top-k.
    """
    if zoom < least_zoom:
        return labels.limit(0)
    shown = labels.where((F.coalesce("min_zoom", F.lit(0.0)) <= zoom) & (F.coalesce("max_zoom", F.lit(float("inf"))) >= zoom) & F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))
    cells = shown.withColumns({"cx": F.floor(F.col("x") * zoom / cell), "cy": F.floor(F.col("y") * zoom / cell)})
    best = cells.groupBy("cx", "cy").agg(F.max(F.struct("priority", (-F.col("node_id")).alias("o"), "text", "x", "y")).alias("m"))
    return best.select((-F.col("m.o")).alias("node_id"), "m.text", "m.priority", "m.x", "m.y").orderBy(F.desc("priority"), "node_id").limit(most)


def free_labels(labels: DataFrame, zoom: float, view: tuple[float, float, float, float], widths: DataFrame, font: float = 14.0, padding: float = 4.0, cell: float = 50.0, most: int = 1000, least_zoom: float = 0.3) -> DataFrame:
    """Labels (node_id, text, priority, x, y, min_zoom, max_zoom) to draw, each with its text's box (left, top, width, height) on the screen.

    ``view`` is the middle in graph units and the screen's width and height. Labels go by
    priority, then id; one is drawn if no drawn label before it takes a screen cell that its
    padded box touches. That order is followed in rounds: labels first in all their cells are
    drawn, those that share a cell with a drawn one go, and the rest meet again; every
    round is a minimum a cell, so no task sees all labels. ``widths`` has (node_id, width).
    The cap is the feature, a top-k.
    """
    mx, my, wide, high = view
    if zoom < least_zoom:
        return labels.limit(0).select("node_id", "priority", *[F.lit(0.0).alias(c) for c in ("left", "top", "width", "height")])
    sx, sy = (F.col("x") - mx) * zoom + wide / 2, (F.col("y") - my) * zoom + high / 2
    ranges = (F.coalesce("min_zoom", F.lit(0.0)) <= zoom) & (F.coalesce("max_zoom", F.lit(float("inf"))) >= zoom)
    shown = labels.where(ranges & F.col("x").between(mx - wide / 2 / zoom, mx + wide / 2 / zoom) & F.col("y").between(my - high / 2 / zoom, my + high / 2 / zoom))
    boxes = shown.join(widths, "node_id").select("node_id", "priority", (sx - F.col("width") / 2).alias("left"), (sy + 10).alias("top"), "width", F.lit(font * 1.2).alias("height"))
    boxes = stored(boxes.withColumn("rank", F.struct((-F.col("priority")).alias("p"), "node_id")))
    span = lambda low, length: F.sequence(F.floor((F.col(low) - padding) / cell), F.floor((F.col(low) + F.col(length) + padding) / cell))
    open_ = stored(boxes.withColumn("cx", F.explode(span("left", "width"))).withColumn("cy", F.explode(span("top", "height"))).select("node_id", "rank", "cx", "cy"))
    drawn = None
    while not open_.isEmpty():
        first = open_.groupBy("cx", "cy").agg(F.min("rank").alias("first"))
        met = open_.join(first, ["cx", "cy"])
        won = stored(met.groupBy("node_id").agg(F.min((F.col("rank") == F.col("first")).cast("int")).alias("all")).where("all = 1").select("node_id"))
        drawn = won if drawn is None else drawn.union(won)
        taken = open_.join(won, "node_id", "left_semi").select("cx", "cy").distinct()
        gone = open_.join(taken, ["cx", "cy"], "left_semi").select("node_id").distinct()
        open_ = stored(open_.join(gone, "node_id", "left_anti"))
    if drawn is None:
        return boxes.drop("rank")
    return boxes.join(drawn, "node_id", "left_semi").drop("rank").orderBy(F.desc("priority"), "node_id").limit(most)


def default_priorities(nodes: DataFrame, slots: DataFrame) -> DataFrame:
    """(node_id, priority): 1 for the first node falling to 0 by ``slots`` (node_id, slot)."""
    n = slots.agg(F.count("*").alias("n"))
    return nodes.select("node_id").join(slots, "node_id").crossJoin(F.broadcast(n)).select("node_id", (1 - F.col("slot") / F.col("n")).alias("priority"))


def put_styles(styles: DataFrame, more: DataFrame, kind: str = "type") -> DataFrame:
    """A table of type styles with the rows of ``more`` in place of theirs."""
    return styles.join(more.select(kind), kind, "left_anti").unionByName(more, allowMissingColumns=True)


def drop_styles(styles: DataFrame, kinds: list[str], kind: str = "type") -> DataFrame:
    return styles.where(~F.col(kind).isin(kinds))


def text_width(texts: DataFrame, advances: dict[str, float], kerning: dict[tuple[str, str], float], key: str = "node_id", text: str = "text") -> DataFrame:
    """(key, width): advances and kernings of the text's characters, summed in the JVM; unknown ones add nothing, a null or empty text has width 0."""
    table = lambda rows: F.create_map(*[F.lit(v) for k, x in rows.items() for v in (k, float(x))]) if rows else None
    alone, pairs = table(advances), table({a + b: x for (a, b), x in kerning.items()})
    value = lambda known, k: F.lit(0.0) if known is None else F.coalesce(F.try_element_at(known, k), F.lit(0.0))
    whole = F.coalesce(F.col(text), F.lit(""))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(whole), F.lit(1))), lambda i: i <= F.char_length(whole))
    width = F.aggregate(places, F.lit(0.0), lambda total, i: total + value(alone, F.substring(whole, i, F.lit(1))) + F.when(i < F.char_length(whole), value(pairs, F.substring(whole, i, F.lit(2)))).otherwise(0.0))
    return texts.select(key, width.alias("width"))
