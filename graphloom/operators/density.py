"""Density grids, contours and Morton order over points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.color import normalise, scale
from graphloom.operators.spatial import cell


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    return t * t * (3 - 2 * t)


def kde(points: DataFrame, size: float, radius: float, intensity: float = 0.1) -> DataFrame:
    """(cx, cy, density) of cells ``size`` wide: each point splats exp(-2u)(1 - smoothstep(.3, 1, u)), u = d^2 / radius^2 up to 1.2, at cell centres."""
    reach = int(radius * 1.2**0.5 // size) + 1
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    rows = points.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps)).withColumns({"cx": F.col("_a") + cell("x", size), "cy": F.col("_b") + cell("y", size)})
    dx, dy = (F.col("cx") + 0.5) * size - F.col("x"), (F.col("cy") + 0.5) * size - F.col("y")
    rows = rows.withColumn("u", (dx * dx + dy * dy) / (radius * radius)).where("u <= 1.2")
    return rows.groupBy("cx", "cy").agg(F.sum(intensity * F.exp(-2 * F.col("u")) * (1 - smoothstep(0.3, 1.0, F.col("u")))).alias("density"))


def density_gradient(grid: DataFrame, strength: float) -> DataFrame:
    """(cx, cy, fx, fy): minus half the central difference of the density, absent cells being 0."""
    side = lambda dx, dy, name: grid.select((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy"), F.col("density").alias(name))
    out = grid
    for dx, dy, name in ((1, 0, "w"), (-1, 0, "e"), (0, 1, "n"), (0, -1, "s")):
        out = out.join(side(dx, dy, name), ["cx", "cy"], "left")
    v = {k: F.coalesce(k, F.lit(0.0)) for k in "wens"}
    return out.select("cx", "cy", (-0.5 * strength * (v["e"] - v["w"])).alias("fx"), (-0.5 * strength * (v["s"] - v["n"])).alias("fy"))


def contour_bands(grid: DataFrame, thresholds: list[float], thickness: float = 1.0) -> DataFrame:
    """(cx, cy, threshold): cells whose share of the largest density is within 0.01 * thickness of a threshold."""
    top = grid.agg(F.max("density").alias("top"))
    rows = grid.crossJoin(F.broadcast(top)).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return rows.where(F.abs(F.col("density") / F.col("top") - F.col("threshold")) < 0.01 * thickness).select("cx", "cy", "threshold")


#: For each 4-bit case of a square the sides that segments join: 0 below, 1 right, 2 above, 3 left. The two saddles have two.
_SEGMENTS = {1: [(3, 0)], 2: [(0, 1)], 3: [(3, 1)], 4: [(1, 2)], 5: [(3, 2), (0, 1)], 6: [(0, 2)], 7: [(3, 2)], 8: [(2, 3)], 9: [(2, 0)], 10: [(3, 0), (1, 2)], 11: [(2, 1)], 12: [(1, 3)], 13: [(1, 0)], 14: [(0, 3)]}


def marching_squares(grid: DataFrame, thresholds: list[float], size: float = 1.0) -> DataFrame:
    """(threshold, cx, cy, x1, y1, x2, y2): the segments of the contours at shares of the largest density.

    Squares lie between the centres of four cells, absent ones being 0; a segment's ends lie
    where the density along a side passes the threshold.
    """
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    moved = F.explode(F.array(*[F.struct((F.col("cx") - dx).alias("sx"), (F.col("cy") - dy).alias("sy"), F.lit(i).alias("corner")) for i, (dx, dy) in enumerate(corners)]))
    top = grid.agg(F.max("density").alias("top"))
    part = lambda i: F.coalesce(F.sum(F.when(F.col("m.corner") == i, F.col("density"))), F.lit(0.0)).alias(f"d{i}")
    squares = grid.select("density", moved.alias("m")).groupBy(F.col("m.sx").alias("cx"), F.col("m.sy").alias("cy")).agg(*[part(i) for i in range(4)])
    rows = squares.crossJoin(F.broadcast(top)).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).withColumn("level", F.col("threshold") * F.col("top"))
    case = sum((F.when(F.col(f"d{i}") >= F.col("level"), 1 << i).otherwise(0) for i in range(1, 4)), F.when(F.col("d0") >= F.col("level"), 1).otherwise(0))
    rows = rows.withColumn("shape", case).where("shape > 0 and shape < 15")
    t = lambda i, j: (F.col("level") - F.col(f"d{i}")) / (F.col(f"d{j}") - F.col(f"d{i}"))
    half = F.lit(0.5)
    sides = [(half + t(0, 1), half), (half + 1, half + t(1, 2)), (half + t(3, 2), half + 1), (half, half + t(0, 3))]
    end = lambda s: (((F.col("cx") + sides[s][0]) * size), ((F.col("cy") + sides[s][1]) * size))
    none = F.array().cast("array<struct<x1: double, y1: double, x2: double, y2: double>>")
    found = none
    for shape, pairs in _SEGMENTS.items():
        parts = [F.struct(*[v.cast("double").alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), (*end(a), *end(b)), strict=True)]) for a, b in pairs]
        found = F.when(F.col("shape") == shape, F.array(*parts)).otherwise(found)
    return rows.select("threshold", "cx", "cy", F.explode(found).alias("s")).select("threshold", "cx", "cy", "s.*")


def colormap(grid: DataFrame, stops: list, low: float = 0.0, high: float = 1.0, opacity: float = 0.7) -> DataFrame:
    """(cx, cy, r, g, b, a): the colour of every cell with a density of 1e-4 or more; alpha fades with the root of the normalised density."""
    t = normalise(F.col("density"), low, high)
    rows = grid.where("density >= 1e-4").withColumn("_t", t).withColumn("_c", scale(F.col("_t"), stops))
    return rows.select("cx", "cy", "_c.r", "_c.g", "_c.b", (F.col("_c.a") * F.sqrt("_t") * opacity).alias("a"))


def lookup_table(spark: SparkSession, stops: list, samples: int = 256) -> DataFrame:
    """(i, r, g, b, a): a colour scale at evenly spaced places."""
    c = scale(F.col("i") / F.lit(float(samples - 1)), stops)
    return spark.range(samples).select(F.col("id").alias("i")).withColumn("_c", c).select("i", "_c.*")


def classify(field: DataFrame, zoom: float = 1.0, edge: float = 5.0, outline: float | None = None) -> DataFrame:
    """(cx, cy, kind, alpha): where a metaball field is drawn: inside, on its soft rim, or, if ``outline`` is a width, on the line around it."""
    d = F.col("field")
    if outline is not None:
        half = outline * 0.5 / zoom
        return field.where(F.abs(d) < half).select("cx", "cy", F.lit("outline").alias("kind"), (1 - F.abs(d) / half).alias("alpha"))
    rim = 2.0 / zoom
    alpha = F.when(d < 0, F.least(F.lit(1.0), -d / edge)).otherwise((1 - d / rim) * 0.3)
    return field.where(d < rim).select("cx", "cy", F.when(d < 0, "inside").otherwise("rim").alias("kind"), alpha.alias("alpha"))


def metaball(points: DataFrame, size: float, radius: float, blend: float) -> DataFrame:
    """(cx, cy, field): smooth minimum of the distances to discs of ``radius`` around points near a cell centre, folded in the order of their ids.

    The fold depends on its order, so the distances near one cell are held in one task.
    """
    reach = int((radius + blend) // size) + 1
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    rows = points.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps)).withColumns({"cx": F.col("_a") + cell("x", size), "cy": F.col("_b") + cell("y", size)})
    dx, dy = (F.col("cx") + 0.5) * size - F.col("x"), (F.col("cy") + 0.5) * size - F.col("y")
    near = rows.withColumn("d", F.sqrt(dx * dx + dy * dy) - radius).where(F.col("d") <= blend)
    ordered = near.groupBy("cx", "cy").agg(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "d"))), lambda s: s["d"]).alias("ds"))

    def smin(a: Column, b: Column) -> Column:
        h = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.5 * (b - a) / blend))
        return b * (1 - h) + a * h - blend * h * (1 - h)

    return ordered.select("cx", "cy", F.aggregate(F.slice("ds", F.lit(2), F.size("ds")), F.element_at("ds", 1), smin).alias("field"))


def _spread(v: Column) -> Column:
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(points: DataFrame) -> DataFrame:
    """(node_id, code): 16 bits of each axis within the box of all points, interleaved."""
    box = points.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1.0)).alias("extent"))
    q = lambda c, low: F.least(F.lit(65535), F.greatest(F.lit(0), F.floor((F.col(c) - F.col(low)) / F.col("extent") * 65535))).cast("long")
    return points.crossJoin(F.broadcast(box)).select("node_id", _spread(q("x", "min_x")).bitwiseOR(F.shiftleft(_spread(q("y", "min_y")), 1)).alias("code"))


def prefix_cells(codes: DataFrame, points: DataFrame, levels: int) -> DataFrame:
    """(prefix, mass, mx, my): points by the first ``levels`` pairs of bits of their code."""
    return codes.join(points, "node_id").groupBy(F.shiftright("code", 32 - 2 * levels).alias("prefix")).agg(F.count("*").alias("mass"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
