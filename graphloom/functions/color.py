"""Colours: parsing, scales, blending, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour names that are understood.
NAMES = {"black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00", "cyan": "#00ffff", "magenta": "#ff00ff", "gray": "#808080", "grey": "#808080", "orange": "#ffa500", "purple": "#800080", "pink": "#ffc0cb", "brown": "#a52a2a", "lime": "#00ff00", "navy": "#000080", "teal": "#008080", "maroon": "#800000", "olive": "#808000", "silver": "#c0c0c0", "gold": "#ffd700", "transparent": "#00000000"}


def _struct(*parts: Column) -> Column:
    return F.struct(*[p.cast("double").alias(k) for p, k in zip(parts, "rgba", strict=True)])


def parse(text: Column) -> Column:
    """struct<r, g, b, a> of 0-1 from #rgb, #rrggbb, #rrggbbaa, rgb(), rgba() or a name; null for anything else."""
    t = F.lower(F.trim(text))
    name = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    t = F.coalesce(F.try_element_at(name, t), t)
    t = F.regexp_replace(t, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    byte = lambda at: F.conv(F.substring(t, at, 2), 16, 10).cast("double") / 255
    call = r"^rgba?\(\s*([0-9.]+)\s*,\s*([0-9.]+)\s*,\s*([0-9.]+)\s*(?:,\s*([0-9.]+)\s*)?\)$"
    part = lambda i: F.regexp_extract(t, call, i)
    return (
        F.when(t.rlike("^#[0-9a-f]{6}$"), _struct(byte(2), byte(4), byte(6), F.lit(1.0)))
        .when(t.rlike("^#[0-9a-f]{8}$"), _struct(byte(2), byte(4), byte(6), byte(8)))
        .when(t.rlike(call), _struct(*[part(i).try_cast("double") / 255 for i in (1, 2, 3)], F.coalesce(part(4).try_cast("double"), F.lit(1.0))))
    )


def to_hex(r: Column, g: Column, b: Column) -> Column:
    one = lambda c: F.lpad(F.hex(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255).cast("long")), 2, "0")
    return F.lower(F.concat(F.lit("#"), one(r), one(g), one(b)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return a + (b - a) * t


def normalise(value: Column, low: float, high: float) -> Column:
    """The place of a value in its domain, 0 to 1; 0 where the domain is empty."""
    if high == low:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def scale(t: Column, stops: list[tuple[float, tuple[float, float, float, float]]], opacity: float = 1.0) -> Column:
    """struct<r, g, b, a> between the stops around ``t``, alpha times opacity."""
    stops = sorted(stops)
    out = _struct(*[F.lit(float(v)) for v in stops[-1][1][:3]], F.lit(stops[-1][1][3] * opacity))
    for (a, ca), (b, cb) in reversed(list(zip(stops, stops[1:], strict=False))):
        k = (t - a) / (b - a) if b > a else F.lit(0.0)
        parts = [F.lit(float(x)) + (float(y) - float(x)) * k for x, y in zip(ca, cb, strict=True)]
        out = F.when(t <= b, _struct(*parts[:3], parts[3] * opacity)).otherwise(out)
    return F.when(t <= stops[0][0], _struct(*[F.lit(float(v)) for v in stops[0][1][:3]], F.lit(stops[0][1][3] * opacity))).otherwise(out)


def hsl_to_rgb(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    a = s * F.least(light, 1 - light)

    def part(n: int) -> Column:
        k = (n + h * 12) % 12
        return light - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))

    return part(0), part(8), part(4)


#: Blend modes as functions of a channel so far, the next one, and its alpha.
BLENDS = {
    "additive": lambda base, new, a: F.least(F.lit(1.0), base + new * a),
    "multiply": lambda base, new, a: base * (1 - a + new * a),
    "max": lambda base, new, a: F.greatest(base, new * a),
    "replace": lambda base, new, a: base * (1 - a) + new * a,
}


def blend(base: Column, layers: Column, mode: str) -> Column:
    """A channel after folding ``layers``, an array of struct<v, a> in order, over ``base``."""
    return F.aggregate(layers, base.cast("double"), lambda s, x: BLENDS[mode](s, x["v"], x["a"]))


# Scales of value streams, stops of (place, (r, g, b, a)).
STREAM_SCALES = {
    "error": [(0.0, (0, 0, 0, 0)), (0.5, (0.8, 0.2, 0.1, 0.5)), (1.0, (1, 0.1, 0.05, 1))],
    "warning": [(0.0, (0, 0, 0, 0)), (0.5, (0.9, 0.7, 0.1, 0.5)), (1.0, (1, 0.9, 0.2, 1))],
    "success": [(0.0, (0, 0, 0, 0)), (0.5, (0.2, 0.7, 0.3, 0.5)), (1.0, (0.3, 0.9, 0.4, 1))],
    "activity": [(0.0, (0, 0, 0, 0)), (0.5, (0.2, 0.5, 0.9, 0.5)), (1.0, (0.3, 0.7, 1, 1))],
    "importance": [(0.0, (0, 0, 0, 0)), (0.5, (0.5, 0.3, 0.8, 0.5)), (1.0, (0.7, 0.4, 1, 1))],
    "heat": [(0.0, (0.2, 0.4, 0.8, 0.3)), (0.33, (0.2, 0.8, 0.4, 0.5)), (0.66, (0.9, 0.8, 0.2, 0.7)), (1.0, (1, 0.2, 0.1, 1))],
}

# Scales of heat maps, stops of (place, (r, g, b)).
HEAT_SCALES = {
    "viridis": [(0.0, (0.267, 0.004, 0.329)), (0.25, (0.282, 0.140, 0.458)), (0.5, (0.127, 0.566, 0.551)), (0.75, (0.369, 0.789, 0.383)), (1.0, (0.993, 0.906, 0.144))],
    "plasma": [(0.0, (0.050, 0.030, 0.528)), (0.25, (0.416, 0.090, 0.643)), (0.5, (0.718, 0.214, 0.475)), (0.75, (0.951, 0.506, 0.146)), (1.0, (0.940, 0.975, 0.131))],
    "inferno": [(0.0, (0.001, 0.000, 0.014)), (0.25, (0.341, 0.062, 0.429)), (0.5, (0.735, 0.216, 0.330)), (0.75, (0.973, 0.558, 0.201)), (1.0, (0.988, 0.998, 0.645))],
    "magma": [(0.0, (0.001, 0.000, 0.014)), (0.25, (0.316, 0.071, 0.485)), (0.5, (0.716, 0.215, 0.475)), (0.75, (0.973, 0.462, 0.498)), (1.0, (0.987, 0.991, 0.750))],
    "cividis": [(0.0, (0.0, 0.135, 0.304)), (0.25, (0.255, 0.306, 0.420)), (0.5, (0.475, 0.478, 0.471)), (0.75, (0.757, 0.694, 0.424)), (1.0, (0.996, 0.910, 0.212))],
    "turbo": [(0.0, (0.190, 0.072, 0.232)), (0.2, (0.085, 0.532, 0.829)), (0.4, (0.133, 0.846, 0.549)), (0.6, (0.631, 0.926, 0.248)), (0.8, (0.978, 0.636, 0.144)), (1.0, (0.712, 0.110, 0.092))],
    "hot": [(0.0, (0.0, 0.0, 0.0)), (0.33, (1.0, 0.0, 0.0)), (0.66, (1.0, 1.0, 0.0)), (1.0, (1.0, 1.0, 1.0))],
    "cool": [(0.0, (0.0, 1.0, 1.0)), (1.0, (1.0, 0.0, 1.0))],
    "spectral": [(0.0, (0.620, 0.004, 0.259)), (0.2, (0.957, 0.427, 0.263)), (0.4, (0.996, 0.878, 0.545)), (0.5, (1.0, 1.0, 0.749)), (0.6, (0.902, 0.961, 0.596)), (0.8, (0.400, 0.761, 0.647)), (1.0, (0.369, 0.310, 0.635))],
    "coolwarm": [(0.0, (0.230, 0.299, 0.754)), (0.25, (0.553, 0.627, 0.903)), (0.5, (0.866, 0.866, 0.866)), (0.75, (0.914, 0.596, 0.478)), (1.0, (0.706, 0.016, 0.150))],
    "blues": [(0.0, (0.969, 0.984, 1.0)), (0.5, (0.392, 0.671, 0.847)), (1.0, (0.031, 0.188, 0.420))],
    "greens": [(0.0, (0.969, 0.988, 0.961)), (0.5, (0.455, 0.769, 0.463)), (1.0, (0.0, 0.392, 0.0))],
    "reds": [(0.0, (1.0, 0.961, 0.941)), (0.5, (0.984, 0.416, 0.290)), (1.0, (0.502, 0.0, 0.0))],
    "grayscale": [(0.0, (0.0, 0.0, 0.0)), (1.0, (1.0, 1.0, 1.0))],
}


def gradient(low: tuple[float, float, float, float], high: tuple[float, float, float, float]) -> list[tuple[float, tuple[float, float, float, float]]]:
    return [(0.0, low), (1.0, high)]


def heat_scale(name: str) -> list[tuple[float, tuple[float, float, float, float]]]:
    return [(at, (*rgb, 1.0)) for at, rgb in HEAT_SCALES[name]]


def with_alpha(c: Column, alpha: float) -> Column:
    return _struct(c["r"], c["g"], c["b"], F.lit(float(alpha)))
