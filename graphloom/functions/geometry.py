"""Viewport transforms, curves and waves as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SCALE, MAX_SCALE = 0.01, 100.0


@dataclass(frozen=True)
class Affine:
    """x' = a x + c y + e, y' = b x + d y + f."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 1.0
    e: float = 0.0
    f: float = 0.0

    def then(self, o: Affine) -> Affine:
        return Affine(o.a * self.a + o.c * self.b, o.b * self.a + o.d * self.b, o.a * self.c + o.c * self.d, o.b * self.c + o.d * self.d, o.a * self.e + o.c * self.f + o.e, o.b * self.e + o.d * self.f + o.f)

    def inverse(self) -> Affine | None:
        det = self.a * self.d - self.b * self.c
        if abs(det) < 1e-300:
            return None
        a, b, c, d = self.d / det, -self.b / det, -self.c / det, self.a / det
        return Affine(a, b, c, d, -(a * self.e + c * self.f), -(b * self.e + d * self.f))

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.a * x + self.c * y + self.e, self.b * x + self.d * y + self.f

    @staticmethod
    def scaling(s: float) -> Affine:
        return Affine(a=s, d=s)

    @staticmethod
    def shift(x: float, y: float) -> Affine:
        return Affine(e=x, f=y)

    @staticmethod
    def rotation(t: float) -> Affine:
        return Affine(math.cos(t), math.sin(t), -math.sin(t), math.cos(t))


@dataclass(frozen=True)
class Box:
    """A box, its sides included."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float

    def contains(self, x: Column, y: Column) -> Column:
        return x.between(self.min_x, self.max_x) & y.between(self.min_y, self.max_y)

    def expand(self, margin: float) -> Box:
        return Box(self.min_x - margin, self.min_y - margin, self.max_x + margin, self.max_y + margin)

    def middle(self) -> tuple[float, float]:
        return (self.min_x + self.max_x) / 2, (self.min_y + self.max_y) / 2

    def distance(self, x: Column, y: Column) -> Column:
        """How far a point is from the box, 0 within."""
        dx, dy = (F.greatest(F.lit(low) - v, F.lit(0.0), v - F.lit(high)) for v, low, high in ((x, self.min_x, self.max_x), (y, self.min_y, self.max_y)))
        return F.sqrt(dx * dx + dy * dy)

    def scale(self, width: float, height: float, padding: float = 0.0) -> float:
        """The scale at which the box fills a screen less its padding; 1 for a box without area."""
        w, h = self.max_x - self.min_x, self.max_y - self.min_y
        return 1.0 if w <= 0 or h <= 0 else min((width - 2 * padding) / w, (height - 2 * padding) / h)


@dataclass(frozen=True)
class Viewport:
    """A window of ``width`` by ``height`` pixels around (x, y) at a scale."""

    x: float = 0.0
    y: float = 0.0
    scale: float = 1.0
    width: float = 800.0
    height: float = 600.0

    def pan(self, dx: float, dy: float) -> Viewport:
        return Viewport(self.x - dx / self.scale, self.y - dy / self.scale, self.scale, self.width, self.height)

    def zoom(self, factor: float) -> Viewport:
        return Viewport(self.x, self.y, min(MAX_SCALE, max(MIN_SCALE, self.scale * factor)), self.width, self.height)

    def to_screen(self) -> Affine:
        return Affine.shift(-self.x, -self.y).then(Affine.scaling(self.scale)).then(Affine.shift(self.width / 2, self.height / 2))

    def box(self) -> Box:
        w, h = self.width / 2 / self.scale, self.height / 2 / self.scale
        return Box(self.x - w, self.y - h, self.x + w, self.y + h)

    def visible(self, x: Column, y: Column) -> Column:
        return self.box().contains(x, y)

    def level(self) -> float:
        """The zoom level: how often the scale of 1 was doubled."""
        return math.log2(self.scale)

    def fit(self, min_x: float, min_y: float, max_x: float, max_y: float, padding: float = 50.0) -> Viewport:
        w, h = max_x - min_x, max_y - min_y
        scales = [(side - 2 * padding) / length for side, length in ((self.width, w), (self.height, h)) if length > 0]
        return Viewport((min_x + max_x) / 2, (min_y + max_y) / 2, min(MAX_SCALE, max(MIN_SCALE, min(scales, default=1.0))), self.width, self.height)


def curve(t: Column, x1: Column, y1: Column, x2: Column, y2: Column, curvature: float, weight: float = 1.0) -> tuple[Column, Column]:
    """The rational quadratic curve at ``t`` whose control point lies off the middle by length times curvature."""
    cx, cy = (x1 + x2) / 2 - (y2 - y1) * curvature, (y1 + y2) / 2 + (x2 - x1) * curvature
    a, b, c = (1 - t) * (1 - t), 2 * weight * t * (1 - t), t * t
    return (a * x1 + b * cx + c * x2) / (a + b + c), (a * y1 + b * cy + c * y2) / (a + b + c)


def wave(kind: str, phase: Column, duty: float = 0.5) -> Column:
    """A wave of period 1 from 0 to 1."""
    p = phase - F.floor(phase)
    if kind == "square":
        return F.when(p < duty, 1.0).otherwise(0.0)
    if kind == "triangle":
        return 1 - F.abs(2 * p - 1)
    return 0.5 + 0.5 * F.sin(2 * math.pi * p)


def pulse(age: Column, duration: float) -> Column:
    """The brightness of a new node: decaying over three durations, then none."""
    return F.when((age >= 0) & (age < 3 * duration), F.exp(-age / duration)).otherwise(0.0)
