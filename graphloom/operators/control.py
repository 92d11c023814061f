"""Control of iterative layouts: cooling, reheating, convergence, and a simulation over stored states. Scalars live on the driver, positions in Spark."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import forces
from graphloom.operators.iterate import stored


# Starting temperature, its target, where it counts as cold, and its decay a tick.
@dataclass
class Alpha:
    """The temperature of a layout: it nears its target each tick and is zero once below ``least``."""

    value: float = 1.0
    target: float = 0.0
    least: float = 0.001
    decay: float = 0.0002

    def tick(self) -> float:
        self.value += (self.target - self.value) * self.decay
        if self.value < self.least and self.target < self.least:
            self.value = 0.0
        return self.value

    def reheat(self, value: float = 1.0) -> None:
        self.value = max(self.value, value)

    @property
    def cold(self) -> bool:
        return self.value < self.least


def decay_for(ticks: int, start: float = 1.0, least: float = 0.001) -> float:
    """The decay with which ``start`` falls to ``least`` in a number of ticks."""
    return 1 - (least / start) ** (1 / max(ticks, 1))


def ticks_for(decay: float, start: float = 1.0, least: float = 0.001) -> int:
    """After how many ticks ``start`` is below ``least``."""
    return math.ceil(math.log(least / start) / math.log(1 - decay)) if 0 < decay < 1 else 0


@dataclass
class EnergyWindow:
    """Converged once the mean of the last ``size`` energies is below ``least``."""

    size: int = 10
    least: float = 1e-4
    seen: deque = field(default_factory=deque)

    def add(self, energy: float) -> bool:
        self.seen.append(energy)
        if len(self.seen) > self.size:
            self.seen.popleft()
        return len(self.seen) == self.size and sum(self.seen) / self.size < self.least


def adapted(alpha: float, energy: float, last: float | None) -> float:
    """A cool layout whose energy leaps is warmed by a tenth."""
    return min(1.0, alpha + 0.1) if last is not None and alpha < 0.5 and energy > 1.5 * last else alpha


@dataclass
class Still:
    """Converged once the largest move, a fifth of it a tick, is below ``least`` in ``checks`` checks in a row."""

    least: float = 0.15
    checks: int = 3
    every: int = 5
    held: int = 0

    def add(self, moved: float) -> bool:
        self.held = self.held + 1 if moved / self.every < self.least else 0
        return self.held >= self.checks


def largest_move(old: DataFrame, new: DataFrame) -> float:
    was = old.select("node_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    return new.join(was, "node_id").agg(F.max(F.sqrt(dx * dx + dy * dy))).first()[0] or 0.0


# Settings by name.
PRESETS: dict[str, dict] = {
    "default": {},
    "fast": {"theta": 1.2, "spring": 0.2, "damping": 0.3},
    "quality": {"theta": 0.5, "spring": 0.05, "damping": 0.5},
    "clustered": {"repulsion": 80.0, "length": 50.0, "center": 0.005},
    "dense": {"repulsion": 25.0, "length": 20.0},
    "sparse": {"repulsion": 80.0, "length": 80.0, "max_distance": 2000.0},
    "radial": {"center": 0.1, "repulsion": 35.0},
}


class Simulation:
    """A layout that is started, paused, reheated and ticked; each tick's rows are stored, so that no plan grows.

    ``state`` is the current table of points. While paused or cold, ticks change nothing.
    """

    def __init__(self, points: DataFrame, edges: DataFrame, model: str | None = None, config: forces.Config | None = None, alpha: Alpha | None = None, on_tick: Callable[[int, float], None] | None = None):
        self.state, self.edges = stored(points), edges
        self.model = model or forces.recommended(self.state.count())
        self.config, self.alpha, self.still = config or forces.Config(), alpha or Alpha(), Still()
        self.running, self.ticks, self.on_tick = False, 0, on_tick
        self.pinned: dict[int, tuple[float, float] | None] = {}
        self._checked = self.state

    def start(self) -> None:
        self.running = True

    def pause(self) -> None:
        self.running = False

    def stop(self) -> None:
        self.running, self.alpha.value = False, 0.0

    def restart(self, value: float = 1.0) -> None:
        self.alpha.value, self.still, self.running = value, Still(), True

    def set_alpha(self, value: float) -> None:
        self.alpha.value = min(1.0, max(0.0, value))

    def set_target(self, value: float) -> None:
        self.alpha.target = min(1.0, max(0.0, value))

    def set_config(self, **settings) -> None:
        self.config = forces.clamped(settings, self.config)

    def use(self, preset: str) -> None:
        self.set_config(**PRESETS[preset])

    def pin(self, node: int) -> None:
        self.pinned[node] = None

    def unpin(self, node: int) -> None:
        self.pinned.pop(node, None)

    def changed(self, points: DataFrame, edges: DataFrame, value: float = 0.3) -> None:
        """Go on from changed rows, warmed to ``value`` at least."""
        self.state, self.edges = stored(points), edges
        self._checked = self.state
        self.alpha.reheat(value)
        self.running = True

    def tick(self) -> bool:
        """One step; whether anything moved."""
        if not self.running or self.alpha.cold:
            return False
        hold = self.state.withColumn("_pinned", F.lit(False))
        if self.pinned:
            ids = self.state.sparkSession.createDataFrame([(i,) for i in self.pinned], "_id long")
            hold = self.state.join(ids, F.col("node_id") == F.col("_id"), "left").withColumn("_pinned", F.col("_id").isNotNull()).drop("_id")
        moved = forces.integrate(hold, forces.MODELS[self.model](self.state, self.edges, self.config), self.config, self.alpha.value, "_pinned").drop("_pinned")
        self.state = stored(moved)
        self.alpha.tick()
        self.ticks += 1
        if self.ticks % self.still.every == 0:
            if self.still.add(largest_move(self._checked, self.state)):
                self.alpha.value = 0.0
            self._checked = self.state
        if self.on_tick:
            self.on_tick(self.ticks, self.alpha.value)
        return True

    def run(self, ticks: int) -> DataFrame:
        self.start()
        for _ in range(ticks):
            if not self.tick():
                break
        return self.state
