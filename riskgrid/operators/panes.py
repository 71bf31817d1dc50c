"""Panes: mergeable partial states of right-closed windows on a grid.

The rows of a session fall into panes ``(t_p − step, t_p]``. A window
``(t − w, t]`` whose width is ``m`` steps is exactly the union of ``m`` panes, so
rows are reduced to one state per pane first (with map-side partial aggregation)
and only the states are copied to the windows that hold them. A dense session
costs its rows once, not once for each window.

A width of ``m`` steps and a rest ``r`` also covers the last ``r`` of the pane
before. Panes are therefore cut at the distinct rests of the widths asked for: a
row whose distance to the end of its pane is ``d`` lies in segment ``s``, the
number of rests ``≤ d``. Windows with no rest read whole panes.

States by category (or driver) are as many as the rows at worst, and each is copied to
every window that holds it. ``spread_by`` deals them by category and block of grid
points over as many tasks as keep the copies of a task few, so a group's copies meet in
the task that makes them: no copy is shuffled, and a task's memory does not grow.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions.time import US, ceil_div, floor_div
from riskgrid.operators.grid import K, LAST_K, ORIGIN
from riskgrid.session import written

PANE, SEG, BLOCK = "_pane", "_seg", "_block"
#: Copies that a task makes, and grid points in a block.
COPIES = 2_000_000
BLOCK_POINTS = 1024


def tasks_for(copies: DataFrame | float | None, df: DataFrame) -> int:
    """Tasks for so many copies (a number, or a table of one)."""
    n = copies.first()[0] if isinstance(copies, DataFrame) else copies
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-int(n or 0) // COPIES))


class Panes:
    """Panes of one grid for some window widths in seconds."""

    def __init__(self, interval_seconds: int, windows: Sequence[int]):
        self.step = interval_seconds * US
        self.rests = sorted({w * US % self.step for w in windows} - {0})

    def steps(self, window: int) -> tuple[int, int]:
        """Whole panes of a window, and the segments it reads of the pane before."""
        whole, rest = divmod(window * US, self.step)
        return whole, self.rests.index(rest) + 1 if rest else 0

    def last_step(self, window: int) -> int:
        """How many grid points after its pane's end a row can still be seen."""
        whole, parts = self.steps(window)
        return whole - 1 + (parts > 0)

    def pane_of(self, us: Column) -> Column:
        """Index of the first grid point at or after an instant; may be negative."""
        return ceil_div(us - F.col(ORIGIN), F.lit(self.step))

    def segment_of(self, us: Column, pane: Column) -> Column:
        rest = F.col(ORIGIN) + pane * F.lit(self.step) - us
        return reduce(lambda a, b: a + b, [(rest >= r).cast("int") for r in self.rests], F.lit(0))

    def place(self, rows: DataFrame, spec: DataFrame, keys: Sequence[str], us_col: str, reach: int) -> DataFrame:
        """Rows with their pane and segment; rows that no window of up to ``reach``
        seconds on the grid can hold are dropped, as are rows of sessions without grid."""
        j = rows.join(spec.select(*keys, ORIGIN, LAST_K), list(keys))
        j = j.withColumn(PANE, self.pane_of(F.col(us_col)))
        j = j.where((F.col(PANE) <= F.col(LAST_K)) & (F.col(PANE) + self.last_step(reach) >= 0))
        return j.withColumn(SEG, self.segment_of(F.col(us_col), F.col(PANE)))

    def _span(self, states: DataFrame, window: int, first: Column | None) -> DataFrame:
        """States with the first and last grid point whose window may hold them."""
        lo = F.greatest(F.col(PANE) if first is None else first, F.lit(0).cast("long"))
        hi = F.least(F.col(PANE) + self.last_step(window), F.col(LAST_K))
        return states.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_lo") <= F.col("_hi"))

    def spread(self, states: DataFrame, window: int) -> DataFrame:
        """Copy states (with ``LAST_K``) to the grid points whose window may hold them."""
        return self._span(states, window, None).withColumn(K, F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")

    def spread_by(self, states: DataFrame, window: int, by: Sequence[str], first: Column | None = None,
                  weight: Column | None = None, points: int | None = None) -> DataFrame:
        """``spread`` for states of the groups ``by``. Copies of a group and grid point are in
        one task; group them by ``by``, ``BLOCK`` and ``K`` to leave them there. A state may
        weigh as much as several; blocks may have fewer grid points, and have so few that
        windows of the heaviest states do not fill more than a task."""
        spans = self._span(states, window, first)
        spans = written(spans if weight is None else spans.withColumn("_weight", weight))
        each = F.lit(1) if weight is None else F.col("_weight")
        copies, heaviest = spans.agg(F.sum((F.col("_hi") - F.col("_lo") + 1) * each), F.max(each)).first()
        tasks, n = tasks_for(copies, spans), points or BLOCK_POINTS
        if weight is not None:
            spans, n = spans.drop("_weight"), max(1, min(n, int(COPIES / ((heaviest or 1) * (self.last_step(window) + 1)))))
        size = F.lit(n).cast("long")
        blocks = spans.withColumn(BLOCK, F.explode(F.sequence(floor_div("_lo", size), floor_div("_hi", size)))).repartition(tasks, *by, BLOCK)
        start = F.col(BLOCK) * size
        inside = F.sequence(F.greatest(F.col("_lo"), start), F.least(F.col("_hi"), start + size - 1))
        return blocks.withColumn(K, F.explode(inside)).drop("_lo", "_hi")

    def inside(self, window: int) -> Column:
        """Whether the state lies in the window of its copy's grid point."""
        whole, parts = self.steps(window)
        age = F.col(K) - F.col(PANE)
        return (age < whole) | ((age == whole) & (F.col(SEG) < parts)) if parts else age < whole
