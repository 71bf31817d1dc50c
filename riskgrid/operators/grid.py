"""Regular time grid per session (G1, G2) and the bounded explode onto it.

A grid is described by a small *spec* frame, one row per session:
``keys..., grid_origin_us, grid_last_k``; grid point ``k`` is at
``grid_origin_us + k * step``. The grid itself is ``keys..., grid_k, <ts_col>``.

``explode_to_grid`` is the workhorse for every bounded time window: a source
row at ``e`` is copied to exactly the grid points ``t`` with
``t - e ∈ [lo, hi]`` (at most ``(hi - lo) / step + 1`` of them), so windowed
aggregates become ``groupBy(keys, grid_k)`` with map-side partial aggregation.
No session-wide window, no theta join, and a hot session is spread over its
grid points.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions.time import US, ceil_div, floor_div, parse_us, ts_of, us_of

ORIGIN = "grid_origin_us"
LAST_K = "grid_last_k"
K = "grid_k"


def _bound_us(df: DataFrame, name: str):
    dt = df.schema[name].dataType.simpleString()
    if dt == "string":
        return parse_us(name)
    return us_of(name, df.schema[name].dataType)


def grid_spec(sessions: DataFrame, keys: Sequence[str], interval_seconds: int,
              start_col: str = "date_start", end_col: str = "date_end",
              carry: Sequence[str] = ()) -> DataFrame:
    """One row per session with grid origin and last index.

    Start/end may be timestamps or ISO strings. Sessions whose start or end is
    missing, or whose end precedes the start, get no grid (no rows)."""
    step = interval_seconds * US
    s = _bound_us(sessions, start_col)
    e = _bound_us(sessions, end_col)
    out = sessions.select(*keys, *carry, s.alias(ORIGIN), e.alias("_end_us"))
    out = out.where(F.col(ORIGIN).isNotNull() & F.col("_end_us").isNotNull() & (F.col("_end_us") >= F.col(ORIGIN)))
    return out.select(*keys, *carry, ORIGIN,
                      floor_div(F.col("_end_us") - F.col(ORIGIN), F.lit(step)).alias(LAST_K))


def build_grid(spec: DataFrame, keys: Sequence[str], interval_seconds: int,
               ts_col: str = "timestamp", carry: Sequence[str] = ()) -> DataFrame:
    """``start, start + step, …`` up to and including ``end`` when on
    the grid; origin is the session start, not an epoch-aligned floor."""
    step = interval_seconds * US
    g = spec.select(*keys, *carry, ORIGIN, F.explode(F.sequence(F.lit(0).cast("long"), F.col(LAST_K))).alias(K))
    return g.select(*keys, *carry, K, ts_of(F.col(ORIGIN) + F.col(K) * F.lit(step)).alias(ts_col))


def explode_to_grid(rows: DataFrame, spec: DataFrame, keys: Sequence[str], us_col: str,
                    interval_seconds: int, lo_us, hi_us) -> DataFrame:
    """Copy each row at ``us_col = e`` to every grid point ``t`` of its session
    with ``t - e ∈ [lo_us, hi_us]``; adds ``grid_k`` and ``grid_us``. The
    offsets are ints or per-row LONG columns.

    Rows of sessions without a grid are dropped. ``spec`` has one row per
    session, so the planner can broadcast it when its measured size allows."""
    step = interval_seconds * US
    j = rows.join(spec.select(*keys, ORIGIN, LAST_K), list(keys))
    e = F.col(us_col)
    lo = lo_us if isinstance(lo_us, Column) else F.lit(lo_us)
    hi = hi_us if isinstance(hi_us, Column) else F.lit(hi_us)
    k_lo = F.greatest(ceil_div(e + lo - F.col(ORIGIN), F.lit(step)), F.lit(0).cast("long"))
    k_hi = F.least(floor_div(e + hi - F.col(ORIGIN), F.lit(step)), F.col(LAST_K))
    j = j.withColumn("_klo", k_lo).withColumn("_khi", k_hi).where(F.col("_klo") <= F.col("_khi"))
    j = j.withColumn(K, F.explode(F.sequence(F.col("_klo"), F.col("_khi"))))
    return (j.withColumn("grid_us", F.col(ORIGIN) + F.col(K) * F.lit(step))
             .drop("_klo", "_khi", ORIGIN, LAST_K))


def grid_index_of(rows: DataFrame, spec: DataFrame, keys: Sequence[str], us_col: str,
                  interval_seconds: int, mode: str) -> DataFrame:
    """Attach one grid index per row: ``ceil`` = first grid point at or after
    the row (clipped at 0, dropped past the end); ``floor`` = last grid point at
    or before it (clipped at the end, dropped before the start)."""
    step = interval_seconds * US
    j = rows.join(spec.select(*keys, ORIGIN, LAST_K), list(keys))
    off = F.col(us_col) - F.col(ORIGIN)
    if mode == "ceil":
        k = F.greatest(ceil_div(off, F.lit(step)), F.lit(0).cast("long"))
        j = j.withColumn(K, k).where(F.col(K) <= F.col(LAST_K))
    elif mode == "floor":
        k = F.least(floor_div(off, F.lit(step)), F.col(LAST_K))
        j = j.withColumn(K, k).where(F.col(K) >= 0)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return j.withColumn("grid_us", F.col(ORIGIN) + F.col(K) * F.lit(step)).drop(ORIGIN, LAST_K)


DAY_US = 86400 * US


def assign_sessions(rows: DataFrame, spec: DataFrame, keys: Sequence[str], us_col: str, interval_seconds: int,
                    before_us: int, after_us: int) -> DataFrame:
    """Attach session keys to rows that have none (a table that applies to
    every session): a row belongs to each session whose grid span, widened by
    ``before_us`` / ``after_us``, contains it. Sessions are exploded over the
    days their widened span covers and joined to rows on the day — a bucketed
    range join, never a cross join."""
    step = interval_seconds * US
    lo = F.col(ORIGIN) - F.lit(before_us)
    hi = F.col(ORIGIN) + F.col(LAST_K) * F.lit(step) + F.lit(after_us)
    days = spec.select(*keys, lo.alias("_lo"), hi.alias("_hi"),
                       F.explode(F.sequence(floor_div(lo, F.lit(DAY_US)), floor_div(hi, F.lit(DAY_US)))).alias("_day"))
    r = rows.withColumn("_day", floor_div(F.col(us_col), F.lit(DAY_US)))
    j = r.join(days, "_day").where((F.col(us_col) >= F.col("_lo")) & (F.col(us_col) <= F.col("_hi")))
    return j.drop("_day", "_lo", "_hi")
