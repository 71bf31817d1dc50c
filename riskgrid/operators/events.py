"""Event detection and labels.

E1 — anchored merge: a matching message starts a new event when it is more
than ``merge_window`` after the last *emitted* event (not after the previous
message, so ``session_window`` does not apply). A key's events are the chain of
``next(i)`` = first instant more than the window after ``i``, from its first
instant on. The chain runs through time buckets of a bounded number of instants:

1. Inside a bucket every possible entry — an instant that can follow an event of
   an earlier bucket — gets the last event of its chain there (numpy).
2. That event's ``next`` lies in a later bucket: a strict forward as-of join
   gives pointers from entry to entry. Pointer doubling follows them from the
   key's first instant, in ``log2(buckets)`` join rounds.
3. Each bucket on the way lists its events from the entry taken.

E3 — forward labels: ``y = 1`` when the next event is in ``(t, t + h]`` and
``time_to_event = min(next − t, cap)`` (``cap`` when there is none). Computed
by a bounded explode of events onto the grid points that can see them.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.functions import constants as C
from riskgrid.functions.time import US, floor_div, ts_of, us_col
from riskgrid.operators.asof import asof_join
from riskgrid.operators.grid import K, explode_to_grid
from riskgrid.operators.ordered import auto_bucket_seconds
from riskgrid.session import ensure_checkpoint_dir


def detect_events(messages: DataFrame, keys: Sequence[str], ts_col: str = "date",
                  predicate: Column | None = None, merge_window_seconds: int = C.MERGE_WINDOW_S,
                  bucket_seconds: int | str = "auto", out_col: str = "event_ts") -> DataFrame:
    """One row per detected event start: ``keys…, event_us, <out_col>``.
    Messages with a NULL time or key never emit; messages at the same instant
    are one candidate. ``bucket_seconds`` sets task sizes, not results: ``"auto"``
    gives buckets of up to 200 000 instants, a second (at most a million
    microseconds) where even that holds more."""
    keys = list(keys)
    w = merge_window_seconds * US
    m = messages if predicate is None else messages.where(predicate)
    ensure_checkpoint_dir(m.sparkSession)
    cand = m.select(*keys, us_col(m, ts_col).alias("_u")).dropna().distinct().checkpoint()
    if bucket_seconds == "auto":
        bucket_seconds = auto_bucket_seconds(cand, keys, "_u", target_rows=200_000)
    width = int(bucket_seconds * US)
    d = cand.withColumn("_b", floor_div("_u", F.lit(width)))
    ptr = _entry_pointers(d, cand, keys, w, width)
    chosen = cand.groupBy(*keys).agg(F.min("_u").alias("_u"))
    ids = keys + ["_u"]
    while not ptr.isEmpty():
        # `chosen` holds the first 2^r entries of a key, `ptr` leads 2^r entries on;
        # entries without so many after them leave `ptr`
        step = chosen.join(ptr, ids).select(*keys, F.col("_nu").alias("_u"))
        chosen = chosen.unionByName(step).checkpoint()
        hop = ptr.select(*keys, F.col("_u").alias("_hu"), F.col("_nu").alias("_u"))
        ptr = hop.join(ptr, ids).select(*keys, F.col("_hu").alias("_u"), "_nu").checkpoint()
    entered = chosen.select(*keys, floor_div("_u", F.lit(width)).alias("_b"), F.col("_u").alias("_entry"))
    types = {f.name: f.dataType.simpleString() for f in cand.schema.fields}

    def chain(pdf):
        u = np.sort(pdf["_u"].to_numpy())
        nxt = np.searchsorted(u, u + w, side="right")
        out, i = [], int(np.searchsorted(u, pdf["_entry"].iat[0]))
        while i < len(u):
            out.append(i)
            i = int(nxt[i])
        return pdf[keys].iloc[[0] * len(out)].assign(event_us=u[out])

    ev = d.join(entered, keys + ["_b"]).groupBy(*keys, "_b").applyInPandas(
        chain, ", ".join([f"`{k}` {types[k]}" for k in keys] + ["event_us long"]))
    return ev.withColumn(out_col, ts_of("event_us"))


def _entry_pointers(d: DataFrame, cand: DataFrame, keys: list[str], w: int, width: int) -> DataFrame:
    """``keys…, _u, _nu``: possible entry of a bucket → entry of the next bucket
    its chain reaches. Events of earlier buckets lie before the bucket's start,
    so an entry is an instant less than ``w`` after the start, or the first later one."""
    types = {f.name: f.dataType.simpleString() for f in cand.schema.fields}

    def exits(pdf):
        u = np.sort(pdf["_u"].to_numpy())
        nxt = np.searchsorted(u, u + w, side="right")
        last = np.where(nxt < len(u), nxt, np.arange(len(u)))
        while True:
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        n = min(len(u), int(np.searchsorted(u, pdf["_b"].iat[0] * width + w)) + 1)
        return pdf[keys].iloc[[0] * n].assign(_u=u[:n], _last=u[last[:n]])

    links = d.groupBy(*keys, "_b").applyInPandas(
        exits, ", ".join([f"`{k}` {types[k]}" for k in keys] + ["_u long", "_last long"])).checkpoint()
    left = links.select(*keys, "_last", ts_of(F.col("_last") + F.lit(w)).alias("_q")).distinct()
    right = cand.select(*keys, ts_of("_u").alias("_q"), F.col("_u").alias("_nu"))
    onward = asof_join(left, right, on="_q", by=keys, direction="forward", allow_exact_matches=False,
                       bucket_seconds=width // US)
    return links.join(onward.where(F.col("_nu").isNotNull()).drop("_q"), keys + ["_last"]).select(
        *keys, "_u", "_nu").checkpoint()


def forward_labels(grid: DataFrame, spec: DataFrame, events: DataFrame, keys: Sequence[str],
                   interval_seconds: int, horizon_seconds: int | None = None, cap_seconds: int | None = None,
                   event_us_col: str = "event_us", y_col: str = "y_sc_5m",
                   tte_col: str = "time_to_sc_seconds") -> DataFrame:
    """Label every grid row. A parameter of 0 falls back to the default."""
    keys = list(keys)
    h = horizon_seconds or C.HORIZON_S
    cap = cap_seconds or C.TIME_TO_EVENT_CAP_S
    reach = max(h, cap) * US
    ev = events.select(*keys, F.col(event_us_col).alias("_e")).where(F.col("_e").isNotNull())
    x = explode_to_grid(ev, spec, keys, "_e", interval_seconds, -reach, -1)
    nxt = x.groupBy(*keys, K).agg(F.min("_e").alias("_next"), F.first("grid_us").alias("_gu"))
    g = grid.join(nxt, keys + [K], "left")
    delta = (F.col("_next") - F.col("_gu")) / F.lit(float(US))
    y = F.when(F.col("_next").isNotNull() & (delta <= F.lit(float(h))), F.lit(1)).otherwise(F.lit(0))
    tte = F.when(F.col("_next").isNotNull(), F.least(delta, F.lit(float(cap)))).otherwise(F.lit(float(cap)))
    return g.withColumn(y_col, y).withColumn(tte_col, tte).drop("_next", "_gu")


def rising_edges(df: DataFrame, keys: Sequence[str], order_col: str, y_col: str = "y_sc_5m",
                 bucket: int = 1_000_000) -> DataFrame:
    """Rows with ``y = 1`` whose previous row (per key, in order) has
    ``y = 0``; the first row counts when it is 1; NULL ``y`` is 0."""
    d = edge_flags(df, keys, order_col, y_col, bucket)
    return d.where("_edge").drop("_edge")


def edge_flags(df: DataFrame, keys: Sequence[str], order_col: str, y_col: str = "y_sc_5m",
               bucket: int = 1_000_000, out: str = "_edge") -> DataFrame:
    """Adds ``out``: whether the row is a rising edge. ``order_col`` is a whole
    number; the window covers ``bucket`` of its values, and the last ``y`` of
    earlier buckets comes from a table with one row per ``(key, bucket)``, so a
    long session is spread over its buckets."""
    keys = list(keys)
    y = F.coalesce(F.col(y_col), F.lit(0))
    d = df.withColumn("_eb", floor_div(F.col(order_col), F.lit(bucket)))
    d = d.withColumn("_ep", F.lag(y).over(Window.partitionBy(*keys, "_eb").orderBy(order_col)))
    last = d.groupBy(*keys, "_eb").agg(F.max_by(y, order_col).alias("_el"))
    carry = last.withColumn("_ec", F.lag("_el", 1, 0).over(Window.partitionBy(*keys).orderBy("_eb")))
    names = [*keys, "_eb"]
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in names]
    j = d.alias("_l").join(carry.alias("_r"), same, "left").select("_l.*", "_r._ec")
    edge = (F.coalesce(F.col(y_col), F.lit(0)) == 1) & (F.coalesce("_ep", "_ec", F.lit(0)) == 0)
    return j.withColumn(out, edge).drop("_eb", "_ep", "_ec")
