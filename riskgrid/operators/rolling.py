"""Right-closed rolling aggregates ``(t − w, t]``.

Two physical forms with the same results:

* ``rolling_to_grid`` — for regular grids (the feature build): rows are reduced to
  mergeable pane states (``panes.py``), and the states are merged into windows.
  All windows of a call share one set of panes. Distinct counts and entropy merge
  counts per category, everything else merges in one ``groupBy(keys, grid_k)``.
* ``rolling_over_timeline`` — for arbitrary left timestamps: union-window with
  a RANGE frame, partitioned by ``(keys, time bucket)``; source rows near a
  bucket's start are copied into it, so a hot key is split into buckets and no
  partition holds a whole session.

Joined texts are dealt to tasks by their bytes, so that a task's share does not grow.

Aggregate kinds: ``count`` (events), ``sum``, ``mean``, ``max``, ``min``,
``std`` (population), ``distinct`` (NULL counts as ``''``), ``entropy``
(Shannon, base 2, of the values in the window; NULL counts as ``''``),
``concat`` (`` | ``-joined text in time order), ``text`` (space-joined, for
flags).
Empty window: count/distinct → 0, concat/text → ``''``, others → NULL; a
non-empty window whose values are all NULL gives ``sum`` = 0.0.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.functions.predicates import nan_to_null
from riskgrid.functions.time import US, floor_div, us_col
from riskgrid.operators.grid import K, LAST_K
from riskgrid.operators.ordered import auto_bucket_seconds
from riskgrid.operators.panes import BLOCK, PANE, SEG, Panes, tasks_for
from riskgrid.session import written

ZERO_DEFAULT = {"count": 0, "distinct": 0, "concat": "", "text": "", "entropy": 0.0}
NUMERIC = ("sum", "mean", "max", "min", "std")
CATEGORY = ("distinct", "entropy")
TEXT = ("concat", "text")
#: Bytes of text that weigh as much as one copied state, and the most grid points in a block of
#: texts. A task has 32 MB of text by that: Parquet is read in batches of up to 4096 rows of a
#: file, so a file of joined texts is what a reader may hold, twice over while a batch grows.
TEXT_UNIT = 16
TEXT_POINTS = 32


def _agg_expr(kind: str, in_w: Column, v: Column, tb: Column) -> Column:
    """A numeric aggregate of the rows in a window, without panes (the definition that
    the states follow; ``tb`` orders rows, which no numeric kind needs)."""
    of = F.when(in_w, nan_to_null(v))
    if kind == "sum":
        return F.when(F.count(F.when(in_w, F.lit(1))) > 0, F.coalesce(F.sum(of), F.lit(0.0)).cast("double"))
    return {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_pop}[kind](of)


def _pane_states(kinds: set[str], i: int) -> dict[str, Column]:
    """States of one value column: what its aggregate kinds need, each mergeable."""
    v = nan_to_null(F.col(f"_v_{i}")) if kinds & set(NUMERIC) else F.col(f"_v_{i}")
    out = {}
    if kinds & {"sum", "mean", "std"}:
        out |= {f"_n_{i}": F.count(v), f"_sum_{i}": F.sum(v.cast("double"))}
    if "std" in kinds:
        out |= {f"_avg_{i}": F.avg(v.cast("double")), f"_var_{i}": F.var_pop(v.cast("double"))}
    if "max" in kinds:
        out[f"_max_{i}"] = F.max(v)
    if "min" in kinds:
        out[f"_min_{i}"] = F.min(v)
    if kinds & {"concat", "text"}:
        item = F.struct(F.col("_e").alias("e"), F.col("_tb").alias("tb"), F.coalesce(v.cast("string"), F.lit("")).alias("v"))
        out[f"_items_{i}"] = F.transform(F.array_sort(F.collect_list(item)), lambda s: s["v"])
    return out


def _merged(kind: str, inside: Column, i: int | None) -> Column:
    """The aggregate of a window from the states of its panes."""
    def of(state: str) -> Column:
        return F.when(inside, F.col(f"_{state}_{i}"))

    if kind == "count":
        return F.coalesce(F.sum(F.when(inside, F.col("_rows"))), F.lit(0).cast("long"))
    if kind == "sum":
        return F.when(F.count(F.when(inside, F.lit(1))) > 0, F.coalesce(F.sum(of("sum")), F.lit(0.0)))
    if kind == "mean":
        n = F.sum(of("n"))
        return F.when(n > 0, F.sum(of("sum")) / n)
    if kind in ("max", "min"):
        return (F.max if kind == "max" else F.min)(of(kind))
    if kind == "std":
        # Spread inside the panes plus spread of the panes' means about the window's mean.
        parts = F.collect_list(F.when(inside & (F.col(f"_n_{i}") > 0), F.struct(F.col(f"_n_{i}").cast("double").alias("n"), F.col(f"_avg_{i}").alias("m"), F.col(f"_var_{i}").alias("v"))))

        def total(f):
            return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + f(x))
        n = total(lambda x: x["n"])
        mean = total(lambda x: x["n"] * x["m"]) / n
        return F.when(F.size(parts) > 0, F.sqrt(total(lambda x: x["n"] * (x["v"] + (x["m"] - mean) * (x["m"] - mean))) / n))
    if kind in ("concat", "text"):
        # Panes follow each other in time, later segments of a pane come first.
        parts = F.array_sort(F.collect_list(F.when(inside, F.struct(F.col(PANE).alias("p"), (-F.col(SEG)).alias("s"), F.col(f"_items_{i}").alias("items")))))
        return F.array_join(F.flatten(F.transform(parts, lambda x: x["items"])), " | " if kind == "concat" else " ")
    raise ValueError(f"unknown aggregate {kind!r}")


def _category_windows(placed: DataFrame, panes: Panes, keys: Sequence[str], category: Column,
                      wanted: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Distinct counts and entropies of one column: categories are counted per pane,
    the counts summed per window, so a dense window costs its distinct categories."""
    per_pane = placed.withColumn("_c", F.coalesce(category.cast("string"), F.lit(""))).groupBy(*keys, LAST_K, PANE, SEG, "_c").agg(F.count(F.lit(1)).alias("_n"))
    windows = sorted({w for _, _, w in wanted})
    spread = panes.spread_by(per_pane, windows[-1], [*keys, "_c"])
    counts = spread.groupBy(*keys, "_c", BLOCK, K).agg(*[F.sum(F.when(panes.inside(w), F.col("_n"))).alias(f"_n_{w}") for w in windows])

    def aggregate(kind: str, w: int) -> Column:
        n = F.col(f"_n_{w}")
        if kind == "distinct":
            return F.count(n)
        # −Σ p·log2 p with p = n / N
        total = F.sum(n)
        return F.when(total > 0, F.log2(total.cast("double")) - F.sum(n * F.log2(n.cast("double"))) / total) + F.lit(0.0)
    return counts.groupBy(*keys, K).agg(*[aggregate(kind, w).alias(name) for name, kind, w in wanted])


def _text_windows(placed: DataFrame, panes: Panes, keys: Sequence[str], kinds: dict[int, set[str]],
                  wanted: Sequence[tuple[str, str, int, int]]) -> DataFrame:
    """Joined texts of windows. Rows, copies and joined texts are dealt to as many tasks as
    keep the text of a task small; only the widest window of texts is filled."""
    columns = sorted({i for _, _, i, _ in wanted})
    window = max(w for *_, w in wanted)
    text = sum((F.coalesce(F.octet_length(F.col(f"_v_{i}").cast("string")), F.lit(0)) for i in columns), F.lit(0))
    tasks = tasks_for(placed.agg(F.sum(1 + text / TEXT_UNIT)), placed)
    states = {f"_items_{i}": _pane_states(kinds[i], i)[f"_items_{i}"] for i in columns}
    dealt = placed.repartition(tasks, *keys, PANE, SEG)
    per_pane = dealt.groupBy(*keys, LAST_K, PANE, SEG).agg(*[c.alias(n) for n, c in states.items()])
    size = sum((F.aggregate(f"_items_{i}", F.lit(0).cast("long"), lambda n, v: n + F.octet_length(v) + 8) for i in columns), F.lit(0))
    spread = panes.spread_by(per_pane, window, keys, weight=1 + size / TEXT_UNIT, points=TEXT_POINTS)
    joined = sum((F.octet_length(name).cast("long") for name, *_ in wanted), F.lit(0))
    merged = spread.groupBy(*keys, BLOCK, K).agg(*[_merged(kind, panes.inside(w), i).alias(name) for name, kind, i, w in wanted])
    # the sizes have a column of their own, so that adding them up reads no text
    merged = written(merged.drop(BLOCK).withColumn("_bytes", joined))
    # At least as many as other shuffles have, or the join would deal the texts again.
    least = int(merged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return merged.drop("_bytes").repartition(max(least, tasks_for(merged.agg(F.sum(1 + F.col("_bytes") / TEXT_UNIT)), merged)), *keys, K)


def rolling_to_grid(grid: DataFrame, spec: DataFrame, events: DataFrame, keys: Sequence[str],
                    ts_col: str, interval_seconds: int,
                    aggs: Sequence[tuple[str, str, str | None, int]],
                    tiebreak: str | None = None) -> DataFrame:
    """Add one column per ``(name, kind, value_col, window_seconds)`` to ``grid``."""
    keys = list(keys)
    if not aggs:
        return grid
    for _, kind, _, _ in aggs:
        if kind not in {"count", "concat", "text", *NUMERIC, *CATEGORY}:
            raise ValueError(f"unknown aggregate {kind!r}")
    windows = [a[3] for a in aggs]
    panes = Panes(interval_seconds, windows)
    values = sorted({a[2] for a in aggs if a[2] is not None})
    tb = F.col(tiebreak) if tiebreak else F.lit(0)
    rows = events.select(*keys, us_col(events, ts_col).alias("_e"), tb.alias("_tb"),
                         *[F.col(v).alias(f"_v_{i}") for i, v in enumerate(values)]).where(F.col("_e").isNotNull())
    placed = panes.place(rows, spec, keys, "_e", max(windows))
    out = grid
    plain = [a for a in aggs if a[1] not in (*CATEGORY, *TEXT)]
    if plain:
        states: dict[str, Column] = {"_rows": F.count(F.lit(1))}
        for i, v in enumerate(values):
            states |= _pane_states({a[1] for a in plain if a[2] == v}, i)
        per_pane = placed.groupBy(*keys, LAST_K, PANE, SEG).agg(*[c.alias(n) for n, c in states.items()])
        spread = panes.spread(per_pane, max(a[3] for a in plain))
        merged = spread.groupBy(*keys, K).agg(*[_merged(kind, panes.inside(w), None if v is None else values.index(v)).alias(name) for name, kind, v, w in plain])
        out = out.join(merged, keys + [K], "left")
    texts = [(name, kind, values.index(v), w) for name, kind, v, w in aggs if kind in TEXT]
    if texts:
        kinds = {i: {a[1] for a in aggs if a[2] == v and a[1] not in CATEGORY} for i, v in enumerate(values)}
        out = out.join(_text_windows(placed, panes, keys, kinds, texts), keys + [K], "left")
    for i, v in enumerate(values):
        wanted = [(name, kind, w) for name, kind, of, w in aggs if of == v and kind in CATEGORY]
        if wanted:
            out = out.join(_category_windows(placed, panes, keys, F.col(f"_v_{i}"), wanted), keys + [K], "left")
    fills = {name: ZERO_DEFAULT[kind] for name, kind, _, _ in aggs if kind in ZERO_DEFAULT}
    out = out.fillna(fills) if fills else out
    return out.select(*grid.columns, *[a[0] for a in aggs])


def entropy_to_grid(grid: DataFrame, spec: DataFrame, events: DataFrame, keys: Sequence[str],
                    ts_col: str, interval_seconds: int, category_col: str, window_seconds: int,
                    entropy_name: str, unique_name: str | None = None) -> DataFrame:
    """Shannon entropy (base 2) of the categories in the window and,
    optionally, their distinct count. NULL category counts as ``''``; an empty
    window gives 0.0 / 0."""
    aggs = [(entropy_name, "entropy", category_col, window_seconds)]
    if unique_name:
        aggs.append((unique_name, "distinct", category_col, window_seconds))
    return rolling_to_grid(grid, spec, events, keys, ts_col, interval_seconds, aggs)


def rolling_over_timeline(timeline: DataFrame, events: DataFrame, keys: Sequence[str], ts_col: str,
                          event_ts_col: str, aggs: Sequence[tuple[str, str, str | None, int]],
                          bucket_seconds: int | str = "auto") -> DataFrame:
    """Rolling aggregates for arbitrary timeline rows (R1–R3 generic form).

    Every timeline row is carried through the union as a struct and kept
    once; its window may reach
    into the previous bucket, so source rows within ``w`` of a bucket's start
    are copied into that bucket as well. ``"auto"`` sizes buckets from the fullest one."""
    keys = list(keys)
    if bucket_seconds == "auto":
        sides = timeline.select(*keys, us_col(timeline, ts_col).alias("_au")).unionByName(
            events.select(*keys, us_col(events, event_ts_col).alias("_au")))
        bucket_seconds = auto_bucket_seconds(sides, keys, "_au")
    wmax = max(a[3] for a in aggs) * US
    bucket = max(bucket_seconds * US, wmax)
    values = sorted({a[2] for a in aggs if a[2] is not None})
    tl = timeline
    lstruct = F.struct(*[F.col(c) for c in tl.columns])
    left = tl.select(*keys, lstruct.alias("_l"), us_col(tl, ts_col).alias("_u"), F.lit(1).alias("_side"),
                     *[F.lit(None).cast(events.schema[v].dataType).alias(f"_v_{i}") for i, v in enumerate(values)])
    left = left.withColumn("_b", floor_div("_u", F.lit(bucket)))
    right = events.select(*keys, F.lit(None).cast(left.schema["_l"].dataType).alias("_l"), us_col(events, event_ts_col).alias("_u"),
                          F.lit(0).alias("_side"), *[F.col(v).alias(f"_v_{i}") for i, v in enumerate(values)])
    right = right.where(F.col("_u").isNotNull())
    b0 = floor_div("_u", F.lit(bucket))
    b1 = floor_div(F.col("_u") + F.lit(wmax - 1), F.lit(bucket))
    right = right.withColumn("_b", F.explode(F.sequence(b0, b1)))
    u = left.unionByName(right)
    exprs = []
    for name, kind, value, w in aggs:
        win = Window.partitionBy(*keys, "_b").orderBy("_u").rangeBetween(-(w * US - 1), 0)
        is_ev = F.col("_side") == 0
        v = F.col(f"_v_{values.index(value)}") if value is not None else None
        if kind in ("sum", "mean", "max", "min", "std"):
            v = nan_to_null(v)
        if kind == "count":
            e = F.count(F.when(is_ev, F.lit(1))).over(win)
        elif kind == "sum":
            e = F.when(F.count(F.when(is_ev, F.lit(1))).over(win) > 0,
                       F.coalesce(F.sum(v).over(win), F.lit(0.0)).cast("double"))
        elif kind == "mean":
            e = F.avg(v).over(win)
        elif kind == "max":
            e = F.max(v).over(win)
        elif kind == "min":
            e = F.min(v).over(win)
        elif kind == "std":
            e = F.stddev_pop(v).over(win)
        elif kind == "distinct":
            e = F.size(F.collect_set(F.when(is_ev, F.coalesce(v.cast("string"), F.lit("")))).over(win)).cast("long")
        else:
            raise ValueError(f"kind {kind!r} not supported on arbitrary timelines")
        exprs.append(e.alias(name))
    res = u.select("_l", "_side", *exprs).where(F.col("_side") == 1)
    return res.select("_l.*", *[a[0] for a in aggs])
