"""As-of joins.

``asof_join`` — any left timestamps. One union of left and right rows,
partitioned by ``(by…, time bucket)``; inside a bucket a running
``last(struct(right.*), ignorenulls)`` finds the match. A left row whose
bucket has no earlier right row takes the *carry-in*: the last right row of
the nearest earlier bucket, found on a table with one row per
``(by…, bucket)``, which is tiny next to the data. So a hot key is split into
buckets and no task ever holds a whole key.

``asof_to_grid`` — left side is a regular grid: each right row is mapped to
one grid index, reduced with ``max_by``/``min_by`` per ``(keys, grid_k)``
(partial aggregation), and then filled along the grid. Only grid-sized data
is windowed.

Semantics (pandas ``merge_asof``): backward = last right row with
``r ≤ t`` (``r < t`` when exact matches are disallowed); forward = first
with ``r ≥ t``; nearest = the closer of the two, ties go backward; tolerance
is inclusive and applied per direction. The match is row-level: a matched
row with a NULL cell yields NULL. Ties among right rows at the same instant
are decided by ``tiebreak`` (largest wins backward, smallest forward).
Right columns that also exist on the left (other than keys) are dropped. NULL
keys match each other, whatever the bucket width.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrid.functions.time import US, floor_div, us_col
from riskgrid.operators.grid import K, grid_index_of
from riskgrid.operators.ordered import auto_bucket_seconds, join_null_safe

_TS_TYPES = (T.TimestampType, T.TimestampNTZType)


def _check_ts(df: DataFrame, name: str, side: str) -> None:
    if not isinstance(df.schema[name].dataType, _TS_TYPES):
        raise ValueError(f"{side}['{name}'] must be a timestamp column")


def _payload(left: DataFrame, right: DataFrame, on: str, right_on: str, by: Sequence[str]) -> list[str]:
    skip = {on, right_on, *by}
    return [c for c in right.columns if c not in skip and c not in left.columns]


def asof_join(left: DataFrame, right: DataFrame, on: str = "timestamp", by: Sequence[str] | str = (),
              tolerance_seconds: float | None = None, direction: str = "backward",
              right_on: str | None = None, allow_exact_matches: bool = True,
              tiebreak: str | None = None, bucket_seconds: int | str = "auto",
              right_ts_alias: str | None = None) -> DataFrame:
    """As-of join of ``right`` onto every ``left`` row. ``bucket_seconds``
    ``"auto"`` sizes the time buckets from the fullest one of both sides together."""
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    by = [by] if isinstance(by, str) else list(by)
    right_on = right_on or on
    _check_ts(left, on, "left")
    _check_ts(right, right_on, "right")
    payload = _payload(left, right, on, right_on, by)
    if bucket_seconds == "auto":
        sides = left.select(*by, us_col(left, on).alias("_au")).unionByName(
            right.select(*by, us_col(right, right_on).alias("_au")))
        bucket_seconds = auto_bucket_seconds(sides, by, "_au")
    bucket = int(bucket_seconds * US)
    right_side = 0 if allow_exact_matches else 2

    lstruct = F.struct(*[F.col(c) for c in left.columns])
    rfields = [F.col(c) for c in payload] + [us_col(right, right_on).alias("_ru")]
    rstruct_t = right.select(F.struct(*rfields).alias("_r")).schema["_r"].dataType
    tb = F.col(tiebreak) if tiebreak else F.lit(0)
    tb_t = right.schema[tiebreak].dataType if tiebreak else "int"

    L = left.select(*by, lstruct.alias("_l"), us_col(left, on).alias("_u"), F.lit(1).alias("_side"),
                    F.lit(None).cast(rstruct_t).alias("_r"), F.lit(None).cast(tb_t).alias("_tb"))
    R = right.select(*by, F.lit(None).cast(L.schema["_l"].dataType).alias("_l"),
                     us_col(right, right_on).alias("_u"), F.lit(right_side).alias("_side"),
                     F.struct(*rfields).alias("_r"), tb.alias("_tb")).where(F.col("_u").isNotNull())
    bcol = floor_div("_u", F.lit(bucket))
    L = L.withColumn("_b", bcol)
    R = R.withColumn("_b", bcol)

    dirs = ["backward", "forward"] if direction == "nearest" else [direction]
    part = Window.partitionBy(*by, "_b")
    sel = [*by, "_b", "_l", "_u"]
    for d in dirs:
        if d == "backward":
            w = part.orderBy(F.col("_u").asc(), F.col("_side").asc(), F.col("_tb").asc())
        else:
            w = part.orderBy(F.col("_u").desc(), F.col("_side").asc(), F.col("_tb").desc())
        w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sel.append(F.last("_r", ignorenulls=True).over(w).alias(f"_m_{d}"))
    U = L.unionByName(R)
    res = U.select(*sel, "_side").where(F.col("_side") == 1).drop("_side")

    # carry-in from earlier (backward) / later (forward) buckets
    keys_b = L.select(*by, "_b").distinct()
    lasts = []
    if "backward" in dirs:
        lasts.append(F.max_by("_r", F.struct("_u", "_tb")).alias("_bl_backward"))
    if "forward" in dirs:
        lasts.append(F.min_by("_r", F.struct("_u", "_tb")).alias("_bl_forward"))
    blast = R.groupBy(*by, "_b").agg(*lasts)
    ends = [f"_bl_{d}" for d in dirs]
    kt = keys_b.select(*by, "_b", *[F.lit(None).cast(rstruct_t).alias(c) for c in ends]).unionByName(blast)
    kt = kt.groupBy(*by, "_b").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ends])
    carry = []
    for d in dirs:
        o = F.col("_b").asc() if d == "backward" else F.col("_b").desc()
        cw = Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
        carry.append(F.last(f"_bl_{d}", ignorenulls=True).over(cw).alias(f"_c_{d}"))
    kt = kt.select(*by, "_b", *carry)
    res = join_null_safe(res, kt, by + ["_b"])

    tol = None if tolerance_seconds is None else int(round(tolerance_seconds * US))
    chosen = {}
    for d in dirs:
        m = F.coalesce(F.col(f"_m_{d}"), F.col(f"_c_{d}"))
        gap = (F.col("_u") - m["_ru"]) if d == "backward" else (m["_ru"] - F.col("_u"))
        ok = F.col("_u").isNotNull() & m.isNotNull()
        if tol is not None:
            ok = ok & (gap <= F.lit(tol))
        chosen[d] = (F.when(ok, m), F.when(ok, gap))
    if direction == "nearest":
        (mb, gb), (mf, gf) = chosen["backward"], chosen["forward"]
        m = F.when(gf.isNull() | (gb.isNotNull() & (gb <= gf)), mb).otherwise(mf)
    else:
        m = chosen[direction][0]
    res = res.withColumn("_m", m)
    out = [F.col("_l")[c].alias(c) for c in left.columns] + [F.col("_m")[c].alias(c) for c in payload]
    if right_ts_alias:
        from riskgrid.functions.time import ts_of
        out.append(ts_of(F.col("_m")["_ru"]).alias(right_ts_alias))
    return res.select(*out)


def asof_to_grid(grid: DataFrame, spec: DataFrame, right: DataFrame, keys: Sequence[str], ts_col: str,
                 interval_seconds: int, payload: Sequence[str], direction: str = "backward",
                 tolerance_seconds: float | None = None, tiebreak: str | None = None,
                 grid_ts_col: str = "timestamp", right_us_alias: str | None = None) -> DataFrame:
    """J2 on a regular grid: per grid point the last (first) right row at or
    before (after) it, within the tolerance. Adds ``payload`` columns."""
    keys = list(keys)
    payload = list(payload)
    tb = F.col(tiebreak) if tiebreak else F.lit(0)
    rows = right.select(*keys, us_col(right, ts_col).alias("_e"), tb.alias("_tb"),
                        *[F.col(c) for c in payload]).where(F.col("_e").isNotNull())
    rstruct = F.struct(*[F.col(c) for c in payload], F.col("_e"))
    g = grid.withColumn("_gu", us_col(grid, grid_ts_col))
    dirs = ["backward", "forward"] if direction == "nearest" else [direction]
    tol = None if tolerance_seconds is None else int(round(tolerance_seconds * US))
    picks = {}
    for d in dirs:
        if d == "backward":
            idx = grid_index_of(rows, spec, keys, "_e", interval_seconds, "ceil")
            red = idx.groupBy(*keys, K).agg(F.max_by(rstruct, F.struct("_e", "_tb")).alias(f"_p_{d}"))
            order = F.col(K).asc()
        else:
            idx = grid_index_of(rows, spec, keys, "_e", interval_seconds, "floor")
            red = idx.groupBy(*keys, K).agg(F.min_by(rstruct, F.struct("_e", "_tb")).alias(f"_p_{d}"))
            order = F.col(K).desc()
        g = g.join(red, keys + [K], "left")
        fw = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        m = F.last(f"_p_{d}", ignorenulls=True).over(fw)
        g = g.withColumn(f"_f_{d}", m).drop(f"_p_{d}")
        m = F.col(f"_f_{d}")
        gap = (F.col("_gu") - m["_e"]) if d == "backward" else (m["_e"] - F.col("_gu"))
        ok = m.isNotNull() if tol is None else (m.isNotNull() & (gap <= F.lit(tol)))
        picks[d] = (F.when(ok, m), F.when(ok, gap))
    if direction == "nearest":
        (mb, gb), (mf, gf) = picks["backward"], picks["forward"]
        m = F.when(gf.isNull() | (gb.isNotNull() & (gb <= gf)), mb).otherwise(mf)
    else:
        m = picks[direction][0]
    g = g.withColumn("_m", m)
    extra = [F.col("_m")["_e"].alias(right_us_alias)] if right_us_alias else []
    return g.select(*grid.columns, *[F.col("_m")[c].alias(c) for c in payload], *extra)


def nearest_snapshot(rows: DataFrame, ts_col: str, by: Sequence[str] | str, at_us_col: str,
                     tolerance_seconds: float, cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` (e.g. driver), the row nearest to the instant in
    ``at_us_col`` within ±tolerance (both ends inclusive); ties → earlier row.
    ``group_cols`` are extra grouping keys carried with the instant."""
    by = [by] if isinstance(by, str) else list(by)
    tol = int(round(tolerance_seconds * US))
    u = us_col(rows, ts_col)
    d = F.abs(u - F.col(at_us_col))
    f = rows.withColumn("_u", u).withColumn("_d", d).where(F.col("_d") <= F.lit(tol))
    pick = F.min_by(F.struct(*[F.col(c) for c in cols], F.col(ts_col)), F.struct("_d", "_u")).alias("_s")
    return f.groupBy(*group_cols, *by).agg(pick).select(*group_cols, *by, "_s.*")


def lookup_with_fallback(left: DataFrame, dim: DataFrame, key: str, dim_key: str, label: str,
                         out: str, order_col: str | None = None) -> DataFrame:
    """Label lookup by key compared as string, falling back to the key
    itself; a duplicated dimension key keeps its last row by ``order_col``."""
    d = dim.select(F.col(dim_key).cast("string").alias("_k"), F.col(label).alias("_lab"),
                   (F.col(order_col) if order_col else F.lit(0)).alias("_o"))
    d = d.groupBy("_k").agg(F.max_by("_lab", "_o").alias("_lab"))
    j = left.join(d, left[key].cast("string") == d["_k"], "left")
    return j.withColumn(out, F.coalesce(F.col("_lab").cast("string"), F.col(key).cast("string"))).drop("_k", "_lab")


def split_by_membership(df: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not a member, rows whose key is a member)."""
    m = members.select(F.col(key)).distinct()
    return df.join(m, key, "left_anti"), df.join(m, key, "left_semi")
