"""Read-only reports over the gold timeline.

All are plain aggregates or per-session windows over grid-sized data; the
rounding is half-even on binary doubles like the reference's: ``round_scaled`` for
columns of a frame, ``round_exact`` for single numbers.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.functions.predicates import round_exact, round_scaled
from riskgrid.functions.time import US, us_col
from riskgrid.operators.events import edge_flags


def session_list(gold: DataFrame, year: int | None = None) -> DataFrame:
    """A1: one row per session (metadata is constant per key), newest year first."""
    cols = [c for c in ("meeting_key", "meeting_name", "year") if c in gold.columns]
    s = gold.groupBy("session_key").agg(*[F.min(c).alias(c) for c in cols])
    if year:
        s = s.where(F.col("year") == year)
    return s.orderBy(F.col("year").desc(), F.col("session_key").asc())


def overview(gold: DataFrame, y_col: str = "y_sc_5m") -> DataFrame:
    """A2: distinct sessions, rows, positive rate %, positives, years."""
    years = F.array_sort(F.collect_set("year"))
    return gold.agg(F.count_distinct("session_key").alias("total_sessions"),
                    F.count(F.lit(1)).alias("total_grid_points"),
                    round_exact(F.avg(y_col) * 100, 2).alias("positive_rate_pct"),
                    F.sum(y_col).cast("long").alias("sc_event_windows"),
                    F.array_join(years.cast("array<string>"), ",").alias("years_covered"),
                    F.size(years).cast("long").alias("years_count"))


def rate_by(df: DataFrame, group_col: str, session_col: str = "session_key", y_col: str = "y_sc_5m") -> DataFrame:
    """A3: sessions, positives, rows and rate % per group (NULL group dropped)."""
    d = df.where(F.col(group_col).isNotNull())
    g = d.groupBy(group_col).agg(F.count_distinct(session_col).alias("sessions"),
                                 F.sum(y_col).cast("long").alias("sc_windows"),
                                 F.count(y_col).alias("total_windows"))
    return g.withColumn("sc_rate_pct", round_scaled(F.col("sc_windows") / F.col("total_windows") * 100, 2))


def rate_top(df: DataFrame, group_col: str, n: int = 30, **kw) -> DataFrame:
    """A4: top ``n`` groups by the rounded rate (ties by group ascending)."""
    return rate_by(df, group_col, **kw).orderBy(F.col("sc_rate_pct").desc(), F.col(group_col).asc()).limit(n)


def means_by(df: DataFrame, group_col: str, cols: Sequence[str]) -> DataFrame:
    """A5: per-group means of the columns present, rounded to 2; rows without group are left out."""
    present = [c for c in cols if c in df.columns]
    return df.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(*[round_scaled(F.avg(c), 2).alias(c) for c in present])


def session_risk(scored: DataFrame, score_col: str = "risk_score", y_col: str = "y_sc_5m",
                 order_col: str = "grid_k") -> DataFrame:
    """Per session peak score, positives, grid points, event starts."""
    flagged = edge_flags(scored, ["session_key"], order_col, y_col)
    return flagged.groupBy("session_key").agg(
        F.max(score_col).alias("peak_risk"), F.sum(y_col).cast("long").alias("sc_windows"),
        F.count(F.lit(1)).alias("grid_points"), F.count_if("_edge").alias("sc_event_starts"))


def latest_delta(scored: DataFrame, score_col: str = "risk_score", order_col: str = "grid_k") -> DataFrame:
    """A10: latest score per session and its change from the previous point
    (vs 0.0 when there is one point)."""
    w = Window.partitionBy("session_key").orderBy(F.col(order_col).desc())
    top2 = scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2)
    g = top2.groupBy("session_key").agg(F.max(F.when(F.col("_rn") == 1, F.col(score_col))).alias("latest_risk"),
                                        F.max(F.when(F.col("_rn") == 2, F.col(score_col))).alias("_prev"))
    return g.select("session_key", "latest_risk",
                    (F.col("latest_risk") - F.coalesce(F.col("_prev"), F.lit(0.0))).alias("risk_delta"))


def bbox(df: DataFrame, group_cols: Sequence[str], x: str, y: str, pad: float = 2000.0) -> DataFrame:
    """Padded bounding box of x/y per group."""
    return df.groupBy(*group_cols).agg((F.min(x) - pad).alias("x_min"), (F.max(x) + pad).alias("x_max"),
                                       (F.min(y) - pad).alias("y_min"), (F.max(y) + pad).alias("y_max"))


def series_tail(df: DataFrame, key_cols: Sequence[str], order_col: str, n: int = 10) -> DataFrame:
    """The last ``n`` points of each series (the limit is the feature)."""
    w = Window.partitionBy(*key_cols).orderBy(F.col(order_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def messages_by_time(messages: DataFrame, ts_col: str = "date") -> DataFrame:
    """A session's messages with the time as text, sorted by that text."""
    cols = [c for c in ("session_key", "category", "flag", "message") if c in messages.columns]
    return messages.select(*cols, F.date_format(ts_col, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date")).orderBy("date")


def top_n_with_share(df: DataFrame, name_col: str, value_col: str, n: int = 20) -> DataFrame:
    """A8 + P26: top ``n`` by value (ties by name) and each value as % of the
    largest one kept."""
    top = df.orderBy(F.col(value_col).desc(), F.col(name_col).asc()).limit(n)
    return top.withColumn("relative_pct", F.col(value_col) / F.max(value_col).over(Window.partitionBy()) * 100)


def window_around(messages: DataFrame, at_us: Column, seconds: float, ts_col: str = "date",
                  symmetric: bool = True) -> DataFrame:
    """P16 (symmetric, both ends inclusive, oldest first) / P17 (trailing ``[T − w, T]``, newest first)."""
    u = us_col(messages, ts_col)
    lo = at_us - F.lit(int(seconds * US))
    hi = at_us + F.lit(int(seconds * US)) if symmetric else at_us
    return messages.where((u >= lo) & (u <= hi)).withColumn("time", F.date_format(ts_col, "HH:mm:ss")).orderBy(F.col(ts_col).asc() if symmetric else F.col(ts_col).desc())


def replay_cut(df: DataFrame, ts_col: str, at_us: Column) -> DataFrame:
    """Rows at or before the replay instant (inclusive)."""
    return df.where(us_col(df, ts_col) <= at_us)


def report_header(test: DataFrame, y_col: str = "y_sc_5m", meeting_col: str = "meeting_key") -> DataFrame:
    """S28 header row: test rows, distinct meetings, positive %."""
    return test.agg(F.count(F.lit(1)).alias("test_rows"), F.count_distinct(meeting_col).alias("test_meetings"),
                    round_exact(F.avg(y_col) * 100, 2).alias("positive_pct"))


def positive_windows(df: DataFrame, y_col: str = "y_sc_5m") -> DataFrame:
    """Grid rows labelled positive."""
    return df.where(F.col(y_col) == 1)


def risk_series(scored: DataFrame, score_col: str = "risk_score", y_col: str = "y_sc_5m",
                ts_col: str = "timestamp") -> DataFrame:
    """A6 series: per grid point the score rounded half-even to 4 digits."""
    return scored.select("session_key", ts_col, round_scaled(score_col, 4).alias(score_col), y_col)
