"""Session risk with a stored model and its fallbacks.

Without a model a row's risk is its label; when scoring fails, every risk is 0.0.
Spark finds such a failure only when rows are computed, so the scores are written
(to the checkpoint folder) before anything is made of them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions.predicates import round_scaled, scrub
from riskgrid.operators.events import edge_flags
from riskgrid.plans import training as TR
from riskgrid.session import ensure_checkpoint_dir
from riskgrid.sources.bronze import _exists, read_gold

RISK = "risk_score"


def stored_model(spark: SparkSession, path: str | None) -> TR.Fitted | None:
    """The model that ``run_training`` saved under ``path``; None if there is none."""
    return TR.load_fitted(spark, path) if path and _exists(spark, f"{path}/meta") else None


def with_risk(rows: DataFrame, model: TR.Fitted | None) -> DataFrame:
    """``rows`` with ``risk_score``: the model's probability, else the label, else 0.0."""
    ensure_checkpoint_dir(rows.sparkSession)
    if model is None:
        label = F.col(TR.LABEL).cast("double") if TR.LABEL in rows.columns else F.lit(0.0)
        return rows.withColumn(RISK, label)
    try:
        keyed = TR.with_row_id(rows)
        prob = TR.score(model, keyed).select(TR.ROW_ID, F.col("prob").alias(RISK))
        return keyed.join(prob, TR.ROW_ID, "left").drop(TR.ROW_ID).checkpoint()
    except Exception:  # noqa: BLE001 - any failure to score leaves the report with zeros
        return rows.withColumn(RISK, F.lit(0.0))


def session_report(scored: DataFrame, order_col: str = "grid_k", ts_col: str = "timestamp") -> DataFrame:
    """One row per session: peak_risk, sc_windows, grid_points and the times at which a run of
    positive labels starts (ascending). Not-a-number and infinite peaks are NULL."""
    ensure_checkpoint_dir(scored.sparkSession)
    # The edges read the rows twice: written once, with the four columns the report needs.
    rows = scored.select("session_key", order_col, ts_col, TR.LABEL, RISK).checkpoint()
    flagged = edge_flags(rows, ["session_key"], order_col, TR.LABEL)
    starts = F.array_sort(F.collect_list(F.when(F.col("_edge"), F.col(ts_col))))
    return flagged.groupBy("session_key").agg(
        F.max(scrub(RISK)).alias("peak_risk"), F.coalesce(F.sum(TR.LABEL), F.lit(0)).cast("long").alias("sc_windows"),
        F.count(F.lit(1)).alias("grid_points"), starts.alias("sc_event_starts"))


def session_timeline(scored: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """The plotted rows: risk rounded to 4 digits, not-a-number and infinite risks NULL."""
    return scored.select("session_key", ts_col, round_scaled(scrub(RISK), 4).alias(RISK), TR.LABEL)


def score_session(spark: SparkSession, gold_path: str, session_key: int, model_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, timeline) of one session of the gold table, read by its folder."""
    scored = with_risk(read_gold(spark, gold_path, [session_key]), stored_model(spark, model_path))
    return session_report(scored), session_timeline(scored)
