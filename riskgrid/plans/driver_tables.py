"""The driver's test tables seen as race-shaped inputs.

Mapping (SURVEY §7.3): a *session* is one UTC day of ``events``
(``session_key = yyyymmdd``); ``race_control`` messages are all events
(``category = event_type``, ``message = upper(event_type) || ' ' || props``);
a *driver* is ``user_id``; weather readings are ``view`` events; ranked
positions are ``floor(value / 20)``; gaps come from ``click`` and
``purchase`` events. The event stream is ~1 event per 4 minutes per day at
sf0.01, so the windows below are wider than the race defaults; the operators
are the same.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions.predicates import is_event_start
from riskgrid.plans.features import FeatureParams

GRID_S = 300

# Event predicate and keyword patterns for the driver tables.
CATEGORIES = ("error",)
FLAGS = ("HIGH",)
START = r"(?i)\bSIGNUP\b.*\b9\d\b"
END = r"\"k\": 1\d\b"
FLAG_PATTERNS = {
    "error_flag": r"(?i)\bERROR\b",
    "purchase_flag": r"(?i)\bPURCHASE\b",
    "signup_flag": r"(?i)\bSIGNUP\b",
    "view_then_click_flag": r"(?i)\bVIEW\b.*\bCLICK\b",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_key(ts: str = "ts"):
    return F.date_format(F.col(ts), "yyyyMMdd").cast("long")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """race_control-shaped view of ``events``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        session_key().alias("session_key"), "event_id", F.col("ts").alias("date"),
        F.col("event_type").alias("category"),
        F.when(F.col("value") >= 300, F.lit("HIGH")).otherwise(F.lit("")).alias("flag"),
        F.concat_ws(" ", F.upper("event_type"), F.col("props")).alias("message"),
        F.col("user_id").cast("string").alias("driver_number"), "value")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day: bounds from the day's first and last event."""
    ev = table(spark, sf_dir, "events").where(F.col("ts").isNotNull())
    s = ev.groupBy(session_key().alias("session_key")).agg(F.min("ts").alias("date_start"),
                                                           F.max("ts").alias("date_end"))
    return s.select(
        "session_key",
        (F.date_format("date_start", "yyyyMM").cast("long") * 10
         + F.floor((F.dayofmonth("date_start") - 1) / 7).cast("long")).alias("meeting_key"),
        F.year("date_start").alias("year"),
        F.date_format("date_start", "EEEE").alias("meeting_name"),
        "date_start", "date_end")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).where(F.col("category") == "view")
    v = F.col("value")
    return m.select("session_key", "event_id", "date",
                    (v / 100.0).alias("rainfall"), v.alias("track_temperature"), (v / 2.0).alias("air_temperature"),
                    (v / 10.0).alias("wind_speed"), (v / 4.0).alias("humidity"), (v + 1000.0).alias("pressure"))


def position(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return m.select("session_key", "event_id", "date", "driver_number",
                    F.floor(F.col("value") / 20).cast("double").alias("position"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).where(F.col("category").isin("click", "purchase"))
    return m.select("session_key", "event_id", "date", "driver_number",
                    F.col("value").cast("string").alias("gap_to_leader"),
                    (F.col("value") / 50.0).cast("string").alias("interval"))


def predicate():
    return is_event_start(categories=CATEGORIES, flags=FLAGS, start_pattern=START, end_pattern=END)


def feature_params() -> FeatureParams:
    return FeatureParams(
        interval_seconds=GRID_S, horizon_seconds=300, cap_seconds=1800, merge_window_seconds=300,
        count_windows=(600, 1800, 3600), text_window=1800, flags=dict(FLAG_PATTERNS),
        weather_tolerance_seconds=3600, weather_window_seconds=3600,
        changes_window_s=14400, volatility_window_s=28800, gap_window_s=3600,
        event_predicate=predicate(), tiebreak="event_id")
