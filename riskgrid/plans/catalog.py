"""Registered queries over the driver's tables, each with a DuckDB oracle.

Every entry is ``(spark_fn(spark, sf_dir) -> DataFrame, oracle SQL | None,
double columns rounded to 6 digits on both sides)``. The SQL is written
independently of the Spark plan (range joins, ``ASOF JOIN``, recursive CTEs).
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions.time import floor_to_grid
from riskgrid.operators.asof import asof_join
from riskgrid.operators.events import detect_events, forward_labels, rising_edges
from riskgrid.operators.grid import K, build_grid, grid_spec
from riskgrid.operators.rolling import entropy_to_grid, rolling_over_timeline, rolling_to_grid
from riskgrid.plans import driver_tables as D
from riskgrid.plans import oracle as O
from riskgrid.plans.features import build_features, dynamics_block, text_block, weather_block


@dataclass
class Query:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    round_cols: tuple[str, ...] = ()


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, round_cols: tuple[str, ...] = ()):
    def deco(fn):
        REGISTRY[name] = Query(fn, sql, tuple(round_cols))
        return fn
    return deco


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = REGISTRY[name]
    df = q.fn(spark, sf_dir)
    if q.round_cols:
        df = df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in q.round_cols})
    return df


def oracle(name: str) -> str | None:
    q = REGISTRY[name]
    if q.sql is None or not q.round_cols:
        return q.sql
    rep = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in q.round_cols)
    return f"SELECT * REPLACE ({rep}) FROM ({q.sql}) AS q_"


# ---------------------------------------------------------------- helpers
KEYS = ["session_key"]
META = ["meeting_key", "year", "meeting_name"]



def _grid(spark, d, meta=False):
    carry = META if meta else []
    spec = grid_spec(D.sessions(spark, d), KEYS, D.GRID_S, carry=carry)
    return spec, build_grid(spec, KEYS, D.GRID_S, carry=carry)


def _grid_basic(spark, d):
    spec, g = _grid(spark, d)
    return spec, g.select("session_key", K, "timestamp")


# ---------------------------------------------------------------- grid / time
@register("time_grid", O.TIME_GRID)
def q_time_grid(spark, d):
    return _grid_basic(spark, d)[1]


@register("floor_to_grid", O.FLOOR_TO_GRID)
def q_floor_to_grid(spark, d):
    ev = D.table(spark, d, "events")
    return ev.select("event_id", floor_to_grid("ts", 900, ev.schema["ts"].dataType).alias("ts_floor"))


# ---------------------------------------------------------------- as-of
def _asof(spark, d, direction, tol=None):
    _, g = _grid_basic(spark, d)
    rv = D.messages(spark, d).where(F.col("category") == "view").select(
        "session_key", F.col("date").alias("timestamp"), "value", F.col("event_id").alias("r_event_id"))
    return asof_join(g, rv, on="timestamp", by="session_key", direction=direction,
                     tolerance_seconds=tol, tiebreak="r_event_id")


@register("asof_backward", O.ASOF_BACKWARD)
def q_asof_backward(spark, d):
    return _asof(spark, d, "backward")


@register("asof_forward", O.ASOF_FORWARD)
def q_asof_forward(spark, d):
    return _asof(spark, d, "forward")


@register("asof_nearest", O.ASOF_NEAREST)
def q_asof_nearest(spark, d):
    return _asof(spark, d, "nearest")


@register("asof_tolerance", O.ASOF_TOLERANCE)
def q_asof_tolerance(spark, d):
    return _asof(spark, d, "backward", tol=600)


# ---------------------------------------------------------------- rolling
def _rolling(spark, d, aggs):
    spec, g = _grid_basic(spark, d)
    return rolling_to_grid(g, spec, D.messages(spark, d), KEYS, "date", D.GRID_S, aggs, tiebreak="event_id")


@register("rolling_count", O.ROLLING_COUNT)
def q_rolling_count(spark, d):
    return _rolling(spark, d, [(f"msg_count_{w}s", "count", None, w) for w in (600, 1800, 3600)])


@register("rolling_mean", O.rolling_stat("avg(e.value)", "value_mean_3600s"), ("value_mean_3600s",))
def q_rolling_mean(spark, d):
    return _rolling(spark, d, [("value_mean_3600s", "mean", "value", 3600)])


@register("rolling_max", O.rolling_stat("max(e.value)", "value_max_3600s"), ("value_max_3600s",))
def q_rolling_max(spark, d):
    return _rolling(spark, d, [("value_max_3600s", "max", "value", 3600)])


@register("rolling_min", O.rolling_stat("min(e.value)", "value_min_3600s"), ("value_min_3600s",))
def q_rolling_min(spark, d):
    return _rolling(spark, d, [("value_min_3600s", "min", "value", 3600)])


@register("rolling_std", O.rolling_stat("stddev_pop(e.value)", "value_std_3600s"), ("value_std_3600s",))
def q_rolling_std(spark, d):
    return _rolling(spark, d, [("value_std_3600s", "std", "value", 3600)])


@register("rolling_sum", O.rolling_stat(
    "CASE WHEN count(e.event_id) > 0 THEN coalesce(sum(e.value), 0.0) END", "value_sum_3600s"), ("value_sum_3600s",))
def q_rolling_sum(spark, d):
    return _rolling(spark, d, [("value_sum_3600s", "sum", "value", 3600)])


@register("rolling_distinct", O.rolling_stat(
    "count(DISTINCT CASE WHEN e.event_id IS NOT NULL THEN coalesce(e.driver_number, '') END)", "drivers_3600s"))
def q_rolling_distinct(spark, d):
    return _rolling(spark, d, [("drivers_3600s", "distinct", "driver_number", 3600)])


@register("rolling_timeline", O.ROLLING_TIMELINE, ("click_value_mean_1h",))
def q_rolling_timeline(spark, d):
    m = D.messages(spark, d)
    tl = m.where(F.col("category") == "purchase").select("session_key", "event_id", F.col("date").alias("timestamp"))
    clicks = m.where(F.col("category") == "click").select("session_key", "date", "value")
    return rolling_over_timeline(tl, clicks, KEYS, "timestamp", "date",
                                 [("clicks_1h", "count", None, 3600), ("click_value_mean_1h", "mean", "value", 3600)])


@register("rolling_concat", O.ROLLING_CONCAT)
def q_rolling_concat(spark, d):
    return _rolling(spark, d, [("recent_messages_concat", "concat", "message", 1800)])


@register("keyword_flags", O.KEYWORD_FLAGS)
def q_keyword_flags(spark, d):
    spec, g = _grid_basic(spark, d)
    t = text_block(g, spec, D.messages(spark, d), KEYS, D.GRID_S, count_windows=(), text_window=1800,
                   flags=D.FLAG_PATTERNS, tiebreak="event_id")
    return t.select("session_key", K, *D.FLAG_PATTERNS)


@register("window_entropy", O.WINDOW_ENTROPY, ("category_entropy_1800s",))
def q_window_entropy(spark, d):
    spec, g = _grid_basic(spark, d)
    return entropy_to_grid(g, spec, D.messages(spark, d), KEYS, "date", D.GRID_S, "category", 1800,
                           "category_entropy_1800s", "unique_categories_1800s")


@register("weather_block", O.WEATHER_BLOCK, O.WEATHER_DOUBLES)
def q_weather_block(spark, d):
    spec, g = _grid_basic(spark, d)
    return weather_block(g, spec, D.weather(spark, d), KEYS, D.GRID_S, tolerance_seconds=3600,
                         window_seconds=3600, tiebreak="event_id").drop("timestamp")


@register("position_dynamics", O.POSITION_DYNAMICS, ("driver_position_volatility_28800s",))
def q_position_dynamics(spark, d):
    spec, g = _grid_basic(spark, d)
    out = dynamics_block(g, spec, D.position(spark, d), None, KEYS, D.GRID_S, 14400, 28800, 3600,
                         tiebreak="event_id")
    return out.select("session_key", K, "position_changes_14400s", "driver_position_volatility_28800s")


@register("gap_pack", O.GAP_PACK, ("gap_std_3600s", "pack_density_1_5s", "pack_density_3_0s"))
def q_gap_pack(spark, d):
    spec, g = _grid_basic(spark, d)
    out = dynamics_block(g, spec, None, D.intervals(spark, d), KEYS, D.GRID_S, 14400, 28800, 3600,
                         tiebreak="event_id")
    return out.select("session_key", K, "gap_std_3600s", "pack_density_1_5s", "pack_density_3_0s")


# ---------------------------------------------------------------- events / labels
@register("event_predicate", O.EVENT_PREDICATE)
def q_event_predicate(spark, d):
    return D.messages(spark, d).select("event_id", D.predicate().alias("is_start"))


def _events(spark, d):
    return detect_events(D.messages(spark, d), KEYS, "date", D.predicate(), 300)


@register("event_merge", O.EVENT_MERGE)
def q_event_merge(spark, d):
    return _events(spark, d).select("session_key", "event_us", "event_ts")


def _labels(spark, d):
    spec, g = _grid_basic(spark, d)
    return forward_labels(g, spec, _events(spark, d), KEYS, D.GRID_S, 300, 1800)


@register("forward_labels", O.FORWARD_LABELS, ("time_to_sc_seconds",))
def q_forward_labels(spark, d):
    return _labels(spark, d)


@register("rising_edges", O.RISING_EDGES)
def q_rising_edges(spark, d):
    return rising_edges(_labels(spark, d), KEYS, K).select("session_key", K, "timestamp")


def gold(spark, d):
    return build_features(D.sessions(spark, d), D.messages(spark, d), D.weather(spark, d),
                          D.position(spark, d), D.intervals(spark, d), D.feature_params())


@register("build_features", O.BUILD_FEATURES, O.GOLD_DOUBLES)
def q_build_features(spark, d):
    return gold(spark, d)


# ---------------------------------------------------------------- scored timeline + reports
from riskgrid.functions import predicates as PR  # noqa: E402
from riskgrid.operators import metrics as MT  # noqa: E402
from riskgrid.operators import splits as SP  # noqa: E402
from riskgrid.operators.asof import lookup_with_fallback, nearest_snapshot, split_by_membership  # noqa: E402
from riskgrid.operators.grid import ORIGIN  # noqa: E402
from riskgrid.plans import reports as R  # noqa: E402

NOON_US = 12 * 3600 * 1_000_000


def scored(spark, d):
    """Labels + a deterministic risk score from the 30-minute message count."""
    spec, g = _grid(spark, d, meta=True)
    lab = forward_labels(g, spec, _events(spark, d), KEYS, D.GRID_S, 300, 1800)
    t = rolling_to_grid(lab, spec, D.messages(spark, d), KEYS, "date", D.GRID_S,
                        [("msg_count_1800s", "count", None, 1800)])
    c = F.col("msg_count_1800s").cast("double")
    return t.withColumn("risk_score", c / (c + 5.0))


def _session_noon(spark, d):
    spec = grid_spec(D.sessions(spark, d), KEYS, D.GRID_S)
    return spec.select("session_key", (F.col(ORIGIN) + F.lit(NOON_US)).alias("_at"))


def _orders_y(spark, d):
    o = D.table(spark, d, "orders")
    y = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return o.withColumn("y", y).withColumn("year", F.year("o_orderdate"))


@register("session_list", O.SESSION_LIST)
def q_session_list(spark, d):
    return R.session_list(scored(spark, d))


@register("overview", O.OVERVIEW, ("positive_rate_pct",))
def q_overview(spark, d):
    return R.overview(scored(spark, d))


@register("rate_by_year", O.RATE_BY_YEAR, ("sc_rate_pct",))
def q_rate_by_year(spark, d):
    return R.rate_by(_orders_y(spark, d), "year", session_col="o_custkey", y_col="y")


@register("rate_top30", O.RATE_TOP30, ("sc_rate_pct",))
def q_rate_top30(spark, d):
    o = _orders_y(spark, d).join(D.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return R.rate_top(o, "c_name", 30, session_col="o_custkey", y_col="y")


@register("means_by_year", O.MEANS_BY_YEAR, ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
def q_means_by_year(spark, d):
    li = D.table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    return R.means_by(li, "year", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register("session_risk", O.SESSION_RISK, ("peak_risk",))
def q_session_risk(spark, d):
    return R.session_risk(scored(spark, d))


@register("latest_delta", O.LATEST_DELTA, ("latest_risk", "risk_delta"))
def q_latest_delta(spark, d):
    return R.latest_delta(scored(spark, d))


@register("series_tail", O.SERIES_TAIL, ("risk_score",))
def q_series_tail(spark, d):
    return R.series_tail(scored(spark, d), ["session_key"], K, 10).select("session_key", K, "risk_score")


@register("bbox", O.BBOX)
def q_bbox(spark, d):
    return R.bbox(D.messages(spark, d).withColumn("uid", F.col("driver_number").cast("long")),
                  ["session_key"], "value", "uid")


@register("messages_by_time", O.MESSAGES_BY_TIME)
def q_messages_by_time(spark, d):
    return R.messages_by_time(D.messages(spark, d))


@register("importance_topk", O.IMPORTANCE_TOPK, ("revenue", "relative_pct"))
def q_importance_topk(spark, d):
    li = D.table(spark, d, "lineitem")
    rev = li.groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return R.top_n_with_share(rev, "l_partkey", "revenue", 20)


@register("messages_symmetric", O.MESSAGES_SYMMETRIC)
def q_messages_symmetric(spark, d):
    m = D.messages(spark, d).join(_session_noon(spark, d), "session_key")
    return R.window_around(m, F.col("_at"), 1800, symmetric=True).select(
        "session_key", "event_id", "time", "category", "message")


@register("messages_trailing", O.MESSAGES_TRAILING)
def q_messages_trailing(spark, d):
    m = D.messages(spark, d).join(_session_noon(spark, d), "session_key")
    return R.window_around(m, F.col("_at"), 3600, symmetric=False).select(
        "session_key", "event_id", "time", "category", "message")


@register("replay_cut", O.REPLAY_CUT, ("risk_score",))
def q_replay_cut(spark, d):
    s = scored(spark, d).join(_session_noon(spark, d), "session_key")
    return R.replay_cut(s, "timestamp", F.col("_at")).select("session_key", K, "risk_score")


@register("severity_class", O.SEVERITY_CLASS)
def q_severity_class(spark, d):
    m = D.messages(spark, d)
    return m.select("event_id", PR.message_class().alias("message_class"), PR.flag_class().alias("flag_class"),
                    PR.category_highlight().alias("category_highlight"),
                    PR.highlight_any(["category", "message"], ("error", "signup", "k\": 9")).alias("highlight"),
                    PR.is_intervention_message(needles=("error", "purchase {")).alias("is_intervention"))


@register("risk_band", O.RISK_BAND, ("risk_score",))
def q_risk_band(spark, d):
    s = scored(spark, d)
    return s.select("session_key", K, "risk_score", PR.risk_band("risk_score").alias("risk_band"),
                    PR.rate_band("msg_count_1800s").alias("rate_band"),
                    (F.col("risk_score") > 0.5).alias("high_risk_point"))


@register("session_selector", O.SESSION_SELECTOR)
def q_session_selector(spark, d):
    s = D.sessions(spark, d)
    return s.where((F.col("year") == 2024) & (F.col("meeting_name") == "Monday")).select("session_key").distinct()


@register("union_by_name", O.UNION_BY_NAME)
def q_union_by_name(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    e = D.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("amount"),
                                           F.col("event_type").alias("kind"))
    return o.unionByName(e, allowMissingColumns=True)


@register("distinct_values", O.DISTINCT_VALUES)
def q_distinct_values(spark, d):
    return D.table(spark, d, "events").select("event_type").distinct()


@register("nearest_snapshot", O.NEAREST_SNAPSHOT)
def q_nearest_snapshot(spark, d):
    m = D.messages(spark, d).join(_session_noon(spark, d), "session_key")
    return nearest_snapshot(m, "date", "driver_number", "_at", 7200, ["value", "event_id"], group_cols=["session_key"])


@register("lookup_fallback", O.LOOKUP_FALLBACK)
def q_lookup_fallback(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lookup_with_fallback(o, D.table(spark, d, "customer"), "o_custkey", "c_custkey", "c_name", "label",
                                order_col="c_custkey")


@register("membership_split", O.MEMBERSHIP_SPLIT)
def q_membership_split(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    test_c = D.table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("o_custkey"))
    train, test = split_by_membership(o, test_c, "o_custkey")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


# ---------------------------------------------------------------- splits
@register("temporal_split", O.TEMPORAL_SPLIT)
def q_temporal_split(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return SP.temporal_split(o, "o_custkey", "o_orderdate", 0.2).select("o_orderkey", "split")


@register("nested_split", O.NESTED_SPLIT)
def q_nested_split(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return SP.nested_split(o, "o_custkey", "o_orderdate", 0.2, 0.15).select("o_orderkey", "split")


@register("group_kfold", O.GROUP_KFOLD)
def q_group_kfold(spark, d):
    o = D.table(spark, d, "orders").join(D.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return SP.group_kfold(o, "c_nationkey", 5)


# ---------------------------------------------------------------- metrics
def _doc_scores(spark, d):
    lab = D.table(spark, d, "labels")
    doc = D.table(spark, d, "documents")
    j = lab.join(doc, "doc_id")
    return j.select("doc_id", F.col("toxic").alias("y"),
                    (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("p"))


@register("rank_metrics", O.RANK_METRICS, ("pr_auc", "roc_auc", "brier_score", "positive_rate"))
def q_rank_metrics(spark, d):
    return MT.rank_metrics(_doc_scores(spark, d), "y", "p")


@register("pr_curve", O.PR_CURVE, ("threshold", "precision", "recall"))
def q_pr_curve(spark, d):
    return MT.pr_curve(_doc_scores(spark, d), "y", "p")


@register("roc_curve", O.ROC_CURVE, ("threshold", "fpr", "tpr"))
def q_roc_curve(spark, d):
    return MT.roc_curve(_doc_scores(spark, d), "y", "p")


@register("calibration", O.CALIBRATION, ("prob_true", "prob_pred"))
def q_calibration(spark, d):
    return MT.calibration(_doc_scores(spark, d), "y", "p", 10)


@register("alert_policy", O.ALERT_POLICY)
def q_alert_policy(spark, d):
    return MT.alert_policy(scored(spark, d), "session_key", "y_sc_5m", "risk_score", "time_to_sc_seconds")


# ---------------------------------------------------------------- text vectors
from riskgrid.operators import text_vectors as TV  # noqa: E402


@register("tfidf_weights", O.TFIDF_WEIGHTS, ("weight",))
def q_tfidf_weights(spark, d):
    w, _ = TV.tfidf(D.table(spark, d, "documents"), "doc_id", "text")
    return w


@register("tfidf_vocabulary", O.TFIDF_VOCAB, ("idf",))
def q_tfidf_vocabulary(spark, d):
    _, v = TV.tfidf(D.table(spark, d, "documents"), "doc_id", "text")
    return v


# ---------------------------------------------------------------- bronze / sources
from riskgrid.functions.predicates import coerce_double, rainfall_double  # noqa: E402
from riskgrid.functions.time import parse_ts  # noqa: E402
from riskgrid.sources import bronze as BZ  # noqa: E402

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _iso_sessions(spark, d):
    s = D.sessions(spark, d)
    return s.withColumn("date_start", F.date_format("date_start", ISO)).withColumn("date_end", F.date_format("date_end", ISO))


def _offsets(spark, d, where=None):
    m = D.messages(spark, d)
    if where is not None:
        m = m.where(where)
    start = grid_spec(D.sessions(spark, d), KEYS, D.GRID_S).select("session_key", F.col(ORIGIN).alias("_s"))
    return BZ.event_offsets(m.join(start, "session_key"), "date", "_s")


@register("bronze_standardise", O.BRONZE_STANDARDISE)
def q_bronze_standardise(spark, d):
    raw = _offsets(spark, d).select("session_key", F.col("offset_us").alias("Time"), F.col("message").alias("Message"),
                                    F.col("category").alias("Category"), F.col("flag").alias("Flag"),
                                    F.col("driver_number").alias("RacingNumber"))
    return BZ.standardise_race_control(raw, _iso_sessions(spark, d))


@register("session_bounds", O.SESSION_BOUNDS)
def q_session_bounds(spark, d):
    laps = _offsets(spark, d, F.col("category") == "click")
    weather = _offsets(spark, d, F.col("category") == "view")
    s = _iso_sessions(spark, d).drop("date_end")
    return BZ.session_bounds(s, laps, weather)


@register("anti_ingest", O.ANTI_INGEST)
def q_anti_ingest(spark, d):
    m = D.messages(spark, d)
    existing = m.where((F.col("category") == "signup") & (F.col("value") > 300)).select("session_key")
    return BZ.not_yet_ingested(D.sessions(spark, d), existing).select("session_key")


@register("session_keys", O.SESSION_KEYS)
def q_session_keys(spark, d):
    o = D.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"),
                                           F.month("o_orderdate").alias("round_number")).distinct()
    return BZ.session_keys(o).select("session_key", "meeting_key", "year", "round_number")


@register("coerce_values", O.COERCE_VALUES)
def q_coerce_values(spark, d):
    ev = D.table(spark, d, "events")
    raw_rain = (F.when(F.col("value") > 300, F.lit("true")).when(F.col("value") < 10, F.lit("False"))
                .otherwise(F.col("value").cast("string")))
    return ev.select("event_id", coerce_double(F.get_json_object("props", "$.k")).alias("k"),
                     rainfall_double(raw_rain).alias("rainfall"))


@register("parse_timestamps", O.PARSE_TIMESTAMPS)
def q_parse_timestamps(spark, d):
    ev = D.table(spark, d, "events")
    iso = F.date_format("ts", ISO)
    s = (F.when(F.col("event_type") == "view", F.concat(iso, F.lit("Z")))
         .when(F.col("event_type") == "click", F.concat(iso, F.lit("+02:00")))
         .when(F.col("event_type") == "error", F.lit("not a time"))
         .otherwise(iso))
    return ev.select("event_id", parse_ts(s).alias("parsed"))


# ---------------------------------------------------------------- models (rows-only checks)
from riskgrid.operators import models as MD  # noqa: E402
from riskgrid.operators import row_blocks as RB  # noqa: E402
from riskgrid.plans import scoring as SR  # noqa: E402
from riskgrid.plans import training as TR  # noqa: E402
from riskgrid.session import written  # noqa: E402


def _model_input(spark, d):
    return TR.split(gold(spark, d)).checkpoint()


@register("logreg_scores", None)
def q_logreg_scores(spark, d):
    s = _model_input(spark, d)
    fit = TR.fit_baseline(s.where(F.col("split") != "test"))
    return TR.score(fit, s.where(F.col("split") == "test")).select("session_key", K, TR.LABEL, "prob")


@register("gbt_scores", None)
def q_gbt_scores(spark, d):
    s = _model_input(spark, d)
    fit = TR.fit_boosted(s.where(F.col("split") == "inner"), s.where(F.col("split") == "val"))
    return TR.score(fit, s.where(F.col("split") == "test")).select("session_key", K, TR.LABEL, "prob")


@register("svd_components", None)
def q_svd_components(spark, d):
    docs = D.table(spark, d, "documents")
    tm, rows = MD.fit_text_weights(docs, "doc_id", "text")
    v = MD.fit_svd(rows, "doc_id", tm.size, 100)
    return MD.svd_project(rows, "doc_id", v, 100, rows=docs)


@register("model_evaluation", None)
def q_model_evaluation(spark, d):
    s = _model_input(spark, d)
    fit = TR.fit_baseline(s.where(F.col("split") != "test"))
    return TR.run_evaluation({"baseline": fit}, s.where(F.col("split") == "test"))["metrics"]


def _evaluated(spark, d):
    """Two scores that SQL can repeat: the message-count risk and one from the grid point alone."""
    s = scored(spark, d).checkpoint()
    by_time = F.col(K) / (F.col(K) + 100.0)
    return TR.evaluate({"baseline": s.withColumn("prob", by_time), "boosted": s.withColumn("prob", F.col("risk_score"))})


@register("evaluation_metrics", O.EVALUATION_METRICS, ("pr_auc", "roc_auc", "brier_score", "positive_rate"))
def q_evaluation_metrics(spark, d):
    return _evaluated(spark, d)["metrics"]


@register("evaluation_policy", O.EVALUATION_POLICY)
def q_evaluation_policy(spark, d):
    return _evaluated(spark, d)["policy"]


@register("report_header", O.REPORT_HEADER)
def q_report_header(spark, d):
    return _evaluated(spark, d)["header"]


def _lines_split(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    y = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return SP.nested_split(o, "o_custkey", "o_orderdate", 0.2, 0.15).withColumn("y", y)


@register("scaled_features", O.SCALED_FEATURES, ("z_o_totalprice", "z_o_custkey"))
def q_scaled_features(spark, d):
    """M3: every order, scaled by the statistics of the inner rows."""
    s = _lines_split(spark, d)
    fit = MD.fit_scaler(s.where(F.col("split") == "inner"), ["o_totalprice", "o_custkey"])
    return fit.transform(s).select("o_orderkey", "z_o_totalprice", "z_o_custkey")


@register("class_weights", O.CLASS_WEIGHTS, ("w",))
def q_class_weights(spark, d):
    """M6/M7: balanced weights counted on the inner rows, for inner and validation rows."""
    s = _lines_split(spark, d).where(F.col("split") != "test")
    return MD.with_balanced_weights(s, "y", train=s.where(F.col("split") == "inner")).select("o_orderkey", "y", "w")


@register("svd_orthonormal", O.SVD_ORTHONORMAL, ("dot",))
def q_svd_orthonormal(spark, d):
    """M2: VᵀV of a ten-column basis of the documents' text vectors, by pair of columns."""
    docs = D.table(spark, d, "documents")
    tm, w = MD.fit_text_weights(docs, "doc_id", "text")
    v = MD.fit_svd(w, "doc_id", tm.size, 10)
    x = v.select("index", F.posexplode(MD.vector_to_array("vec")).alias("i", "a")).checkpoint()
    pair = x.join(x.select("index", F.col("i").alias("j"), F.col("a").alias("b")), "index")
    return pair.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))


@register("svd_moments", O.SVD_MOMENTS, ("value",))
def q_svd_moments(spark, d):
    """M2: power sums of the squared singular values (over the documents) of the text vectors
    of 40 terms, from all their right vectors: sign-free and equal to traces of (XᵀX)ᵖ."""
    docs = D.table(spark, d, "documents")
    tm, rows = MD.fit_text_weights(docs, "doc_id", "text", 40)
    projected = MD.svd_project(rows, "doc_id", MD.fit_svd(rows, "doc_id", tm.size, 40), 40)
    squares = projected.select(F.posexplode(MD.vector_to_array("svd")).alias("i", "y")).groupBy("i").agg(F.sum(F.col("y") * F.col("y")).alias("s"))
    share = squares.select((F.col("s") / F.lit(float(docs.count()))).alias("s"))
    powers = share.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.pow("s", F.lit(p)).alias("x")) for p in (1, 2, 3)])).alias("m"))
    return powers.groupBy("m.p").agg(F.sum("m.x").alias("value"))


@register("risk_series", O.RISK_SERIES)
def q_risk_series(spark, d):
    return R.risk_series(scored(spark, d))


@register("session_report", O.SESSION_REPORT, ("peak_risk",))
def q_session_report(spark, d):
    """A6 without a model: every session's risk from its labels, with its event starts."""
    out = SR.session_report(SR.with_risk(_labels(spark, d), None))
    starts = F.transform("sc_event_starts", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    return out.withColumn("sc_event_starts", F.array_join(starts, ","))


@register("positive_windows", O.POSITIVE_WINDOWS)
def q_positive_windows(spark, d):
    return R.positive_windows(scored(spark, d)).select("session_key", K, "timestamp")


@register("first_sessions", O.FIRST_SESSIONS)
def q_first_sessions(spark, d):
    return BZ.first_sessions(D.sessions(spark, d), 10).select("session_key", "date_start")


# ---------------------------------------------------------------- ingestion job
import uuid  # noqa: E402

from riskgrid.session import ensure_checkpoint_dir  # noqa: E402
from riskgrid.sources import ingest as IN  # noqa: E402
from riskgrid.sources import session_catalogue as SC  # noqa: E402

INGESTED = ("race_control", "weather", "intervals")


def _ingested(spark, d) -> str:
    """Events landed as JSON lines, some cut short, some without time or with a session that
    does not exist, no ``intervals`` at all; ingested twice. The folder of the bronze tables."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    when = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    landed = {"race_control": (D.messages(spark, d).withColumn("v", F.col("value")), ["category", "message", "flag"]),
              "weather": (D.weather(spark, d).withColumn("v", F.col("track_temperature")).withColumn("rainfall", F.col("rainfall").cast("string")), ["rainfall", "air_temperature", "track_temperature"])}
    for table, (rows, columns) in landed.items():
        key = F.when(F.col("v") >= 400, F.lit(7)).otherwise(F.col("session_key"))
        record = F.to_json(F.struct(key.alias("session_key"), F.when(F.col("v") < 20, "").otherwise(when).alias("date"), *columns))
        line = F.when(F.col("v").between(100, 130), F.substring(record, F.lit(1), F.length(record) - 3)).otherwise(record)
        rows.select(line.alias("value")).write.text(f"{folder}/landed/{table}")
    sessions = D.sessions(spark, d).checkpoint()
    for _ in range(2):
        IN.ingest(spark, f"{folder}/landed", f"{folder}/bronze", sessions, INGESTED)
    return f"{folder}/bronze"


@register("ingest_log", O.INGEST_LOG)
def q_ingest_log(spark, d):
    return IN.ingest_log(spark, _ingested(spark, d)).select("table_name", "session_key", "status", "written", "rejected")


@register("rejected_records", O.REJECTED_RECORDS)
def q_rejected_records(spark, d):
    rows = IN.rejected_records(spark, _ingested(spark, d))
    return rows.groupBy("table_name", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_key").alias("sessions"))


@register("session_catalogue", O.SESSION_CATALOGUE)
def q_session_catalogue(spark, d):
    return SC.catalogue(spark, _ingested(spark, d), "race_control")
