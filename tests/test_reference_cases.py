"""The reference's own unit cases, as Spark tests (isolation asserted for real)."""
import datetime as dt

from pyspark.sql import functions as F

from riskgrid.functions.predicates import is_event_start
from riskgrid.operators.asof import asof_join
from riskgrid.operators.events import detect_events, forward_labels
from riskgrid.operators.grid import build_grid, grid_spec
from riskgrid.operators.rolling import rolling_over_timeline, rolling_to_grid
from tests.conftest import B

M = dt.timedelta(minutes=1)


def _grid(spark, sessions, step=30):
    spec = grid_spec(sessions, ["session_key"], step)
    return spec, build_grid(spec, ["session_key"], step)


def test_grid_120_points(spark, sessions):
    _, g = _grid(spark, sessions)
    assert g.count() == 120
    ts = [r.timestamp for r in g.orderBy("grid_k").collect()]
    assert ts[0] == B and ts[-1] == B + dt.timedelta(seconds=30 * 119)


def test_event_predicate_truth_table(spark):
    rows = [("SafetyCar", "", "SAFETY CAR DEPLOYED"), ("", "VSC", "VSC DEPLOYED"),
            ("", "", "TRACK LIMITS"), ("SafetyCar", "SC", "SAFETY CAR IN THIS LAP"),
            ("", "", "VIRTUAL SAFETY CAR DEPLOYED"), ("", "", "CLEAR IN TRACK SECTOR 3")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, category string, flag string, message string")
    got = [r.p for r in df.select("i", is_event_start().alias("p")).orderBy("i").collect()]
    assert got == [True, True, False, False, True, False]


def test_detect_two_events(spark, race_control):
    ev = detect_events(race_control, ["session_key"], predicate=is_event_start()).orderBy("event_us").collect()
    assert [r.event_ts for r in ev] == [B + 10 * M, B + 40 * M]


def test_detect_contiguous_one_event(spark):
    df = spark.createDataFrame([(1, B + i * M, "SAFETY CAR DEPLOYED", "SafetyCar", "SC") for i in range(3)],
                               "session_key long, date timestamp_ntz, message string, category string, flag string")
    ev = detect_events(df, ["session_key"], predicate=is_event_start()).collect()
    assert [r.event_ts for r in ev] == [B]


def test_detect_none(spark, race_control):
    only_tl = race_control.where(F.col("category") == "TrackLimits")
    assert detect_events(only_tl, ["session_key"], predicate=is_event_start()).count() == 0
    assert detect_events(race_control.limit(0), ["session_key"], predicate=is_event_start()).count() == 0


def test_anchored_not_gap_chain(spark):
    # 0, 200, 400, 600 s: anchor 0 → 400 is > 300 after anchor → emitted; 600 merged into 400.
    df = spark.createDataFrame([(1, B + dt.timedelta(seconds=s)) for s in (0, 200, 400, 600)],
                               "session_key long, date timestamp_ntz")
    ev = detect_events(df, ["session_key"]).orderBy("event_us").collect()
    assert [r.event_ts for r in ev] == [B, B + dt.timedelta(seconds=400)]


def test_labels(spark, sessions):
    spec, g = _grid(spark, sessions)
    ev = spark.createDataFrame([(9158, B + 3 * M)], "session_key long, event_ts timestamp_ntz") \
        .withColumn("event_us", F.unix_micros(F.col("event_ts").cast("timestamp")))
    lab = forward_labels(g, spec, ev, ["session_key"], 30).orderBy("grid_k").collect()
    ys = [r.y_sc_5m for r in lab]
    assert ys[:6] == [1] * 6 and ys[6] == 0 and sum(ys) == 6
    assert lab[0].time_to_sc_seconds == 180.0
    none = forward_labels(g, spec, ev.limit(0), ["session_key"], 30).collect()
    assert all(r.y_sc_5m == 0 and r.time_to_sc_seconds == 1800.0 for r in none)


def test_labels_monotone(spark, sessions):
    spec, g = _grid(spark, sessions)
    ev = spark.createDataFrame([(9158, B + 30 * M)], "session_key long, event_ts timestamp_ntz") \
        .withColumn("event_us", F.unix_micros(F.col("event_ts").cast("timestamp")))
    lab = forward_labels(g, spec, ev, ["session_key"], 30).orderBy("grid_k").collect()
    tte = [r.time_to_sc_seconds for r in lab if r.timestamp < B + 30 * M]
    assert all(a >= b for a, b in zip(tte, tte[1:]))


def _tl(spark, times, key=1):
    return spark.createDataFrame([(key, t) for t in times], "session_key long, timestamp timestamp_ntz")


def _ev(spark, rows, key=1):
    return spark.createDataFrame([(key, t, v) for t, v in rows], "session_key long, ts timestamp_ntz, val double")


def test_rolling_count_and_bounds(spark):
    tl = _tl(spark, [B + i * M for i in range(10)])
    ev = _ev(spark, [(B + M, 1.0), (B + 2 * M, 1.0), (B + 3 * M, 1.0)])
    r = rolling_over_timeline(tl, ev, ["session_key"], "timestamp", "ts", [("n", "count", None, 300)])
    got = {row.timestamp: row.n for row in r.collect()}
    assert got[B + 5 * M] == 3
    none = rolling_over_timeline(tl, ev.limit(0), ["session_key"], "timestamp", "ts", [("n", "count", None, 300)])
    assert all(row.n == 0 for row in none.collect())
    lo = rolling_over_timeline(_tl(spark, [B + M]), _ev(spark, [(B, 1.0)]), ["session_key"], "timestamp", "ts",
                               [("n", "count", None, 60)]).collect()
    assert lo[0].n == 0
    hi = rolling_over_timeline(_tl(spark, [B + M]), _ev(spark, [(B + M, 1.0)]), ["session_key"], "timestamp", "ts",
                               [("n", "count", None, 60)]).collect()
    assert hi[0].n == 1


def test_rolling_mean_max_empty(spark):
    ev = _ev(spark, [(B + i * M, 10.0 * (i + 1)) for i in range(5)])
    r = rolling_over_timeline(_tl(spark, [B + 5 * M]), ev, ["session_key"], "timestamp", "ts",
                              [("m", "mean", "val", 300)]).collect()
    assert r[0].m == 35.0
    ev2 = _ev(spark, [(B, 5.0), (B + M, 15.0), (B + 2 * M, 25.0)])
    r = rolling_over_timeline(_tl(spark, [B + 3 * M]), ev2, ["session_key"], "timestamp", "ts",
                              [("m", "max", "val", 300)]).collect()
    assert r[0].m == 25.0
    r = rolling_over_timeline(_tl(spark, [B + 60 * M]), _ev(spark, [(B + 60 * M + dt.timedelta(hours=1), 1.0)]),
                              ["session_key"], "timestamp", "ts", [("m", "mean", "val", 60)]).collect()
    assert r[0].m is None


def test_rolling_grid_matches_timeline_form(spark, sessions):
    spec, g = _grid(spark, sessions)
    ev = spark.createDataFrame([(9158, B + dt.timedelta(seconds=17 * i), float(i % 7)) for i in range(200)],
                               "session_key long, ts timestamp_ntz, val double")
    aggs = [("n", "count", None, 60), ("s", "sum", "val", 180), ("mx", "max", "val", 120),
            ("sd", "std", "val", 300), ("d", "distinct", "val", 600)]
    a = rolling_to_grid(g, spec, ev, ["session_key"], "ts", 30, aggs)
    b = rolling_over_timeline(g, ev, ["session_key"], "timestamp", "ts", aggs, bucket_seconds=600)
    ka = {r.grid_k: (r.n, r.s, r.mx, round(r.sd, 9), r.d) for r in a.collect()}
    kb = {r.grid_k: (r.n, r.s, r.mx, round(r.sd, 9), r.d) for r in b.collect()}
    assert ka == kb and len(ka) == 120


def test_asof_basic_and_isolation(spark):
    left = spark.createDataFrame([(1, B + i * M) for i in range(10)] + [(2, B + i * M) for i in range(3)],
                                 "session_key long, timestamp timestamp_ntz")
    right = spark.createDataFrame([(1, B, 10.0), (1, B + 3 * M, 20.0), (1, B + 7 * M, 30.0)],
                                  "session_key long, timestamp timestamp_ntz, value double")
    r = asof_join(left, right, by="session_key").collect()
    got = {(x.session_key, x.timestamp): x.value for x in r}
    assert got[(1, B)] == 10.0 and got[(1, B + M)] == 10.0 and got[(1, B + 3 * M)] == 20.0
    assert got[(1, B + 7 * M)] == 30.0
    assert all(got[(2, B + i * M)] is None for i in range(3))


def test_asof_nothing_before(spark):
    left = spark.createDataFrame([(1, B - 5 * M), (1, B)], "session_key long, timestamp timestamp_ntz")
    right = spark.createDataFrame([(1, B, 42.0)], "session_key long, timestamp timestamp_ntz, value double")
    got = {x.timestamp: x.value for x in asof_join(left, right, by="session_key").collect()}
    assert got[B - 5 * M] is None and got[B] == 42.0


US1 = dt.timedelta(microseconds=1)


def test_label_boundaries_to_the_microsecond(spark, sessions):
    spec, g = _grid(spark, sessions)
    t0 = B + 10 * M  # a grid point
    evs = [t0, t0 + dt.timedelta(seconds=300), t0 + dt.timedelta(seconds=300) + US1]
    for e, want_y in zip(evs, (0, 1, 0)):
        ev = spark.createDataFrame([(9158, e)], "session_key long, event_ts timestamp_ntz") \
            .withColumn("event_us", F.unix_micros(F.col("event_ts").cast("timestamp")))
        lab = {r.timestamp: r for r in forward_labels(g, spec, ev, ["session_key"], 30).collect()}
        # event exactly at t is not "after t"; at t+h it is in; one µs later it is out
        assert lab[t0].y_sc_5m == want_y
        if e == t0:
            assert lab[t0].time_to_sc_seconds == 1800.0


def test_rolling_window_bounds_to_the_microsecond(spark, sessions):
    spec, g = _grid(spark, sessions)
    t0 = B + 10 * M
    ev = spark.createDataFrame([(9158, t0 - dt.timedelta(seconds=60)), (9158, t0 - dt.timedelta(seconds=60) + US1),
                                (9158, t0), (9158, t0 + US1), (9158, None)],
                               "session_key long, ts timestamp_ntz")
    r = {x.timestamp: x.n for x in rolling_to_grid(g, spec, ev, ["session_key"], "ts", 30,
                                                    [("n", "count", None, 60)]).collect()}
    assert r[t0] == 2  # (t − 60 s, t]: lower end out, t − 60 s + 1 µs in, t in, t + 1 µs out


def test_asof_exact_match_switch_and_ties(spark):
    left = spark.createDataFrame([(1, B)], "session_key long, timestamp timestamp_ntz")
    right = spark.createDataFrame([(1, B, 1.0, 1), (1, B, 2.0, 2), (1, B - M, 0.5, 0)],
                                  "session_key long, timestamp timestamp_ntz, value double, rid long")
    exact = asof_join(left, right, by="session_key", tiebreak="rid").first()
    strict = asof_join(left, right, by="session_key", tiebreak="rid", allow_exact_matches=False).first()
    assert exact.value == 2.0 and strict.value == 0.5
    fwd = asof_join(left, right, by="session_key", tiebreak="rid", direction="forward").first()
    assert fwd.value == 1.0


def test_asof_right_without_session_applies_to_all(spark):
    left = spark.createDataFrame([(1, B + M), (2, B + 2 * M)], "session_key long, timestamp timestamp_ntz")
    right = spark.createDataFrame([(B, 7.0), (B + 90 * dt.timedelta(seconds=1), 8.0)], "timestamp timestamp_ntz, v double")
    got = {r.session_key: r.v for r in asof_join(left, right, by=[]).collect()}
    assert got == {1: 7.0, 2: 8.0}
