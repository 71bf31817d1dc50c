"""Operator properties: brute-force equivalence, leakage, boundaries."""
import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from riskgrid.operators import metrics as MT
from riskgrid.operators import splits as SP
from riskgrid.operators.asof import asof_join, asof_to_grid
from riskgrid.operators.grid import build_grid, grid_spec
from riskgrid.operators.ordered import exact_median, prefix_sums
from riskgrid.plans.features import build_features
from tests.conftest import B

S = dt.timedelta(seconds=1)


def _brute_ap_auc(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    N = len(y) - P
    ap = auc = 0.0
    ctp = 0
    for thr in order:
        tp = sum(1 for a, b in zip(y, p) if b == thr and a == 1)
        fp = sum(1 for a, b in zip(y, p) if b == thr and a == 0)
        ctp_prev = ctp
        ctp += tp
        cfp = sum(1 for a, b in zip(y, p) if b >= thr and a == 0)
        ap += tp / P * ctp / (ctp + cfp)
        auc += fp * (ctp_prev + tp / 2) / (P * N)
    return ap, auc


def test_rank_metrics_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 1), rnd.choice([0.1, 0.2, 0.25, 0.5, 0.7, 0.9]) + rnd.choice([0, 0, 0.01]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, p double")
    r = MT.rank_metrics(df, "y", "p").first()
    ap, auc = _brute_ap_auc([x[1] for x in rows], [x[2] for x in rows])
    assert abs(r.pr_auc - ap) < 1e-12 and abs(r.roc_auc - auc) < 1e-12
    assert abs(r.brier_score - np.mean([(x[2] - x[1]) ** 2 for x in rows])) < 1e-12


def test_calibration_right_closed(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.1000001), (1, 1.0), (0, 0.0)], "y int, p double")
    bins = {r.bin: (r.prob_true, r.prob_pred) for r in MT.calibration(df, "y", "p").collect()}
    assert set(bins) == {0, 1, 9}
    assert bins[0][0] == 0.5  # 0.0 and 0.1 share the first bin


def test_prefix_sums_and_median(spark):
    df = spark.createDataFrame([(g, float(v)) for g in ("a", "b") for v in range(1, 8 if g == "a" else 5)],
                               "g string, v double")
    ps = {(r.g, r.v): r.c for r in prefix_sums(df, [F.col("g"), F.col("v")], {"c": F.lit(1)}, ["g"]).collect()}
    assert ps[("a", 7.0)] == 7 and ps[("b", 1.0)] == 1 and ps[("b", 4.0)] == 4
    med = {r.g: r.median for r in exact_median(df, ["g"], "v").collect()}
    assert med == {"a": 4.0, "b": 2.5}


def test_temporal_split_and_kfold(spark):
    rows = [(i, g, B + dt.timedelta(days=g)) for i, g in enumerate([1, 1, 2, 3, 3, 3, 4, 5, 6, 7, 8, 9, 10, 10])]
    df = spark.createDataFrame(rows, "id long, g long, t timestamp_ntz")
    test = {r.g for r in SP.temporal_split(df, "g", "t", 0.2).where("split = 'test'").collect()}
    assert test == {9, 10}  # int(10 * 0.2) = 2 latest groups
    folds = {r.g: r.fold for r in SP.group_kfold(df, "g", 3).collect()}
    loads = [0, 0, 0]
    sizes = df.groupBy("g").count().collect()
    for r in sorted(sizes, key=lambda r: (-r["count"], r.g)):
        k = loads.index(min(loads))
        assert folds[r.g] == k
        loads[k] += r["count"]


def test_asof_generic_matches_grid_path(spark, sessions):
    spec = grid_spec(sessions, ["session_key"], 30)
    g = build_grid(spec, ["session_key"], 30)
    rnd = random.Random(3)
    right = spark.createDataFrame([(9158, B + S * rnd.randint(-100, 3700), float(i), i) for i in range(80)],
                                  "session_key long, date timestamp_ntz, v double, rid long")
    for direction in ("backward", "forward", "nearest"):
        a = asof_join(g, right.withColumnRenamed("date", "timestamp"), by="session_key", direction=direction,
                      tolerance_seconds=120, tiebreak="rid", bucket_seconds=600)
        b = asof_to_grid(g, spec, right, ["session_key"], "date", 30, ["v", "rid"], direction,
                         tolerance_seconds=120, tiebreak="rid")
        ka = {r.grid_k: (r.v, r.rid) for r in a.collect()}
        kb = {r.grid_k: (r.v, r.rid) for r in b.collect()}
        assert ka == kb, direction


def _race(spark, extra_minutes=0):
    rc = [(9158, B + dt.timedelta(minutes=m), msg, cat, flag) for m, msg, cat, flag in [
        (5, "YELLOW FLAG IN SECTOR 2", "Flag", "YELLOW"), (10, "SAFETY CAR DEPLOYED", "SafetyCar", "SC"),
        (12, "CAR 4 STOPPED", "Other", ""), (30, "RED FLAG", "Flag", "RED"),
        (40, "VIRTUAL SAFETY CAR DEPLOYED", "Vsc", "VSC")]]
    if extra_minutes:
        rc.append((9158, B + dt.timedelta(minutes=extra_minutes), "DEBRIS ON TRACK", "Other", ""))
    rc = spark.createDataFrame(rc, "session_key long, date timestamp_ntz, message string, category string, flag string")
    w = spark.createDataFrame([(9158, B + dt.timedelta(minutes=i), 0.0 if i < 20 else 1.0, 35.0 + 0.1 * i, 25.0,
                                5.0, 60.0, 1013.0) for i in range(60)],
                              "session_key long, date timestamp_ntz, rainfall double, track_temperature double, "
                              "air_temperature double, wind_speed double, humidity double, pressure double")
    pos = spark.createDataFrame([(9158, B + dt.timedelta(seconds=20 * i), str(d), str((i + d) % 5 + 1))
                                 for i in range(150) for d in (1, 2, 3)],
                                "session_key long, date timestamp_ntz, driver_number string, position string")
    iv = spark.createDataFrame([(9158, B + dt.timedelta(seconds=15 * i), str(d), str(1.0 * d + i % 3), "+1 LAP" if d == 3 else str(0.5 * d))
                                for i in range(200) for d in (1, 2, 3)],
                               "session_key long, date timestamp_ntz, driver_number string, gap_to_leader string, interval string")
    return rc, w, pos, iv


def test_no_leakage_from_future_rows(spark, sessions):
    base = build_features(sessions, *_race(spark)).drop("y_sc_5m", "time_to_sc_seconds")
    later = build_features(sessions, *_race(spark, extra_minutes=50)).drop("y_sc_5m", "time_to_sc_seconds")
    cut = B + dt.timedelta(minutes=50) - S
    # floats compared to 9 significant digits: sums over partitions may differ in the last bit
    def norm(row):
        return tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in row)
    a = sorted(norm(r) for r in base.where(F.col("timestamp") <= cut).collect())
    b = sorted(norm(r) for r in later.where(F.col("timestamp") <= cut).collect())
    assert a == b and len(a) == 100


def test_feature_build_shapes(spark, sessions):
    gold = build_features(sessions, *_race(spark))
    rows = {r.grid_k: r for r in gold.collect()}
    assert len(rows) == 120
    assert rows[20].msg_count_60s == 1 and rows[20].recent_messages_concat == "SAFETY CAR DEPLOYED"
    assert rows[20].yellow_flag == 1 or rows[20].msg_count_600s >= 2
    assert rows[0].rainfall == 0.0 and rows[0].max_rainfall_5m == 0.0
    assert rows[119].track_temp_delta_5m is not None
    assert rows[0].driver_position_volatility_300s is None  # rows in window, but no driver has a pair
    assert rows[10].driver_position_volatility_300s > 0 and rows[10].position_changes_120s > 0
    assert all(r.gap_std_120s is None or r.gap_std_120s >= 0 for r in rows.values())
    assert sum(r.y_sc_5m for r in rows.values()) > 0


def _anchored(times, w):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] > w:
            out.append(t)
    return out


def test_event_merge_matches_brute_force(spark):
    from riskgrid.functions.time import us_col
    from riskgrid.operators.events import detect_events
    from riskgrid.plans import driver_tables as D
    m = D.messages(spark, "/root/testdata/sf0.001").where(D.predicate())
    per = {}
    for r in m.select("session_key", us_col(m, "date").alias("u")).collect():
        per.setdefault(r.session_key, []).append(r.u)
    want = sorted((k, t) for k, ts in per.items() for t in _anchored(ts, 300_000_000))
    ev = detect_events(m, ["session_key"], "date", None, 300)
    assert sorted(tuple(r) for r in ev.select("session_key", "event_us").collect()) == want and want


def test_event_merge_long_chain(spark):
    from riskgrid.operators.events import detect_events
    # one message every 100 s for 3 hours: anchors every 400 s (0, 400, 800, ...)
    df = spark.createDataFrame([(1, B + dt.timedelta(seconds=100 * i), i) for i in range(108)],
                               "session_key long, date timestamp_ntz, id long")
    got = sorted(r.event_ts for r in detect_events(df, ["session_key"]).collect())
    assert got == [B + dt.timedelta(seconds=400 * j) for j in range(27)]


def test_event_merge_repeated_times_do_not_grow(spark, monkeypatch):
    """Many messages at each instant: no table of the doubling rounds has more rows than there are instants."""
    from riskgrid.operators.events import detect_events
    rnd = random.Random(3)
    times = sorted({rnd.randint(0, 6000) for _ in range(200)})
    df = spark.createDataFrame([(k, B + dt.timedelta(seconds=t)) for k in (1, 2) for t in times for _ in range(5)],
                               "session_key long, date timestamp_ntz")
    rows, plain = [], type(df).checkpoint

    def counted(self, *a, **kw):
        out = plain(self, *a, **kw)
        rows.append(out.count())
        return out
    monkeypatch.setattr(type(df), "checkpoint", counted)
    got = sorted(tuple(r) for r in detect_events(df, ["session_key"], bucket_seconds=350).select(
        "session_key", "event_ts").collect())
    assert got == [(k, B + dt.timedelta(seconds=t)) for k in (1, 2) for t in _anchored(times, 300)]
    assert len(rows) > 4 and max(rows) <= 2 * len(times)


def test_bucket_width_sees_bursts(spark):
    from riskgrid.operators.ordered import auto_bucket_seconds
    u = F.when(F.col("id") < 9_000, F.col("id") * 1_000).otherwise(F.lit(2 * 365 * 86400 * 1_000_000))
    df = spark.range(9_001).select(F.lit(1).alias("k"), u.alias("u"))  # 9 000 rows in 9 s, one two years on
    width = auto_bucket_seconds(df, ["k"], "u", target_rows=3_000)
    full = df.groupBy("k", F.floor(F.col("u") / (width * 1_000_000))).count().agg(F.max("count")).first()[0]
    assert full <= 3_000


def test_edges_do_not_depend_on_buckets(spark):
    from riskgrid.operators.events import rising_edges
    rnd = random.Random(8)
    rows = [(s, k, rnd.choice((0, 1, 1, None))) for s in (1, 2, None) for k in range(-5, 60)]
    df = spark.createDataFrame(rows, "s int, k long, y int")
    want = sorted((str(s), k) for i, (s, k, y) in enumerate(rows) if y == 1 and (k == -5 or rows[i - 1][2] != 1))
    for bucket in (1, 7, 1_000_000):
        assert sorted((str(r.s), r.k) for r in rising_edges(df, ["s"], "k", "y", bucket).collect()) == want


def test_event_merge_tiny_buckets_match(spark):
    from riskgrid.operators.events import detect_events
    from riskgrid.plans import driver_tables as D
    m = D.messages(spark, "/root/testdata/sf0.001")
    chain = spark.createDataFrame([(1, B + dt.timedelta(seconds=70 * i), i) for i in range(60)],
                                  "session_key long, date timestamp_ntz, event_id long")
    for src, pred in ((m, D.predicate()), (chain, None)):
        a = detect_events(src, ["session_key"], "date", pred, 300)
        b = detect_events(src, ["session_key"], "date", pred, 300, bucket_seconds=150)
        ka = sorted(tuple(r) for r in a.select("session_key", "event_us").collect())
        kb = sorted(tuple(r) for r in b.select("session_key", "event_us").collect())
        assert ka == kb and len(ka) > 0


def test_tables_without_session_apply_to_every_session(spark, sessions):
    from riskgrid.plans.features import dynamics_block, weather_block
    two = sessions.unionByName(sessions.withColumn("session_key", F.lit(9159).cast("long")))
    spec = grid_spec(two, ["session_key"], 30)
    g = build_grid(spec, ["session_key"], 30)
    rc, w, pos, iv = _race(spark)
    a = weather_block(g, spec, w.drop("session_key"), ["session_key"], 30).orderBy("session_key", "grid_k")
    rows = a.collect()
    per = {}
    for r in rows:
        per.setdefault(r.session_key, []).append((r.grid_k, r.rainfall, r.track_temperature, r.max_rainfall_5m))
    assert per[9158] == per[9159] and len(per[9158]) == 120
    with_key = weather_block(g.where("session_key = 9158"), spec, w, ["session_key"], 30).orderBy("grid_k").collect()
    assert [(r.grid_k, r.rainfall, r.track_temperature, r.max_rainfall_5m) for r in with_key] == per[9158]
    d = dynamics_block(g, spec, pos.drop("session_key"), iv.drop("session_key"), ["session_key"], 30)
    dd = {}
    for r in d.collect():
        g = None if r.gap_std_120s is None else round(r.gap_std_120s, 9)
        dd.setdefault(r.session_key, {})[r.grid_k] = (r.position_changes_120s, g)
    assert dd[9158] == dd[9159]


def test_running_last_and_previous_row_bucket_invariant(spark):
    from riskgrid.operators.ordered import previous_row, running_last
    rnd = random.Random(11)
    rows = [(k, rnd.randint(0, 20_000) * 1_000_000, i, (i if rnd.random() < 0.3 else None)) for i in range(300)
            for k in (1,)] + [(2, i * 7_000_000, 1000 + i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, u long, tb long, v long")
    res = {}
    for b in (50, 86400):
        a = running_last(df, ["k"], "u", "tb", F.col("v"), "last_v", bucket_seconds=b)
        p = previous_row(df, ["k"], "u", "tb", ["v"], bucket_seconds=b)
        res[b] = (sorted((r.tb, r.last_v) for r in a.collect()),
                  sorted((r.tb, None if r._prev is None else r._prev.u) for r in p.collect()))
    assert res[50] == res[86400]
    ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    want, last = {}, {}
    for k, u, tb, v in ordered:
        if v is not None:
            last[k] = v
        want[tb] = last.get(k)
    assert dict(res[50][0]) == want


def test_auto_bucket_width_shrinks_for_hot_keys(spark):
    from riskgrid.operators.ordered import auto_bucket_seconds
    hot = spark.createDataFrame([(1, i * 1_000_000) for i in range(10_000)], "k long, u long")  # 1 row/s
    assert 999 <= auto_bucket_seconds(hot, ["k"], "u", target_rows=1_000) <= 1000
    assert auto_bucket_seconds(hot, ["k"], "u", target_rows=10**9) == 30 * 86400


def test_asof_auto_bucket_matches_fixed(spark, sessions):
    spec = grid_spec(sessions, ["session_key"], 30)
    g = build_grid(spec, ["session_key"], 30)
    rnd = random.Random(5)
    right = spark.createDataFrame([(9158, B + S * rnd.randint(-100, 3700), float(i), i) for i in range(200)],
                                  "session_key long, timestamp timestamp_ntz, v double, rid long")
    a = asof_join(g, right, by="session_key", tiebreak="rid")
    b = asof_join(g, right, by="session_key", tiebreak="rid", bucket_seconds=86400)
    assert sorted((r.grid_k, r.v) for r in a.collect()) == sorted((r.grid_k, r.v) for r in b.collect())
