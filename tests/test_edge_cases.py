"""Null keys, wide tiebreaks, repeated sessions, rounding, panes of odd widths."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.functions.predicates import round_exact, round_scaled
from riskgrid.operators.asof import asof_join
from riskgrid.operators.grid import K, build_grid, grid_spec
from riskgrid.operators.ordered import exact_median, previous_row, running_last
from riskgrid.operators.rolling import rolling_to_grid
from riskgrid.sources import bronze as BZ
from tests.conftest import B


def at(seconds):
    return B + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("bucket", [60, 86400])
def test_null_keys_match_at_any_width(spark, bucket):
    left = spark.createDataFrame([(1, None, at(600)), (2, "a", at(600)), (3, None, at(0))], "id long, k string, timestamp timestamp_ntz")
    right = spark.createDataFrame([(None, at(30), 5.0), ("a", at(40), 6.0)], "k string, timestamp timestamp_ntz, v double")
    got = {r.id: r.v for r in asof_join(left, right, by="k", bucket_seconds=bucket).collect()}
    assert got == {1: 5.0, 2: 6.0, 3: None}
    ahead = {r.id: r.v for r in asof_join(left, right, by="k", direction="forward", bucket_seconds=bucket).collect()}
    assert ahead == {1: None, 2: None, 3: 5.0}
    rows = spark.createDataFrame([(None, 0, 1), (None, 700_000_000, 2), ("a", 0, 3)], "k string, u long, v int")
    prev = {r.v: r._prev and r._prev.v for r in previous_row(rows, ["k"], "u", None, ["v"], bucket_seconds=bucket).collect()}
    assert prev == {1: None, 2: 1, 3: None}
    last = {r.v: r.x for r in running_last(rows, ["k"], "u", None, F.when(F.col("v") != 2, F.col("v")), "x", bucket_seconds=bucket).collect()}
    assert last == {1: 1, 2: 1, 3: 3}
    median = {r.k: r.median for r in exact_median(rows, ["k"], "v").collect()}
    assert median == {None: 1.5, "a": 3.0}


@pytest.mark.parametrize("flip", [False, True])
def test_tiebreak_keeps_its_type(spark, flip):
    big = 2**53
    rows = [(at(1), big, "low"), (at(1), big + 1, "high")]
    right = spark.createDataFrame(rows[::-1] if flip else rows, "timestamp timestamp_ntz, tb long, v string").coalesce(1)
    left = spark.createDataFrame([(at(5), at(0))], "timestamp timestamp_ntz, early timestamp_ntz")
    assert asof_join(left, right, tiebreak="tb").first().v == "high"
    early = left.select(F.col("early").alias("timestamp"))
    assert asof_join(early, right, direction="forward", tiebreak="tb").first().v == "low"


def test_repeated_sessions_repeat_nothing(spark):
    sessions = spark.createDataFrame([(1, 10, 2024, "X", B.isoformat())] * 2, "session_key long, meeting_key long, year int, meeting_name string, date_start string")
    raw = spark.createDataFrame([(1, 0, "m")], "session_key long, Time long, Message string")
    assert BZ.standardise_race_control(raw, sessions).count() == 1
    assert BZ.standardise_weather(raw, sessions).count() == BZ.standardise_laps(raw, sessions).count() == 1


def test_rounding_as_numpy_and_python(spark):
    rng = random.Random(3)
    values = [rng.uniform(-200, 200) for _ in range(6000)] + [rng.randint(-40_000, 40_000) / 1000 + 0.005 for _ in range(4000)] + [8.345, 2.675, 0.5, 1.5, 2.5, 0.125, 0.375, -8.345, 0.0]
    for digits in (1, 2, 4):
        rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_scaled("v", digits).alias("a"), round_exact("v", digits).alias("b")).collect()
        v, a, b = (np.array([r[i] for r in rows]) for i in range(3))
        assert (a == np.round(v, digits)).all()
        assert b.tolist() == [round(x, digits) for x in v.tolist()]


@pytest.mark.parametrize("windows", [(60, 120, 300), (45, 100, 20, 300)])
def test_panes_of_any_width(spark, windows):
    """Windows that are and are not whole steps, rows on the edges and before the grid."""
    rng = random.Random(9)
    sessions = spark.createDataFrame([(1, at(0), at(900)), (2, at(40), at(300))], "session_key long, date_start timestamp_ntz, date_end timestamp_ntz")
    rows = [(s, at(x), f"m{i}", rng.choice("abc"), None if rng.random() < 0.1 else rng.uniform(1e6, 1e6 + 9), i) for s in (1, 2) for i, x in enumerate([rng.choice([rng.randint(-200, 950), 30 * rng.randint(-3, 31)]) for _ in range(120)])]
    events = spark.createDataFrame(rows, "session_key long, date timestamp_ntz, m string, c string, v double, tb int")
    spec = grid_spec(sessions, ["session_key"], 30)
    grid = build_grid(spec, ["session_key"], 30)
    kinds = [("count", None), ("sum", "v"), ("mean", "v"), ("max", "v"), ("min", "v"), ("std", "v"), ("distinct", "c"), ("entropy", "c"), ("concat", "m"), ("text", "m")]
    aggs = [(f"{kind}_{w}", kind, col, w) for kind, col in kinds for w in windows]
    got = {(r.session_key, r[K]): r for r in rolling_to_grid(grid, spec, events, ["session_key"], "date", 30, aggs, tiebreak="tb").collect()}
    assert len(got) == 31 + 9
    for (s, k), r in got.items():
        for w in windows:
            inside = sorted((x for x in rows if x[0] == s and 0 <= (r.timestamp - x[1]).total_seconds() < w), key=lambda x: (x[1], x[5]))
            v = np.array([x[4] for x in inside if x[4] is not None])
            share = np.array([sum(x[3] == c for x in inside) for c in sorted({x[3] for x in inside})]) / max(len(inside), 1)
            assert r[f"count_{w}"] == len(inside) and r[f"distinct_{w}"] == len(share)
            assert r[f"concat_{w}"] == " | ".join(x[2] for x in inside) and r[f"text_{w}"] == " ".join(x[2] for x in inside)
            assert r[f"entropy_{w}"] == pytest.approx(-(share * np.log2(share)).sum(), abs=1e-9)
            assert r[f"sum_{w}"] == (pytest.approx(v.sum()) if inside else None)
            for kind, f in (("mean", np.mean), ("max", np.max), ("min", np.min), ("std", np.std)):
                assert r[f"{kind}_{w}"] == (pytest.approx(f(v), abs=1e-6) if len(v) else None), (kind, w)
