"""Bronze sinks and scans on a scratch folder."""
import datetime as dt
import os
import tempfile

from riskgrid.sources import bronze as BZ
from tests.conftest import B


def test_bronze_round_trip_and_pruning(spark):
    root = tempfile.mkdtemp(prefix="riskgrid-bronze-", dir=os.environ.get("TMPDIR", "/tmp"))
    sessions = spark.createDataFrame(
        [(1, 10, 2023, "A GP", B.isoformat()), (2, 20, 2024, "B GP", (B + dt.timedelta(days=1)).isoformat())],
        "session_key long, meeting_key long, year int, meeting_name string, date_start string")
    raw = spark.createDataFrame([(1, 60_000_000, "SAFETY CAR DEPLOYED", "SafetyCar", "SC"),
                                 (2, 0, "CLEAR", "Flag", "GREEN")],
                                "session_key long, Time long, Message string, Category string, Flag string")
    rc = BZ.standardise_race_control(raw, sessions)
    BZ.write_bronze(rc, root, "race_control")
    got = BZ.read_bronze(spark, root, "race_control", year=2023).collect()
    assert len(got) == 1 and got[0].date == B + dt.timedelta(minutes=1) and got[0].meeting_name == "A GP"
    assert BZ.read_bronze(spark, root, "weather").count() == 0
    assert BZ.read_landing(spark, f"{root}/nothing", "weather").count() == 0


def test_session_keys_and_weather(spark):
    sched = spark.createDataFrame([(2024, 3), (2024, None), (2023, 12)], "year int, round_number int")
    keys = {r.session_key: r.meeting_key for r in BZ.session_keys(sched).collect()}
    assert keys == {202403: 2024030, 202312: 2023120}
    sessions = spark.createDataFrame([(1, 10, 2024, "X", B.isoformat())],
                                     "session_key long, meeting_key long, year int, meeting_name string, date_start string")
    raw = spark.createDataFrame([(1, 0, "True", 20.0), (1, 1, None, float("nan")), (1, 2, "0.0", 21.0)],
                                "session_key long, Time long, Rainfall string, AirTemp double")
    w = {r.date: (r.rainfall, r.air_temperature) for r in BZ.standardise_weather(raw, sessions).collect()}
    assert sorted(w.values(), key=str) == sorted([(1.0, 20.0), (0.0, None), (0.0, 21.0)], key=str)


def test_laps_flatten_and_scrub(spark):
    from pyspark.sql import functions as F

    from riskgrid.functions.predicates import scrub
    sessions = spark.createDataFrame([(1, 10, 2024, "X", B.isoformat())],
                                     "session_key long, meeting_key long, year int, meeting_name string, date_start string")
    laps = spark.createDataFrame([(1, 90_000_000, "VER", "1", 91_500_000, 30_250_000)],
                                 "session_key long, Time long, Driver string, DriverNumber string, LapTime long, Sector1Time long")
    r = BZ.standardise_laps(laps, sessions).first()
    assert r.lap_time == 91.5 and r.sector1_time == 30.25 and r.date == B + dt.timedelta(seconds=90)
    a = spark.createDataFrame([(1, 0.5)], "session_key long, x double")
    b = spark.createDataFrame([(1, 0.7, 3.0)], "session_key long, x double, y double")
    long = BZ.flatten_per_driver({"1": a, "44": b})
    assert sorted((r.driver_number, r.x, r.y) for r in long.collect()) == [("1", 0.5, None), ("44", 0.7, 3.0)]
    vals = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,)], "v double")
    assert sorted([r.s for r in vals.select(scrub("v").alias("s")).collect()], key=str) == [1.5, None, None]


def test_write_gold_round_trip(spark, sessions):
    from riskgrid.plans.features import build_features, write_gold
    from tests.test_operators import _race
    out = tempfile.mkdtemp(prefix="riskgrid-gold-", dir=os.environ.get("TMPDIR", "/tmp"))
    gold = build_features(sessions, *_race(spark))
    write_gold(gold, out)
    back = BZ.read_gold(spark, out, [9158])
    assert back.count() == 120 and set(back.columns) == set(gold.columns)


def test_landing_records_by_year_and_session_name(spark):
    root = tempfile.mkdtemp(prefix="riskgrid-landing-", dir=os.environ.get("TMPDIR", "/tmp"))
    rows = [(1, 10, 2023, "Race", B), (2, 10, 2024, "Qualifying", B), (3, 20, 2024, "Race", B), (4, 30, None, None, B)]
    raw = spark.createDataFrame(rows, "session_key long, meeting_key long, year int, session_name string, date_start timestamp_ntz")
    BZ.write_raw_json(raw, f"{root}/sessions")
    every = BZ.read_landing(spark, f"{root}/sessions", "sessions")
    assert every.count() == 4
    races = BZ.race_sessions(every, 2024).collect()
    assert [(r.session_key, r.session_name) for r in races] == [(3, "Race")]
    assert sorted(r.session_key for r in BZ.race_sessions(every, None).collect()) == [1, 3]
    tables = BZ.read_landing_all(spark, root)
    assert tables["sessions"].count() == 4 and all(t.count() == 0 for n, t in tables.items() if n != "sessions")


def test_results_and_plain_sinks(spark):
    root = tempfile.mkdtemp(prefix="riskgrid-sinks-", dir=os.environ.get("TMPDIR", "/tmp"))
    sessions = spark.createDataFrame([(1, 10, 2024, "X", B.isoformat())],
                                     "session_key long, meeting_key long, year int, meeting_name string, date_start string")
    raw = spark.createDataFrame([(1, "44", "HAM", "Finished")], "session_key long, DriverNumber string, Abbreviation string, Status string")
    r = BZ.standardise_results(raw, sessions).first()
    assert (r.driver_number, r.driver_abbr, r.status, r.meeting_key, r.year) == ("44", "HAM", "Finished", 10, 2024)
    imp = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "feature string, importance double")
    for fmt in ("csv", "json", "parquet"):
        BZ.write_table(imp, f"{root}/{fmt}", fmt)
    assert sorted(map(tuple, BZ.read_csv(spark, f"{root}/csv", imp.schema).collect())) == [("a", 0.75), ("b", 0.25)]
    assert spark.read.json(f"{root}/json").count() == spark.read.parquet(f"{root}/parquet").count() == 2
