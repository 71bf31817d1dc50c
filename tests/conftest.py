import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

B = dt.datetime(2024, 3, 2, 15, 0, 0)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskgrid-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def race_control(spark):
    rows = [
        (B + dt.timedelta(minutes=10), "SAFETY CAR DEPLOYED", "SafetyCar", "SC"),
        (B + dt.timedelta(minutes=11), "SAFETY CAR PERIOD", "SafetyCar", "SC"),
        (B + dt.timedelta(minutes=25), "TRACK LIMITS REMINDER", "TrackLimits", ""),
        (B + dt.timedelta(minutes=40), "VIRTUAL SAFETY CAR DEPLOYED", "Vsc", "VSC"),
        (B + dt.timedelta(minutes=41), "VIRTUAL SAFETY CAR ENDING", "Vsc", "VSC"),
    ]
    return spark.createDataFrame([(9158, *r) for r in rows],
                                 "session_key long, date timestamp_ntz, message string, category string, flag string")


@pytest.fixture(scope="session")
def sessions(spark):
    return spark.createDataFrame(
        [(9158, 1229, 2024, "Test GP", B, B + dt.timedelta(seconds=30 * 119))],
        "session_key long, meeting_key long, year int, meeting_name string, date_start timestamp_ntz, date_end timestamp_ntz")
