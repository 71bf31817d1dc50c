"""Session risk: without a model, with one, and with one that cannot score."""
import random

import pytest
from pyspark.sql import functions as F

from riskgrid.plans import scoring as SR
from riskgrid.plans import training as TR


@pytest.fixture(scope="module")
def gold(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(s, s * 10, 2024, k, int(k in (4, 5, 9) and s == 1), 60.0, rng.choice(["CLEAR NOW", "DEBRIS ON TRACK"]), rng.randint(0, 5)) for s in (1, 2, 3) for k in range(20)]
    df = spark.createDataFrame(rows, "session_key long, meeting_key long, year int, grid_k long, y_sc_5m int, time_to_sc_seconds double, recent_messages_concat string, msg_count_60s long")
    df = df.withColumn("timestamp", F.timestamp_add("SECOND", (F.col("grid_k") * 30).cast("int"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")))
    path = str(tmp_path_factory.mktemp("gold") / "gold")
    df.write.partitionBy("session_key").parquet(path)
    return path


def test_without_a_model(spark, gold, tmp_path):
    report, timeline = SR.score_session(spark, gold, 1, str(tmp_path / "none"))
    r = report.first()
    assert (r.session_key, r.peak_risk, r.sc_windows, r.grid_points) == (1, 1.0, 3, 20)
    assert [t.strftime("%H:%M:%S") for t in r.sc_event_starts] == ["00:02:00", "00:04:30"]
    assert [x.risk_score for x in timeline.orderBy("timestamp").collect()] == [float(k in (4, 5, 9)) for k in range(20)]
    assert "PartitionFilters: [isnotnull(session_key" in timeline._jdf.queryExecution().executedPlan().toString()
    assert SR.score_session(spark, gold, 99)[0].count() == 0


def test_with_a_model_and_with_a_broken_one(spark, gold, tmp_path):
    rows = TR.with_row_id(spark.read.parquet(gold))
    fit = TR.fit_baseline(rows)
    TR.M.save_model(fit.model, fit.scaler, fit.text, str(tmp_path / "model"))
    report, timeline = SR.score_session(spark, gold, 1, str(tmp_path / "model"))
    want = max(r.prob for r in TR.score(fit, rows.where("session_key = 1")).collect())
    assert report.first().peak_risk == pytest.approx(want) and timeline.count() == 20
    broken = spark.read.parquet(gold).drop("recent_messages_concat")
    zeros = SR.with_risk(broken, SR.stored_model(spark, str(tmp_path / "model")))
    assert {r.risk_score for r in zeros.collect()} == {0.0} and zeros.count() == 60


def test_scrubbed_output(spark):
    rows = spark.createDataFrame([(1, 0, 0, float("nan")), (1, 1, 1, 0.25), (2, 0, 0, float("inf"))], "session_key long, grid_k long, y_sc_5m int, risk_score double")
    rows = rows.withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    assert {r.session_key: r.peak_risk for r in SR.session_report(rows).collect()} == {1: 0.25, 2: None}
    assert sorted(str(r.risk_score) for r in SR.session_timeline(rows).collect()) == ["0.25", "None", "None"]
