"""NaN, coercion, ordering and checkpoint rules."""
import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from riskgrid import session
from riskgrid.functions.predicates import coerce_double, rainfall_double
from riskgrid.operators.models import with_balanced_weights
from riskgrid.operators.rolling import _agg_expr
from riskgrid.plans.reports import means_by, window_around
from riskgrid.plans.training import with_row_id


def test_coercion_of_nan_and_suffixes(spark):
    df = spark.createDataFrame([("NaN",), ("1d",), ("2F",), (" 3.5 ",), ("x",), (None,), ("-1e3",)], "s string")
    got = df.select(coerce_double(F.col("s")).alias("a"), rainfall_double(F.col("s")).alias("b")).collect()
    assert [r.a for r in got] == [None, None, None, 3.5, None, None, -1000.0]
    assert [r.b for r in got] == [0.0, 0.0, 0.0, 3.5, 0.0, 0.0, -1000.0]


@pytest.mark.parametrize(("kind", "want"), [("sum", 8.0), ("mean", 4.0), ("max", 5.0), ("min", 3.0), ("std", 1.0)])
def test_rolling_ignores_nan(spark, kind, want):
    df = spark.createDataFrame([(5.0,), (float("nan"),), (3.0,), (None,)], "v double")
    assert df.agg(_agg_expr(kind, F.lit(True), F.col("v"), F.lit(0))).first()[0] == want


def test_means_leave_out_rows_without_group(spark):
    df = spark.createDataFrame([(2024, 1.0), (None, 9.0)], "year int, v double")
    assert [tuple(r) for r in means_by(df, "year", ["v"]).collect()] == [(2024, 1.0)]


def test_message_windows_are_ordered(spark):
    t = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(t + dt.timedelta(seconds=s),) for s in (5, -20, 0, -5)], "date timestamp_ntz")
    at = F.lit(int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000))
    both = [r.date.second for r in window_around(df, at, 30).collect()]
    back = [r.date.second for r in window_around(df, at, 30, symmetric=False).collect()]
    assert (both, back) == ([40, 55, 0, 5], [0, 55, 40])


@pytest.mark.parametrize("master", ["local[4]", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_checkpoint_folder_falls_back_on_local_masters_only(master):
    set_to = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: {}, setCheckpointDir=set_to.append)
    fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None))
    if master == "local[4]":
        assert session.ensure_checkpoint_dir(fake) == set_to[0]
    else:
        with pytest.raises(RuntimeError):
            session.ensure_checkpoint_dir(fake)


def test_class_weights_count_training_rows_only(spark):
    train = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    both = train.unionByName(spark.createDataFrame([(1,)] * 4, "y int"))
    got = {r.y: r.w for r in with_balanced_weights(both, "y", train=train).distinct().collect()}
    assert got == pytest.approx({0: 4 / 6, 1: 4 / 2})


def test_row_ids_do_not_meet_on_long_grids(spark):
    df = spark.createDataFrame([(20240101, 100_000), (20240102, 0), (20240101, 2**31)], "session_key long, grid_k long")
    assert with_row_id(df).select("row_id").distinct().count() == 3
