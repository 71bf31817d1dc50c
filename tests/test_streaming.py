"""The streaming rolling counts equal the batch operator."""
import os
import tempfile

from pyspark.sql import functions as F

from riskgrid.operators.grid import build_grid, grid_spec
from riskgrid.operators.rolling import rolling_to_grid
from riskgrid.plans import driver_tables as D
from riskgrid.streaming.rolling import rolling_counts_stream

SF = "/root/testdata/sf0.001"


def test_stream_counts_match_batch(spark):
    msgs = D.messages(spark, SF).select("session_key", "date")
    spec = grid_spec(D.sessions(spark, SF), ["session_key"], 300)
    src = tempfile.mkdtemp(prefix="riskgrid-stream-src-", dir=os.environ.get("TMPDIR", "/tmp"))
    msgs.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(msgs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = rolling_counts_stream(stream, spec, ["session_key"], "date", 300, (600, 1800))
    q = out.writeStream.outputMode("update").format("memory").queryName("rolling_stream_test").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("rolling_stream_test").groupBy("session_key", "grid_k").agg(
        F.max("msg_count_600s").alias("a"), F.max("msg_count_1800s").alias("b"))
    grid = build_grid(spec, ["session_key"], 300)
    want = rolling_to_grid(grid, spec, msgs, ["session_key"], "date", 300,
                           [("a", "count", None, 600), ("b", "count", None, 1800)])
    g = {(r.session_key, r.grid_k): (r.a, r.b) for r in got.collect()}
    w = {(r.session_key, r.grid_k): (r.a, r.b) for r in want.where("b > 0").collect()}
    assert g == w and len(w) > 0
