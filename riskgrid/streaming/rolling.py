"""Rolling counts on a stream of messages (extension, not parity).

The batch operator's bounded explode carries over unchanged: each arriving
message is joined with the static grid spec (stream–static join) and copied
to the grid points whose window ``(t − w, t]`` contains it. The grid
timestamp carries the watermark, so in ``append`` mode a grid point's counts
are emitted once the watermark passes it and its state is dropped; messages
later than the allowed lateness are ignored (Spark's late-data policy).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.functions.time import US, us_col
from riskgrid.operators.grid import K, explode_to_grid


def rolling_counts_stream(messages: DataFrame, spec: DataFrame, keys: Sequence[str], ts_col: str,
                          interval_seconds: int, windows: Sequence[int], lateness_seconds: int = 600) -> DataFrame:
    """Streaming ``msg_count_<w>s`` per ``(keys, grid point)``."""
    keys = list(keys)
    wmax = max(windows) * US
    rows = messages.select(*keys, us_col(messages, ts_col).alias("_e")).where(F.col("_e").isNotNull())
    x = explode_to_grid(rows, spec, keys, "_e", interval_seconds, 0, wmax - 1)
    x = x.withColumn("grid_ts", F.timestamp_micros("grid_us")).withWatermark("grid_ts", f"{int(lateness_seconds)} seconds")
    aggs = [F.count(F.when((F.col("grid_us") - F.col("_e")) < F.lit(w * US), 1)).alias(f"msg_count_{w}s")
            for w in windows]
    return x.groupBy(*keys, K, "grid_ts").agg(*aggs)
