"""Order-dependent building blocks that never put a whole key in one task.

* ``previous_row`` / ``running_last`` — ``lag`` and "last non-NULL so far"
  per key in time order. The window runs per ``(key, time bucket)``; the
  first row of a bucket takes its value from a carry table with one row per
  ``(key, bucket)``.
* ``prefix_sums`` — running sums in a global order: range-partition by the
  order, checkpoint (so partition ids are stable), sum inside each partition
  and add the totals of all earlier partitions (one row per partition,
  broadcast — its size is the partition count).
* ``exact_median`` — per group, from value counts and prefix sums; no group is
  ever collected.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.functions.time import US, floor_div
from riskgrid.session import ensure_checkpoint_dir


def auto_bucket_seconds(df: DataFrame, by: Sequence[str], u_col, target_rows: int = 2_000_000,
                        widest_s: int = 30 * 86400) -> int:
    """A bucket width whose fullest ``(key, bucket)`` holds at most ``target_rows``
    rows, down to one second. Buckets are counted, so a burst narrows them however
    quiet its key is otherwise: from ``widest_s`` on, a width that does not fit
    shrinks by the excess, at least by half. Each try is one partially aggregated
    count."""
    u = F.col(u_col) if isinstance(u_col, str) else u_col
    d = df.select(*by, u.alias("_au")).where(F.col("_au").isNotNull())
    width = widest_s
    while True:
        full = d.groupBy(*by, floor_div(F.col("_au"), F.lit(width * US)).alias("_ab")).count().agg(F.max("count")).first()[0]
        if width == 1 or full is None or full <= target_rows:
            return width
        width = max(1, int(width * min(0.5, target_rows / full)))


def _resolve(df: DataFrame, by: Sequence[str], u_col, bucket_seconds) -> int:
    return auto_bucket_seconds(df, by, u_col) if bucket_seconds == "auto" else int(bucket_seconds)


def _bucketed(df: DataFrame, u_col: str, bucket_seconds: int) -> DataFrame:
    return df.withColumn("_b", floor_div(F.col(u_col), F.lit(int(bucket_seconds * US))))


def join_null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join on ``names`` in which NULL keys match, as they do in groups and windows."""
    keyed = right.select(*[F.col(c).alias(f"_same_{i}") for i, c in enumerate(names)], *[c for c in right.columns if c not in names])
    same = [F.col(c).eqNullSafe(F.col(f"_same_{i}")) for i, c in enumerate(names)]
    return left.join(keyed, same, "left").drop(*[f"_same_{i}" for i in range(len(names))])


def previous_row(df: DataFrame, by: Sequence[str], u_col: str, tb_col: str | None,
                 payload: Sequence[str], out: str = "_prev", bucket_seconds: int = 86400) -> DataFrame:
    """Adds struct ``out`` = (payload…, ``u_col``) of the previous row of the
    same key in ``(u_col, tb_col)`` order; NULL for the first row."""
    by = list(by)
    bucket_seconds = _resolve(df, by, u_col, bucket_seconds)
    tb = F.col(tb_col) if tb_col else F.lit(0)
    d = _bucketed(df.where(F.col(u_col).isNotNull()).withColumn("_tbo", tb), u_col, bucket_seconds)
    s = F.struct(*[F.col(c) for c in payload], F.col(u_col))
    w = Window.partitionBy(*by, "_b").orderBy(u_col, "_tbo")
    d = d.withColumn("_lag", F.lag(s).over(w))
    last = d.groupBy(*by, "_b").agg(F.max_by(s, F.struct(u_col, "_tbo")).alias("_bl"))
    cw = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*by, "_b", F.last("_bl", ignorenulls=True).over(cw).alias("_carry"))
    d = join_null_safe(d, carry, by + ["_b"])
    return d.withColumn(out, F.coalesce("_lag", "_carry")).drop("_lag", "_carry", "_b", "_tbo")


def running_last(df: DataFrame, by: Sequence[str], u_col: str, tb_col: str | None, value: Column,
                 out: str, bucket_seconds: int = 86400) -> DataFrame:
    """Adds ``out`` = last non-NULL ``value`` at or before each row (inclusive)
    of the same key in ``(u_col, tb_col)`` order."""
    by = list(by)
    bucket_seconds = _resolve(df, by, u_col, bucket_seconds)
    tb = F.col(tb_col) if tb_col else F.lit(0)
    d = _bucketed(df.where(F.col(u_col).isNotNull()).withColumn("_tbo", tb).withColumn("_val", value),
                  u_col, bucket_seconds)
    w = (Window.partitionBy(*by, "_b").orderBy(u_col, "_tbo")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_in", F.last("_val", ignorenulls=True).over(w))
    last = d.groupBy(*by, "_b").agg(
        F.max_by("_val", F.when(F.col("_val").isNotNull(), F.struct(u_col, "_tbo"))).alias("_bl"))
    cw = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*by, "_b", F.last("_bl", ignorenulls=True).over(cw).alias("_carry"))
    d = join_null_safe(d, carry, by + ["_b"])
    return d.withColumn(out, F.coalesce("_in", "_carry")).drop("_in", "_carry", "_b", "_tbo", "_val")


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column],
                partition_cols: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Adds inclusive running sums in the global ``order`` (which must start
    with ``partition_cols`` when given; sums then restart per partition)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = list(sums)
    d = df.select("*", *[c.alias(f"_s_{k}") for k, c in sums.items()])
    d = d.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
    d = d.checkpoint(eager=True)
    tot = d.groupBy("_pid").agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in names])
    ow = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", *[F.coalesce(F.sum(f"_t_{k}").over(ow), F.lit(0)).alias(f"_o_{k}") for k in names])
    d = d.join(F.broadcast(offs), "_pid")
    rw = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in names:
        d = d.withColumn(k, F.sum(f"_s_{k}").over(rw) + F.col(f"_o_{k}"))
    if partition_cols:
        base = d.groupBy(*partition_cols).agg(
            *[F.min(F.col(k) - F.col(f"_s_{k}")).alias(f"_base_{k}") for k in names])
        d = join_null_safe(d, base, list(partition_cols))
        for k in names:
            d = d.withColumn(k, F.col(k) - F.col(f"_base_{k}")).drop(f"_base_{k}")
    return d.drop("_pid", *[f"_s_{k}" for k in names], *[f"_o_{k}" for k in names])


def exact_median(df: DataFrame, group_cols: Sequence[str], value_col: str, out: str = "median",
                 weight_col: str | None = None) -> DataFrame:
    """Per group, the median of ``value_col`` (mean of the two middle values
    for an even count; NULLs ignored) — the same as pandas ``median``. A row
    stands for ``weight_col`` values (default one)."""
    g = list(group_cols)
    n_values = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    counts = df.where(F.col(value_col).isNotNull()).groupBy(*g, value_col).agg(n_values.alias("_c"))
    ps = prefix_sums(counts, [F.col(c) for c in g] + [F.col(value_col)], {"_cum": F.col("_c")}, partition_cols=g)
    n = ps.groupBy(*g).agg(F.sum("_c").alias("_n"))
    ps = join_null_safe(ps, n, g)
    m1 = floor_div(F.col("_n") + 1, F.lit(2))
    m2 = floor_div(F.col("_n"), F.lit(2)) + 1
    res = ps.groupBy(*g).agg(F.min(F.when(F.col("_cum") >= m1, F.col(value_col))).alias("_v1"),
                             F.min(F.when(F.col("_cum") >= m2, F.col(value_col))).alias("_v2"))
    return res.select(*g, ((F.col("_v1") + F.col("_v2")) / 2.0).alias(out))
