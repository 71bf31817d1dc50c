"""The ingestion job (S5, S16, S17): landed records → bronze tables, with a log.

One job per table over all sessions that the log does not list for it yet. Every
record is judged by itself: one that is no JSON of the table's schema, has no known
session or no readable time goes to the table of rejected records with its reason and
its text, so a broken record or session leaves the others as they are. A table that
fails as a whole is logged as failed and leaves the other tables as they are.

A table's sessions are committed by their log partitions, written last: what a failed
or lost run left half done is not in the log, so the next run does it again and
overwrites it, and nothing else. Tables, rejected records and log are overwritten by
partition, never appended, so a repeated run changes nothing.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrid.functions import constants as C
from riskgrid.functions.predicates import nan_to_null, rainfall_double
from riskgrid.functions.time import parse_ts
from riskgrid.sources.bronze import _exists, attach_session_meta, empty, write_bronze
from riskgrid.sources.schemas import BRONZE, LANDING, conform

TABLES = ("race_control", "weather", "position", "intervals")
#: Session of the records whose session cannot be read.
UNKNOWN = -1
LOG = "written long, rejected long, status string, error string, table_name string, session_key long"
REJECTED = "reason string, record string, table_name string, session_key long"


def _write_parts(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_name", "session_key").parquet(path))


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else empty(spark, schema)


def ingest_log(spark: SparkSession, root: str) -> DataFrame:
    return read_parts(spark, f"{root}/_log", LOG)


def rejected_records(spark: SparkSession, root: str) -> DataFrame:
    return read_parts(spark, f"{root}/_rejected", REJECTED)


def judged_records(spark: SparkSession, path: str, table: str, sessions: DataFrame) -> DataFrame:
    """Every landed line with its parsed fields, session and reason for rejection (NULL: good)."""
    schema = T.StructType([*LANDING[table].fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, options).alias("_r")).select("value", "_r.*")
    # The session of a broken record is read from its text where it is still there.
    from_text = F.regexp_extract("value", r'"session_key"\s*:\s*(-?\d{1,18})', 1).try_cast("long")
    broken = F.col("_corrupt").isNotNull()
    parsed = parsed.withColumn("_key", F.when(broken, from_text).otherwise(F.col("session_key")))
    known = sessions.where("session_key is not null").select(F.col("session_key").alias("_key"), F.lit(True).alias("_known")).distinct()
    parsed = parsed.join(known, "_key", "left")
    reason = (F.when(broken, "malformed").when(F.col("_known").isNull(), "unknown session")
              .when(parse_ts("date").isNull(), "no time"))
    key = F.when(F.col("_known"), F.col("_key")).otherwise(F.lit(UNKNOWN).cast("long"))
    return parsed.withColumn("_reason", reason).withColumn("_session", key).drop("_corrupt", "_key", "_known")


def standardised(good: DataFrame, table: str, sessions: DataFrame) -> DataFrame:
    """Bronze rows of one table from its good records."""
    df = good.withColumn("date", parse_ts("date"))
    if table == "weather":
        df = df.withColumn("rainfall", rainfall_double("rainfall"))
        df = df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in C.WEATHER_COLS if c != "rainfall"})
    return conform(attach_session_meta(df, sessions), BRONZE[table])


def ingest_table(spark: SparkSession, landing: str, root: str, table: str, sessions: DataFrame, pending: DataFrame) -> DataFrame:
    """Write one table's pending sessions; returns their log rows."""
    rows = judged_records(spark, f"{landing}/{table}", table, sessions)
    rows = rows.join(pending.withColumnRenamed("session_key", "_session"), "_session", "left_semi").persist(StorageLevel.DISK_ONLY)
    try:
        write_bronze(standardised(rows.where("_reason is null"), table, sessions), root, table)
        name = F.lit(table).alias("table_name")
        bad = rows.where("_reason is not null").select(F.col("_reason").alias("reason"), F.col("value").alias("record"), name, F.col("_session").alias("session_key"))
        _write_parts(bad, f"{root}/_rejected")
        counts = rows.groupBy(F.col("_session").alias("session_key")).agg(F.count_if(F.col("_reason").isNull()).alias("written"), F.count("_reason").alias("rejected"))
        done = pending.join(counts, "session_key", "left").select(
            F.coalesce("written", F.lit(0)).cast("long").alias("written"), F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"),
            F.lit("written").alias("status"), F.lit(None).cast("string").alias("error"), name, "session_key")
        _write_parts(done, f"{root}/_log")
        return ingest_log(spark, root).where(F.col("table_name") == table)
    finally:
        rows.unpersist()


def ingest(spark: SparkSession, landing: str, root: str, sessions: DataFrame, tables: Sequence[str] = TABLES,
           on_failure: Callable[[str, Exception], None] | None = None) -> DataFrame:
    """Ingest what the log lacks; returns the whole log. A missing landing folder of a
    table is a failure of that table, to be tried again by the next run."""
    wanted = sessions.where("session_key is not null").select(F.col("session_key").cast("long")).distinct()
    wanted = wanted.unionByName(spark.range(1).select(F.lit(UNKNOWN).cast("long").alias("session_key")))
    for table in tables:
        done = ingest_log(spark, root).where((F.col("table_name") == table) & (F.col("status") == "written"))
        pending = wanted.join(done, "session_key", "left_anti").checkpoint()
        if pending.isEmpty():
            continue
        try:
            ingest_table(spark, landing, root, table, sessions, pending)
        except Exception as failure:  # noqa: BLE001 - a failing table must not stop the others
            if on_failure:
                on_failure(table, failure)
            message = F.lit(f"{type(failure).__name__}: {failure}"[:500])
            zero = F.lit(0).cast("long")
            failed = pending.select(zero.alias("written"), zero.alias("rejected"), F.lit("failed").alias("status"), message.alias("error"), F.lit(table).alias("table_name"), "session_key")
            _write_parts(failed, f"{root}/_log")
    return ingest_log(spark, root)
