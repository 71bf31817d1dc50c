"""Session catalogue and pruned scans of bronze tables.

Partition folders are read under a declared schema as text and cast, so a folder whose
year or session is no number is left out instead of changing the column's type or
failing the scan; filters on the cast values still prune folders. A table of sessions
prunes a scan by a semi join: its few rows are broadcast and Spark drops the folders of
other sessions before listing their files (dynamic partition pruning), with no list of
keys on the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrid.sources.bronze import PARTITIONS, _exists, empty
from riskgrid.sources.schemas import BRONZE


def scan(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All rows of a bronze table whose folders carry whole numbers; a missing table gives
    no rows. The folders' year and session win over columns in the files."""
    schema, path = BRONZE[table], f"{root}/{table}"
    if not _exists(spark, path):
        return empty(spark, schema)
    kinds = {f.name: f.dataType for f in schema}
    declared = T.StructType([f for f in schema if f.name not in PARTITIONS] + [T.StructField(c, T.StringType()) for c in PARTITIONS])
    rows = spark.read.schema(declared).parquet(path)
    rows = rows.withColumns({c: F.col(c).try_cast(kinds[c]) for c in PARTITIONS})
    return rows.where(" and ".join(f"{c} is not null" for c in PARTITIONS)).select(*schema.names)


def catalogue(spark: SparkSession, root: str, table: str, order: str = "date") -> DataFrame:
    """One row per session: session_key, meeting_key, year, meeting_name of its first row
    in time, and its number of rows."""
    first = F.min(F.struct(F.col(order).isNull().alias("late"), order, "meeting_key", "year", "meeting_name")).alias("_first")
    rows = scan(spark, root, table).groupBy("session_key").agg(first, F.count(F.lit(1)).alias("n_rows"))
    return rows.select("session_key", "_first.meeting_key", "_first.year", "_first.meeting_name", "n_rows")


def scan_sessions(spark: SparkSession, root: str, table: str, sessions: DataFrame) -> DataFrame:
    """Rows of the sessions listed in ``sessions`` (column session_key)."""
    keys = sessions.select(F.col("session_key").cast("long")).distinct()
    return scan(spark, root, table).join(keys, "session_key", "left_semi").select(*BRONZE[table].names)
