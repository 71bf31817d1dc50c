"""Bronze layer (S1–S28): read landed records with explicit schemas, parse
and standardise them, attach session metadata, and write/read tables
partitioned by ``year`` / ``session_key`` so that later scans prune.

Everything runs over all sessions at once; nothing loops per session on the
driver. HTTP fetching and the vendor session loader are out of scope: their
*outputs* are the landing files read here.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrid.functions import constants as C
from riskgrid.functions.predicates import nan_to_null, rainfall_double
from riskgrid.functions.time import US, parse_ts, parse_us, ts_of, us_col
from riskgrid.sources.schemas import BRONZE, LANDING, TIMESTAMP_COLS, conform

PARTITIONS = ("year", "session_key")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_landing(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Landed JSON records of one endpoint, explicit schema; a missing
    path gives an empty typed frame."""
    schema = LANDING[table]
    if not _exists(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).json(path)


def race_sessions(sessions: DataFrame, year: int | None, session_name: str = "Race") -> DataFrame:
    """The sessions of one type, of one year (``None``: all years)."""
    kept = sessions.where(F.col("session_name") == session_name)
    return kept if year is None else kept.where(F.col("year") == year)


def parse_timestamps(df: DataFrame, table: str) -> DataFrame:
    """Parse the registered timestamp columns present (NULL on failure)."""
    cols = [c for c in TIMESTAMP_COLS.get(table, ()) if c in df.columns]
    return df.withColumns({c: parse_ts(c) for c in cols}) if cols else df


def write_raw_json(df: DataFrame, path: str) -> None:
    """S3: raw sink; values that are not JSON-native are written as strings."""
    casts = {f.name: F.col(f.name).cast("string") for f in df.schema.fields
             if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType, T.DecimalType))}
    (df.withColumns(casts) if casts else df).write.mode("overwrite").json(path)


def session_keys(schedule: DataFrame, year_col: str = "year", round_col: str = "round_number") -> DataFrame:
    """``session_key = year ‖ lpad(round, 2)``, ``meeting_key = session_key ‖ 0``;
    rows whose key cannot be built are dropped."""
    key = F.concat(F.col(year_col).cast("string"), F.lpad(F.col(round_col).cast("string"), 2, "0"))
    out = schedule.withColumn("session_key", key.try_cast("long")) \
                  .withColumn("meeting_key", F.concat(key, F.lit("0")).try_cast("long"))
    return out.where(F.col("session_key").isNotNull())


def attach_session_meta(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add meeting_key, year, meeting_name by session (one row per
    session on the right, so the planner may broadcast it)."""
    meta = sessions.select("session_key", "meeting_key", "year", "meeting_name").dropDuplicates(["session_key"])
    drop = [c for c in ("meeting_key", "year", "meeting_name") if c in df.columns]
    return df.drop(*drop).join(meta, "session_key", "left")


def offset_to_ts(offset_us_col: str, start: str = "_session_start_us"):
    """Session-relative offset (µs) → absolute UTC timestamp."""
    return ts_of(F.col(start) + F.col(offset_us_col))


def _with_start(df: DataFrame, sessions: DataFrame) -> DataFrame:
    # one row per session: a repeated session row must not repeat its readings
    s = sessions.groupBy("session_key").agg(F.min(parse_us("date_start")).alias("_session_start_us"))
    return df.join(s, "session_key", "left")


# FIXED VALUES (do not edit): column names of the landed tables and of bronze.
RC_RENAMES = {"Time": "date", "Message": "message", "Category": "category", "Flag": "flag", "Scope": "scope",
              "Sector": "sector", "RacingNumber": "driver_number"}
WEATHER_RENAMES = {"Time": "date", "AirTemp": "air_temperature", "TrackTemp": "track_temperature",
                   "Humidity": "humidity", "Pressure": "pressure", "WindSpeed": "wind_speed",
                   "WindDirection": "wind_direction", "Rainfall": "rainfall"}
LAP_RENAMES = {"Time": "date", "Driver": "driver_abbr", "DriverNumber": "driver_number", "LapNumber": "lap_number",
               "LapTime": "lap_time", "Sector1Time": "sector1_time", "Sector2Time": "sector2_time",
               "Sector3Time": "sector3_time", "Compound": "tyre_compound", "TyreLife": "tyre_life", "Stint": "stint",
               "PitInTime": "pit_in_time", "PitOutTime": "pit_out_time", "Position": "position",
               "TrackStatus": "track_status"}
RESULT_RENAMES = {"DriverNumber": "driver_number", "Abbreviation": "driver_abbr", "FullName": "full_name",
                  "TeamName": "team_name", "Position": "position", "ClassifiedPosition": "classified_position",
                  "Points": "points", "Status": "status"}


def rename_present(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename only the columns that exist."""
    return df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})


def standardise_race_control(raw: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rename; ``date`` given as an offset (µs) from session start → UTC."""
    df = rename_present(raw, RC_RENAMES)
    df = _with_start(df, sessions).withColumn("date", offset_to_ts("date")).drop("_session_start_us")
    return conform(attach_session_meta(df, sessions), BRONZE["race_control"])


def standardise_weather(raw: DataFrame, sessions: DataFrame) -> DataFrame:
    """As S9, rainfall normalised to 0/1 doubles, NaN readings → NULL."""
    df = rename_present(raw, WEATHER_RENAMES)
    df = _with_start(df, sessions).withColumn("date", offset_to_ts("date")).drop("_session_start_us")
    if "rainfall" in df.columns:
        df = df.withColumn("rainfall", rainfall_double("rainfall"))
    for c in C.WEATHER_COLS:
        if c in df.columns and c != "rainfall":
            df = df.withColumn(c, nan_to_null(F.col(c).cast("double")))
    return conform(attach_session_meta(df, sessions), BRONZE["weather"])


def standardise_laps(raw: DataFrame, sessions: DataFrame) -> DataFrame:
    """Durations (µs) → seconds; pit times stay offsets."""
    df = rename_present(raw, LAP_RENAMES)
    df = _with_start(df, sessions).withColumn("date", offset_to_ts("date")).drop("_session_start_us")
    for c in ("lap_time", "sector1_time", "sector2_time", "sector3_time"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("double") / float(US))
    return conform(attach_session_meta(df, sessions), BRONZE["laps"])


def flatten_per_driver(frames: Mapping[str, DataFrame] | DataFrame, value_col: str | None = None) -> DataFrame:
    """Per-driver telemetry → one long table with ``driver_number``.
    Accepts a dict of frames (unioned by name) or a frame with a MAP column
    ``value_col`` of driver → array of readings (exploded)."""
    if isinstance(frames, DataFrame):
        m = frames.select("*", F.explode(value_col).alias("driver_number", "_readings")).drop(value_col)
        return m.select("*", F.explode("_readings").alias("_r")).select("*", "_r.*").drop("_readings", "_r")
    out = None
    for drv, f in frames.items():
        f = f.withColumn("driver_number", F.lit(str(drv)))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def standardise_results(raw: DataFrame, sessions: DataFrame) -> DataFrame:
    """S14."""
    return conform(attach_session_meta(rename_present(raw, RESULT_RENAMES), sessions), BRONZE["results"])


def session_bounds(sessions: DataFrame, laps: DataFrame, weather: DataFrame,
                   start_col: str = "date_start") -> DataFrame:
    """end = start + max lap offset, else start + max weather offset,
    else start + 2 h; ISO strings. Offsets are µs from the session start."""
    lap_end = laps.groupBy("session_key").agg(F.max("offset_us").alias("_lap"))
    w_end = weather.groupBy("session_key").agg(F.max("offset_us").alias("_w"))
    s = sessions.join(lap_end, "session_key", "left").join(w_end, "session_key", "left")
    start = parse_us(start_col)
    end = F.coalesce(start + F.col("_lap"), start + F.col("_w"), start + F.lit(C.SESSION_FALLBACK_S * US))
    iso = lambda u: F.date_format(ts_of(u), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return s.withColumn("date_end", F.when(start.isNotNull(), iso(end)).otherwise(F.lit(""))) \
            .withColumn(start_col, F.when(start.isNotNull(), iso(start)).otherwise(F.lit(""))).drop("_lap", "_w")


def not_yet_ingested(sessions: DataFrame, existing_keys: DataFrame) -> DataFrame:
    """Sessions whose key is not already present."""
    return sessions.join(existing_keys.select("session_key").distinct(), "session_key", "left_anti")


def write_bronze(df: DataFrame, root: str, table: str, mode: str = "overwrite") -> None:
    """One writer per table over all sessions; partitions by year and
    session; dynamic partition overwrite keeps other sessions' files."""
    if df.isEmpty():
        return
    order = [*PARTITIONS] + (["date"] if "date" in df.columns else [])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # range partitioning splits a large session over several writer tasks
    (df.repartitionByRange(n, *order).write.mode(mode).option("partitionOverwriteMode", "dynamic")
       .partitionBy(*PARTITIONS).parquet(f"{root}/{table}"))


def read_bronze(spark: SparkSession, root: str, table: str, year: int | None = None,
                session_key: int | None = None) -> DataFrame:
    """Partition-pruned scan; a missing table gives 0 typed rows.
    The directory values of ``year``/``session_key`` win over file columns."""
    schema = BRONZE[table]
    path = f"{root}/{table}"
    if not _exists(spark, path):
        return empty(spark, schema)
    df = spark.read.option("mergeSchema", "false").parquet(path)
    if year is not None:
        df = df.where(F.col("year") == year)
    if session_key is not None:
        df = df.where(F.col("session_key") == session_key)
    return conform(df, schema)


def read_gold(spark: SparkSession, path: str, session_keys: Sequence[int] | None = None) -> DataFrame:
    """Gold scan, optionally pruned to some sessions."""
    df = spark.read.parquet(path)
    return df.where(F.col("session_key").isin(list(session_keys))) if session_keys else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Test-set parquet, importance CSV (with header), metadata JSON."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def event_offsets(df: DataFrame, ts_col: str, start_us_col: str) -> DataFrame:
    """Helper for landing shapes that carry offsets: µs since session start."""
    return df.withColumn("offset_us", us_col(df, ts_col) - F.col(start_us_col))


def read_landing_all(spark: SparkSession, root: str, tables: Sequence[str] = tuple(LANDING)) -> dict[str, DataFrame]:
    """Every endpoint's landed records as lazy DataFrames keyed by name."""
    return {t: read_landing(spark, f"{root}/{t}", t) for t in tables}


def first_sessions(sessions: DataFrame, n: int | None, order: Sequence[str] = ("date_start", "session_key")) -> DataFrame:
    """The first ``n`` sessions of the schedule (all when ``n`` is None)."""
    return sessions if n is None else sessions.orderBy(*order).limit(n)
