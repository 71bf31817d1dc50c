"""Explicit schemas (no inference, ``mergeSchema`` off). Absent optional
columns are added as typed NULL columns by ``conform``."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, D, I, TS = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.TimestampNTZType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


META = (("session_key", L), ("meeting_key", L), ("year", I), ("meeting_name", S))

# landing JSON shapes (one record per reading), timestamps as ISO strings
LANDING = {
    "sessions": _st(("session_key", L), ("meeting_key", L), ("year", I), ("circuit_short_name", S),
                    ("country_name", S), ("session_name", S), ("session_type", S), ("date_start", S),
                    ("date_end", S), ("meeting_name", S)),
    "race_control": _st(("session_key", L), ("date", S), ("category", S), ("message", S), ("flag", S),
                        ("scope", S), ("sector", S), ("driver_number", S)),
    "weather": _st(("session_key", L), ("date", S), ("air_temperature", D), ("track_temperature", D),
                   ("humidity", D), ("pressure", D), ("wind_speed", D), ("wind_direction", D), ("rainfall", S)),
    "position": _st(("session_key", L), ("date", S), ("driver_number", S), ("position", S)),
    "intervals": _st(("session_key", L), ("date", S), ("driver_number", S), ("gap_to_leader", S), ("interval", S)),
    "drivers": _st(("session_key", L), ("driver_number", S), ("name_acronym", S), ("full_name", S),
                   ("team_name", S)),
}

# bronze shapes
BRONZE = {
    "session": _st(("session_key", L), ("meeting_key", L), ("year", I), ("round_number", I), ("meeting_name", S),
                   ("circuit_short_name", S), ("country", S), ("session_name", S), ("session_type", S),
                   ("date_start", S), ("date_end", S)),
    "race_control": _st(("date", TS), ("category", S), ("message", S), ("flag", S), ("scope", S), ("sector", S),
                        ("driver_number", S), *META),
    "weather": _st(("date", TS), ("air_temperature", D), ("track_temperature", D), ("humidity", D), ("pressure", D),
                   ("wind_speed", D), ("wind_direction", D), ("rainfall", D), *META),
    "laps": _st(("date", TS), ("driver_abbr", S), ("driver_number", S), ("lap_number", D), ("lap_time", D),
                ("sector1_time", D), ("sector2_time", D), ("sector3_time", D), ("tyre_compound", S),
                ("tyre_life", D), ("stint", D), ("pit_in_time", L), ("pit_out_time", L), ("position", D),
                ("track_status", S), *META),
    "position": _st(("date", TS), ("driver_number", S), ("position", S), ("x", D), ("y", D), ("z", D),
                    ("status", S), ("source", S), *META),
    "intervals": _st(("date", TS), ("driver_number", S), ("gap_to_leader", S), ("interval", S), *META),
    "car_data": _st(("date", TS), ("speed", D), ("throttle", D), ("brake", D), ("gear", D), ("rpm", D), ("drs", D),
                    ("driver_number", S), *META),
    "results": _st(("driver_number", S), ("driver_abbr", S), ("full_name", S), ("team_name", S), ("position", D),
                   ("classified_position", S), ("points", D), ("status", S), *META),
}

# timestamp columns per landing table (parsed at bronze)
TIMESTAMP_COLS = {
    "race_control": ("date",), "weather": ("date",), "position": ("date",), "intervals": ("date",),
    "laps": ("date",), "car_data": ("date",), "sessions": (),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order; absent ones become typed NULLs."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)
