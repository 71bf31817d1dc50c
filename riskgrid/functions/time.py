"""Time helpers.

Internally every instant is a LONG of microseconds since the epoch. The
conversion uses ``timestampdiff`` / ``timestampadd`` against the epoch, which is
time-zone free for TIMESTAMP_NTZ and exact for TIMESTAMP (both are UTC micros
underneath), so results never depend on ``spark.sql.session.timeZone``.
Sub-microsecond digits of the reference's nanosecond timestamps are lost.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

US = 1_000_000
_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_ZONE_SUFFIX = r"([zZ]|[+-]\d{2}(:?\d{2})?)$"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def us_of(c, dtype: T.DataType | None = None) -> Column:
    """Timestamp (NTZ or LTZ) → microseconds since the epoch."""
    c = col_of(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), c)


def ts_of(us) -> Column:
    """Microseconds since the epoch → TIMESTAMP_NTZ (UTC wall time)."""
    return F.timestamp_add("MICROSECOND", col_of(us), F.expr(_EPOCH_NTZ))


def us_col(df: DataFrame, name: str) -> Column:
    """Microseconds of a timestamp column, chosen by the column's type."""
    return us_of(name, df.schema[name].dataType)


def floor_div(a, b) -> Column:
    """Exact floor division of LONGs (Spark's ``div`` truncates toward zero)."""
    a, b = col_of(a), col_of(b)
    return F.expr("0L") + ((a - F.pmod(a, b)) / b).cast("long")


def ceil_div(a, b) -> Column:
    return -floor_div(-col_of(a), b)


def floor_to_grid(c, interval_seconds: int = 30, dtype: T.DataType | None = None) -> Column:
    """Epoch-aligned floor of a timestamp to ``interval_seconds`` (NTZ out)."""
    u = us_of(c, dtype)
    return ts_of(u - F.pmod(u, F.lit(interval_seconds * US)))


def parse_us(c) -> Column:
    """ISO-8601 string → micros since the epoch (UTC); unparsable, empty or
    NULL → NULL. A zone suffix is honoured; a naive string is already UTC."""
    s = F.trim(col_of(c))
    s = F.when(s != "", s)
    zoned = F.unix_micros(s.try_cast("timestamp"))
    naive = us_of(s.try_cast("timestamp_ntz"))
    return F.when(s.rlike(_ZONE_SUFFIX), zoned).otherwise(naive)


def parse_ts(c) -> Column:
    """ISO-8601 string → TIMESTAMP_NTZ (UTC); NULL on failure."""
    return ts_of(parse_us(c))


def seconds_between(later_us, earlier_us) -> Column:
    return (col_of(later_us) - col_of(earlier_us)) / F.lit(float(US))


def duration_seconds(c) -> Column:
    """Duration in micros (LONG) → DOUBLE seconds."""
    return col_of(c).cast("double") / F.lit(float(US))
