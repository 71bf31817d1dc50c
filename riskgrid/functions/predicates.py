"""Row predicates, coercions and display bands (built-in expressions only)."""
from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskgrid.functions import constants as K
from riskgrid.functions.time import col_of


def _s(c) -> Column:
    return F.coalesce(col_of(c).cast("string"), F.lit(""))


def is_event_start(category="category", flag="flag", message="message",
                   categories: Iterable[str] = K.START_CATEGORIES, flags: Iterable[str] = K.START_FLAGS,
                   start_pattern: str = K.START_PATTERN, end_pattern: str = K.END_PATTERN) -> Column:
    """P5: an END message never starts an event; otherwise a structured
    category/flag match (case-sensitive) or the START pattern does."""
    cats, flgs = list(categories), list(flags)
    structured = F.lit(False)
    if cats:
        structured = structured | _s(category).isin(cats)
    if flgs:
        structured = structured | _s(flag).isin(flgs)
    msg = _s(message)
    return (~msg.rlike(end_pattern)) & (structured | msg.rlike(start_pattern))


def coerce_double(c) -> Column:
    """string/number → DOUBLE; unparsable, NaN or with a type suffix (``1d``) → NULL."""
    s = col_of(c).cast("string")
    return nan_to_null(F.when(~s.rlike(r"(?i)[0-9.][df]\s*$"), s.try_cast("double")))


def nan_to_null(c) -> Column:
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def scrub(c) -> Column:
    """NaN and ±Inf → NULL."""
    c = col_of(c)
    return F.when(~(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), c)


def round_scaled(c, digits: int) -> Column:
    """P25 for columns of a frame: the nearest whole number of the scaled value, ties to even."""
    s = float(10**digits)
    return F.rint(col_of(c).cast("double") * F.lit(s)) / F.lit(s)


def round_exact(c, digits: int) -> Column:
    """P25 for single numbers: the binary value is rounded as it is, so only an exact tie
    goes to even. The product with the power of ten is taken with its rounding error
    (Dekker), which decides when the rounded product ends in a half."""
    x, s = col_of(c).cast("double"), float(10**digits)
    cut = 134217729.0  # 2**27 + 1
    s_hi = cut * s - (cut * s - s)
    s_lo = s - s_hi
    p = x * F.lit(s)
    x_hi = x * F.lit(cut) - (x * F.lit(cut) - x)
    x_lo = x - x_hi
    error = ((x_hi * F.lit(s_hi) - p) + x_hi * F.lit(s_lo) + x_lo * F.lit(s_hi)) + x_lo * F.lit(s_lo)
    low = F.floor(p).cast("double")
    half = (p - low) == F.lit(0.5)
    whole = F.when(half & (error > 0), low + 1).when(half & (error < 0), low).otherwise(F.rint(p))
    return F.when(F.abs(p) < F.lit(float(2**52)), whole / F.lit(s)).otherwise(x)


def rainfall_double(c) -> Column:
    """true/false/number → DOUBLE, NULL → 0.0."""
    s = F.lower(F.trim(col_of(c).cast("string")))
    return F.coalesce(F.when(s == "true", 1.0).when(s == "false", 0.0).otherwise(coerce_double(s)),
                      F.lit(0.0))


def highlight_any(cols: Iterable, needles: Iterable[str] = ("safety car", "vsc", "virtual")) -> Column:
    """P18 (table variant): any needle in any single lower-cased column."""
    out = F.lit(False)
    for c in cols:
        low = F.lower(_s(c))
        for n in needles:
            out = out | low.contains(n)
    return out


def is_intervention_message(category="category", message="message", flag="flag",
                            needles: Iterable[str] = ("safety car", "vsc", "virtual safety car")) -> Column:
    """P18 (feed variant): needle in the space-joined ``category message flag``."""
    text = F.lower(F.concat_ws(" ", _s(category), _s(message), _s(flag)))
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def category_highlight(category="category") -> Column:
    """P18 (category variant): ``SafetyCar`` substring first, so it also
    covers ``VirtualSafetyCar``."""
    c = _s(category)
    return F.when(c.contains("SafetyCar"), "sc").when(c.contains("VirtualSafetyCar"), "vsc").otherwise("")


def message_class(category="category", message="message", flag="flag") -> Column:
    """Class of a feed message, first match wins."""
    cat, flg = F.lower(_s(category)), F.lower(_s(flag))
    return (F.when(is_intervention_message(category, message, flag), "intervention")
            .when(flg.contains("red") | cat.contains("red"), "red")
            .when(flg.contains("yellow") | cat.contains("yellow"), "yellow")
            .when(flg.contains("green") | cat.contains("green"), "green")
            .when(flg.contains("chequered"), "chequered")
            .otherwise("other"))


def flag_class(flag="flag") -> Column:
    """Class of a flag string; the substring ``sc`` is tested first."""
    f = F.lower(_s(flag))
    return (F.when(f.contains("safety car") | f.contains("sc"), "intervention")
            .when(f.contains("virtual"), "virtual")
            .when(f.contains("red"), "red")
            .when(f.contains("yellow"), "yellow")
            .when(f.contains("green"), "green")
            .when(f.contains("chequered") | f.contains("checkered"), "chequered")
            .otherwise("other"))


def risk_band(c) -> Column:
    """P20: ≥0.6 high, ≥0.35 medium, else low (inclusive lower bounds)."""
    c = col_of(c)
    return F.when(c >= K.RISK_HIGH, "high").when(c >= K.RISK_MEDIUM, "medium").otherwise("low")


def rate_band(c) -> Column:
    """>5 high, >3 medium, else low (strict)."""
    c = col_of(c)
    return F.when(c > K.RATE_HIGH, "high").when(c > K.RATE_MEDIUM, "medium").otherwise("low")


def keyword_flags(text, patterns: Mapping[str, str] = K.KEYWORD_FLAGS) -> list[Column]:
    """One 0/1 INT column per pattern, searched in ``text``."""
    t = _s(text)
    return [F.when(t.rlike(p), 1).otherwise(0).alias(name) for name, p in patterns.items()]
