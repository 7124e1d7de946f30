"""Scalar Column expressions (SC1-SC10). All JVM-side built-ins, codegen friendly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

_TIMEDELTA_TEXT = r"^\s*(-?\d+) days? (\d+):(\d+):(\d+(?:\.\d+)?)\s*$"


def nan_to_null(c: Column) -> Column:
    """NaN -> NULL (pandas skips NaN in aggregates, Spark does not)."""
    return F.nanvl(c, F.lit(None).cast("double"))


def interval_seconds(c: Column) -> Column:
    """DayTimeInterval -> seconds as DOUBLE."""
    return (F.extract(F.lit("DAY"), c).cast("double") * 86400
            + F.extract(F.lit("HOUR"), c).cast("double") * 3600
            + F.extract(F.lit("MINUTE"), c).cast("double") * 60
            + F.extract(F.lit("SECOND"), c).cast("double"))


def timedelta_text_seconds(c: Column) -> Column:
    """``'0 days 00:14:16.306000'`` (pandas text form) or ``'00:01:20.5'`` -> seconds."""
    full = F.regexp_extract(c, _TIMEDELTA_TEXT, 0) != ""
    days = F.regexp_extract(c, _TIMEDELTA_TEXT, 1).try_cast("double")
    hrs = F.regexp_extract(c, _TIMEDELTA_TEXT, 2).try_cast("double")
    mins = F.regexp_extract(c, _TIMEDELTA_TEXT, 3).try_cast("double")
    secs = F.regexp_extract(c, _TIMEDELTA_TEXT, 4).try_cast("double")
    short = r"^\s*(\d+):(\d+):(\d+(?:\.\d+)?)\s*$"
    s_h = F.regexp_extract(c, short, 1).try_cast("double")
    s_m = F.regexp_extract(c, short, 2).try_cast("double")
    s_s = F.regexp_extract(c, short, 3).try_cast("double")
    return (F.when(full, days * 86400 + hrs * 3600 + mins * 60 + secs)
            .otherwise(s_h * 3600 + s_m * 60 + s_s))


def seconds_of(df: DataFrame, name: str) -> Column:
    """SC1: duration column of any supported type -> DOUBLE seconds; NULL stays NULL."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.DayTimeIntervalType):
        return interval_seconds(c)
    if isinstance(dtype, T.StringType):
        return timedelta_text_seconds(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        # a timestamp used as elapsed time since the epoch
        return F.unix_micros(c.cast("timestamp")) / 1e6
    return nan_to_null(c.try_cast("double"))


def add_seconds_column(df: DataFrame, source: str, target: str) -> DataFrame:
    """SC2: add ``target`` seconds if ``source`` exists, else return ``df`` unchanged."""
    if source not in df.columns:
        return df
    return df.withColumn(target, seconds_of(df, source))


def coerce_number(c: Column) -> Column:
    """SC3: text/bool/number -> DOUBLE; unparsable text and NaN -> NULL (ANSI safe)."""
    return nan_to_null(c.try_cast("double"))


def binary_flag(c: Column) -> Column:
    """SC4: NULL -> 0, any non-zero -> 1."""
    return (F.coalesce(nan_to_null(c.try_cast("double")), F.lit(0.0)) != 0).cast("int")


def drs_active(c: Column) -> Column:
    """SC5: DRS code >= 10 means the flap is open."""
    return F.when(F.coalesce(nan_to_null(c.try_cast("double")), F.lit(0.0)) >= 10, 1).otherwise(0)


def slug(c: Column) -> Column:
    """SC7: every non-alphanumeric char -> '_' (runs kept), lower case, '_' trimmed at both ends."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "_"), F.lit("_"))


def session_key(year: Column, grand_prix: Column, session_type: Column) -> Column:
    """IO11: ``{year}_{slug(grand_prix)}_{slug(session_type)}``."""
    return F.concat_ws("_", year.cast("string"), slug(grand_prix), slug(session_type))


def session_label(year: Column, grand_prix: Column, session_type: Column) -> Column:
    """SC9: ``'{year} {grand_prix} {session_type}'``."""
    return F.concat_ws(" ", year.cast("string"), grand_prix, session_type)


def millis_text(seconds: Column) -> Column:
    """Seconds with three decimals via integer milliseconds (same digits in every engine)."""
    ms = F.round(nan_to_null(seconds.cast("double")) * 1000).try_cast("bigint")
    sign = F.when(ms < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(ms)
    return F.concat(sign, (a / 1000).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((a % 1000).cast("string"), 3, "0"))


def lap_label(driver: Column, lap_number: Column, lap_time: Column) -> Column:
    """SC9: ``'{driver} L{n} ({t:.3f}s)'``; a missing lap time reads 'nan' as in Python."""
    t = F.coalesce(millis_text(lap_time), F.lit("nan"))
    return F.concat(driver, F.lit(" L"), lap_number.cast("int").cast("string"), F.lit(" ("), t, F.lit("s)"))


def corner_label(number: Column, letter: Column) -> Column:
    """SC8: number + letter, trimmed; a missing letter is empty."""
    return F.trim(F.concat(F.coalesce(F.trim(number.cast("int").cast("string")), F.lit("")),
                           F.trim(F.coalesce(letter, F.lit("")))))


def text_or_unknown(c: Column) -> Column:
    """SC10: missing team / compound text -> 'Unknown'."""
    return F.coalesce(c.cast("string"), F.lit("Unknown"))


def optional_int(c: Column) -> Column:
    """SC6: NULL passes through, otherwise cast (bad text -> NULL)."""
    return nan_to_null(c.try_cast("double")).cast("int")
