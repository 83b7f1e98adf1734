"""Clock arithmetic on UTC nanoseconds; nothing depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000


def local_ns(ns: str | Column, tz: str = "tz") -> Column:
    """Wall-clock ns since 1970 in the zone of column ``tz``, whatever the session's time zone."""
    c = F.expr(f"{ns} div 1000") if isinstance(ns, str) else ns
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(c), F.col(tz))) * F.lit(1000)


def utc_ns(local: Column, tz: str = "tz") -> Column:
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros((local / 1000).cast("long")), F.col(tz))) * F.lit(1000)


def local_day(ns: str, tz: str = "tz") -> Column:
    """Days since 1970 of the local date."""
    return F.floor(local_ns(ns, tz) / F.lit(DAY_NS)).cast("long")


def local_minute(ns: str, tz: str = "tz") -> Column:
    """Minute of the local day, seconds cut off."""
    return F.floor((local_ns(ns, tz) % F.lit(DAY_NS)) / F.lit(60_000_000_000)).cast("long")


def session_close_ns(ns: str, tz: str = "tz") -> Column:
    """UTC ns of the regular close on the local date, by wall clock: right across changes of the clock."""
    return utc_ns(local_day(ns, tz) * F.lit(DAY_NS) + F.col("rth_to") * F.lit(60_000_000_000), tz)


def iso_week(day: Column) -> Column:
    """``YYYY-Www`` of days since 1970."""
    d = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def week_key(ns: str, tz: str = "tz") -> Column:
    return iso_week(local_day(ns, tz))


def utc_year(ns: str) -> Column:
    return F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.expr(f"cast(floor({ns} / {DAY_NS}L) as int)"))).cast("long")
