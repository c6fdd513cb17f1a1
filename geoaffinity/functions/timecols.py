"""Calendar fields of epoch seconds in a named zone.

Nothing here reads the session time zone: UTC is plain arithmetic on the
number, other zones go through zone-free timestamps.
"""

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F


def _local(sec: Column, tz: str) -> Column:
    naive = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), sec.cast("decimal(18,6)")
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), naive)


def _date(sec: Column, tz: str) -> Column:
    if tz == "UTC":
        return F.date_from_unix_date(F.floor(sec / F.lit(86400)).cast("int"))
    return _local(sec, tz).cast("date")


def hour_of(sec: Column, tz: str = "UTC") -> Column:
    """Hour 0-23."""
    if tz == "UTC":
        return F.floor(F.pmod(sec, F.lit(86400)) / F.lit(3600)).cast("int")
    return F.hour(_local(sec, tz))


def weekday_of(sec: Column, tz: str = "UTC") -> Column:
    """Day of the week, Monday = 0 .. Sunday = 6."""
    return F.weekday(_date(sec, tz))


def day_of(sec: Column, tz: str = "UTC") -> Column:
    """Calendar day as ``yyyyMMdd`` text."""
    return F.replace(_date(sec, tz).cast("string"), F.lit("-"), F.lit(""))


def day_bounds(first: str, last: str, tz: str = "UTC") -> tuple[int, int]:
    """Epoch seconds [lo, hi) covering the days ``first``..``last`` inclusive."""
    zone = ZoneInfo(tz)
    lo = datetime.strptime(first, "%Y%m%d").replace(tzinfo=zone)
    hi = (datetime.strptime(last, "%Y%m%d") + timedelta(days=1)).replace(tzinfo=zone)
    return int(lo.timestamp()), int(hi.timestamp())


def in_days(sec: Column, first: str, last: str, tz: str = "UTC") -> Column:
    """Day-window test written on the raw number, so that it reaches the scan."""
    lo, hi = day_bounds(first, last, tz)
    return (sec >= F.lit(lo)) & (sec < F.lit(hi))
