"""UTC instants, local days and run dates. "Today" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/Bucharest"


def minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def local_day(ts: Column, zone: str = LOCAL_ZONE, shift_minutes: int = 0) -> Column:
    """The local calendar day of a UTC instant, after an optional shift."""
    moved = ts if shift_minutes == 0 else ts + minutes(shift_minutes)
    return F.to_date(F.from_utc_timestamp(moved.cast("timestamp"), zone))


def hours_in_local_day(day: Column, zone: str = LOCAL_ZONE) -> Column:
    """23, 24 or 25: the length of a local day in real hours."""
    start = F.to_utc_timestamp(day.cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)
    return F.expr("bigint(0)") + F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600)


def expected_steps(day: Column, interval_hours: int, zone: str = LOCAL_ZONE) -> Column:
    return F.greatest(F.lit(1), F.round(hours_in_local_day(day, zone) / interval_hours)).cast("bigint")


def hour_axis(base: Column, hours: Column) -> Column:
    """Base instant plus a (fractional) number of hours."""
    return F.timestamp_micros(F.unix_micros(base.cast("timestamp"))
                              + F.round(hours * 3600000000).cast("bigint"))


def candidate_dates(today: Column, latest: Column, count: int = 3) -> Column:
    """Run dates to try, newest first, never in the future; yesterday if no latest is known."""
    first = F.when(latest.isNull(), F.date_sub(today, 1)).otherwise(F.least(today, latest))
    return F.sequence(first, F.date_sub(first, count - 1), F.expr("interval -1 day"))


def run_token(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
