"""Timestamps at the fixed +08:00 offset and calendar labels.

Local hours and dates are whole-second arithmetic on the epoch, so they do not
depend on the session time zone and stay inside generated code.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliospan.functions.numbers import first_nonzero, is_blank

LOCAL = timezone(timedelta(hours=8))
OFFSET_SECONDS = 8 * 3600
DAY_SECONDS = 86400
# Epoch milliseconds of years 1 to 9999; anything else is not a timestamp.
MIN_MILLIS, MAX_MILLIS = -62135596800000, 253402300799999


def local_time(text: str) -> datetime:
    """``2024-01-30 14:30`` as a moment at the local offset."""
    return datetime.fromisoformat(text).replace(tzinfo=LOCAL)


def moment(when: datetime) -> Column:
    """A Python moment as a TIMESTAMP literal."""
    return F.timestamp_micros(F.lit(int(when.timestamp() * 1_000_000)).cast("bigint"))


def point_millis(time: Column, data_timestamp: Column) -> Column:
    return first_nonzero(time, data_timestamp).try_cast("bigint")


def millis_timestamp(millis: Column) -> Column:
    return F.timestamp_millis(F.when(millis.between(MIN_MILLIS, MAX_MILLIS), millis))


def point_timestamp(time: Column, data_timestamp: Column) -> Column:
    """Epoch milliseconds of a point; null when missing or not a whole number."""
    return millis_timestamp(point_millis(time, data_timestamp))


def epoch_key(ts: Column) -> Column:
    """Whole seconds of a timestamp or of ISO text; null when it does not parse."""
    return F.unix_seconds(ts.try_cast("timestamp"))


def _local_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts) + F.lit(OFFSET_SECONDS)


def local_hour(ts: Column) -> Column:
    return F.floor(F.pmod(_local_seconds(ts), F.lit(DAY_SECONDS)) / 3600).cast("int")


def local_second_of_day(ts: Column) -> Column:
    return F.pmod(_local_seconds(ts), F.lit(DAY_SECONDS))


def local_date(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(_local_seconds(ts) / DAY_SECONDS).cast("int"))


def iso_date(text: Column) -> Column:
    """Three-part date text as DATE, null otherwise."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))


def local_noon(date: Column) -> Column:
    """12:00 local of a DATE."""
    return F.timestamp_seconds(
        F.unix_date(date).cast("bigint") * DAY_SECONDS + (12 * 3600 - OFFSET_SECONDS)
    )


def day_bounds(as_of: datetime) -> tuple[datetime, datetime]:
    """Start of the local day and of the next one."""
    start = as_of.astimezone(LOCAL).replace(hour=0, minute=0, second=0, microsecond=0)
    return start, start + timedelta(days=1)


def local_calendar(as_of: datetime) -> dict[str, str]:
    """Today, this month and this year at the local offset, as text."""
    today = as_of.astimezone(LOCAL)
    return {
        "today": today.strftime("%Y-%m-%d"),
        "month": today.strftime("%Y-%m"),
        "year": today.strftime("%Y"),
    }


def clock_label(text: Column) -> Column:
    """``13:07:00`` becomes ``1:07 PM``; text without a colon is kept."""
    value = F.coalesce(text, F.lit(""))
    parts = F.split(value, ":")
    hour = F.try_element_at(parts, F.lit(1)).try_cast("int")
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    label = F.concat(
        twelve.cast("string"), F.lit(":"), F.try_element_at(parts, F.lit(2)),
        F.when(hour >= 12, " PM").otherwise(" AM"),
    )
    return F.when(value.contains(":"), label).otherwise(value)


def month_day_label(text: Column) -> Column:
    """``2026-04-08`` becomes ``Apr 8``; text that is not a date is kept."""
    value = F.coalesce(text, F.lit(""))
    return F.when(is_blank(text), value).otherwise(
        F.coalesce(F.date_format(iso_date(value), "MMM d"), value)
    )
