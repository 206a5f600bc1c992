"""Calendar keys in a time zone, week starts, and durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day names in the order of a week that starts on Sunday.
DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def in_zone(ts: Column, zone: str = "UTC") -> Column:
    return ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)


def day_key(ts: Column, zone: str = "UTC") -> Column:
    return F.date_format(in_zone(ts, zone), "yyyy-MM-dd")


def month_key(ts: Column, zone: str = "UTC") -> Column:
    return F.date_format(in_zone(ts, zone), "yyyy-MM")


def week_start(day: Column, first_day: str = "sunday") -> Column:
    """First day of the week that holds a date, as yyyy-MM-dd."""
    back = F.pmod(F.dayofweek(day) - 1 - DAYS.index(first_day), F.lit(7))
    return F.date_format(F.date_sub(day, back.cast("int")), "yyyy-MM-dd")


def week_key(ts: Column, zone: str = "UTC", first_day: str = "sunday") -> Column:
    return week_start(F.to_date(in_zone(ts, zone)), first_day)


def iso_week_key(ts: Column, zone: str = "UTC") -> Column:
    """ISO week as 2025-W01; its year is the one that holds the week's Thursday."""
    local = in_zone(ts, zone)
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), local), F.weekofyear(local))


def filter_date(text: str | None) -> str | None:
    """yyyyMMdd from yyyyMMdd or yyyy-MM-dd; None stays."""
    if text is None:
        return None
    plain = text.strip().replace("-", "")
    if not re.fullmatch(r"\d{8}", plain):
        raise ValueError(f"not a date: {text}")
    return plain


def in_range(day: Column, since: str | None, until: str | None) -> Column:
    """Whether a yyyy-MM-dd key lies between two filter dates, both included."""
    plain, keep = F.regexp_replace(day, "-", ""), F.lit(True)
    if since is not None:
        keep = keep & (plain >= filter_date(since))
    if until is not None:
        keep = keep & (plain <= filter_date(until))
    return keep


def hours_minutes(minutes: Column) -> Column:
    """90 as 1h 30m, 20 as 20m."""
    whole = minutes.cast("long")
    short = F.concat((whole % 60).cast("string"), F.lit("m"))
    return F.when(whole >= 60, F.concat(F.floor(whole / 60).cast("string"), F.lit("h "), short)).otherwise(short)


def compact_day(day: Column) -> Column:
    """2025-08-04 as 2025 and 08-04 on two lines."""
    return F.concat(F.substring(day, 1, 4), F.lit("\n"), F.substring(day, 6, 5))
