"""Dates and ages. The reference time ``as_of`` is always a parameter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from listflow.functions import fixed_values as fv
from listflow.functions.text import plain_spaces

DAY_MICROS = 86_400_000_000


def as_timestamp(value: "Column | datetime | str") -> Column:
    if isinstance(value, Column):
        return value.cast("timestamp")
    return F.lit(value).cast("timestamp")


def days_before(as_of: "Column | datetime | str", days: int) -> Column:
    return as_timestamp(as_of) - F.make_dt_interval(days=F.lit(days))


def minutes_before(as_of: "Column | datetime | str", minutes: int) -> Column:
    return as_timestamp(as_of) - F.make_dt_interval(mins=F.lit(minutes))


def parse_date(text: Column) -> Column:
    """Four ISO forms and ``dd/MM/yyyy``, read as UTC; anything else is null."""
    iso = r"^\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2}((\.\d{1,6})?Z)?)?$"
    return F.coalesce(
        F.when(F.rlike(text, F.lit(iso)), text.try_cast("timestamp")),
        F.when(
            F.rlike(text, F.lit(r"^\d{1,2}/\d{1,2}/\d{4}$")),
            F.try_to_timestamp(text, F.lit("d/M/yyyy")),
        ),
    )


def relative_date(text: Column, as_of: "Column | datetime | str") -> Column:
    """``3 days ago`` and the like; a month is 30 days; no number, or one too large for a date, is null."""
    pattern = r"([0-9]+) *(day|hour|week|month)"
    lowered = plain_spaces(F.lower(text))
    count = F.regexp_extract(lowered, pattern, 1).try_cast("int")
    unit = F.regexp_extract(lowered, pattern, 2)
    hours = (
        F.when(unit == "hour", count)
        .when(unit == "day", F.try_multiply(count, F.lit(24)))
        .when(unit == "week", F.try_multiply(count, F.lit(24 * 7)))
        .when(unit == "month", F.try_multiply(count, F.lit(24 * 30)))
    )
    return as_timestamp(as_of) - F.make_dt_interval(hours=hours)


def age_days(ts: Column, as_of: "Column | datetime | str") -> Column:
    """Whole elapsed days, rounded down; negative for the future."""
    elapsed = F.unix_micros(as_timestamp(as_of)) - F.unix_micros(as_timestamp(ts))
    return F.floor(elapsed / DAY_MICROS)


def age_label(ts: Column, as_of: "Column | datetime | str") -> Column:
    """``5m ago``, ``3h ago``, ``2d ago``, ``4w ago``, else the date."""
    seconds = (F.unix_micros(as_timestamp(as_of)) - F.unix_micros(as_timestamp(ts))) / 1_000_000
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    days = F.floor(seconds / 86400)
    weeks = F.floor(days / 7)

    def label(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(ts.isNull(), "")
        .when(minutes < 60, label(minutes, "m"))
        .when(hours < 24, label(hours, "h"))
        .when(days < 7, label(days, "d"))
        .when(weeks < 5, label(weeks, "w"))
        .otherwise(F.date_format(as_timestamp(ts), "M/d/yyyy"))
    )


def is_new(created_at: Column, as_of: "Column | datetime | str", minutes: int = fv.NEW_MINUTES) -> Column:
    return F.coalesce(as_timestamp(created_at) > minutes_before(as_of, minutes), F.lit(False))


def freshness(
    posted: Column,
    as_of: "Column | datetime | str",
    steps: tuple[int, ...] = (1, 3, 7, 14),
    expiry_days: int = fv.EXPIRY_DAYS,
) -> Column:
    """``le_1`` ... ``le_14``, ``older``, ``stale``; null without a date."""
    days = age_days(posted, as_of)
    out = F.when(posted.isNull(), F.lit(None).cast("string"))
    for step in steps:
        out = out.when(days <= step, f"le_{step}")
    return out.when(as_timestamp(posted) < days_before(as_of, expiry_days), "stale").otherwise("older")
