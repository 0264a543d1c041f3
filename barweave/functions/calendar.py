"""Date Column expressions and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.functions.maths import as_col

# Calendar parts used per sampling frequency.
PARTS_BY_FREQUENCY = {
    "Y": [],
    "Q": ["month_of_year"],
    "M": ["month_of_year"],
    "W": ["day_of_month", "week_of_year"],
    "D": ["day_of_week", "day_of_month", "day_of_year"],
    "B": ["day_of_week", "day_of_month", "day_of_year"],
    "H": ["hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
    "T": ["minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
    "S": ["second_of_minute", "minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
}


def utc_day(col) -> Column:
    """The UTC day of an instant, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(as_col(col).cast("timestamp")) / F.lit(86_400_000_000)).cast("int"))


def utc_day_text(col) -> Column:
    return F.concat(utc_day(col).cast("string"), F.lit(" 00:00:00+00:00"))


def calendar_part(name: str, ts) -> Column:
    """One calendar part scaled to [-0.5, 0.5]."""
    ts = as_col(ts)
    scaled = {
        "second_of_minute": lambda: F.second(ts) / 59.0,
        "minute_of_hour": lambda: F.minute(ts) / 59.0,
        "hour_of_day": lambda: F.hour(ts) / 23.0,
        "day_of_week": lambda: F.weekday(ts) / 6.0,
        "day_of_month": lambda: (F.dayofmonth(ts) - 1) / 30.0,
        "day_of_year": lambda: (F.dayofyear(ts) - 1) / 365.0,
        "month_of_year": lambda: (F.month(ts) - 1) / 11.0,
        "week_of_year": lambda: (F.weekofyear(ts) - 1) / 52.0,
    }
    return scaled[name]() - 0.5


def calendar_features(df: DataFrame, ts: str, freq: str) -> DataFrame:
    return df.withColumns({p: calendar_part(p, ts) for p in PARTS_BY_FREQUENCY[freq]})
