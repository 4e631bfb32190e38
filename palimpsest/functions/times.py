"""Instants as UTC text of fixed width, so that text order is time order."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def as_text(ts: Column) -> Column:
    return F.date_format(ts, FORMAT)


def normalized(value: Column) -> Column:
    """An instant with any offset as UTC text with milliseconds; null where it can't be read."""
    return as_text(F.try_to_timestamp(F.trim(value)))


def instant(value: str) -> str:
    """The same of a single text: UTC with milliseconds (what lies between them goes). A text without a day, a time and an offset is refused."""
    try:
        at = datetime.fromisoformat(value.strip())
    except ValueError:
        at = None
    if at is None or at.tzinfo is None:
        raise ValueError(f"not an instant in ISO 8601: {value!r}")
    at = at.astimezone(UTC)
    return f"{at:%Y-%m-%dT%H:%M:%S}.{at.microsecond // 1000:03d}Z"


def from_millis(ms: Column) -> Column:
    return as_text(F.timestamp_millis(ms))


def age_days(created_at: Column, now: str) -> Column:
    """Whole seconds from created_at to now in days, at least 0; 0 where created_at can't be read."""
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(created_at))
    return F.greatest(F.lit(0), F.coalesce(seconds, F.lit(0))) / 86400.0
