"""Times with and without zone, deadlines and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZONED = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:?\d\d)$"


def zoned_time(text: Column) -> Column:
    """The moment of an ISO time with a zone; null for a time without one and for anything else."""
    return F.when(text.rlike(_ZONED), F.try_to_timestamp(text))


def expired(valid_to: Column, at: Column) -> Column:
    """Whether the moment ``at`` is after ``valid_to``: a date holds to its last microsecond, a time without zone is UTC.

    Null and blank never expire; unreadable text gives null.
    """
    text = F.trim(valid_to)
    day_end = F.try_to_timestamp(F.concat(text, F.lit("T23:59:59.999999Z")))
    end = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), day_end).otherwise(F.try_to_timestamp(text))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(False)).otherwise(end < at)


def freshness(collected: Column, now: Column, hours: Column, ahead_minutes: int = 5) -> Column:
    """``observed``, ``stale`` (older than the hours) or ``unknown`` (missing, or later than now by more than the minutes)."""
    limit = now - F.make_dt_interval(hours=hours)
    return (
        F.when(collected.isNull() | (collected > now + F.expr(f"INTERVAL {ahead_minutes} MINUTES")), "unknown")
        .when(collected < limit, "stale")
        .otherwise("observed")
    )
