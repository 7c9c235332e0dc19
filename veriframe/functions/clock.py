"""Elapsed time on epoch nanoseconds. The clock is always an argument; arithmetic stays in longs, and the column stands
alone on one side of the comparison, so that the test reaches the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_DAY = 86_400_000_000_000


def elapsed_over(ts: Column, now_ns: int, days: int) -> Column:
    """More than ``days`` days ago, to the nanosecond (the policy rules' test). Null stays null."""
    return ts < F.lit(now_ns - days * NS_PER_DAY)


def whole_days_over(ts: Column, now_ns: int, days: int) -> Column:
    """More than ``days`` whole days ago (the checks' test): a day later than elapsed_over would say."""
    return ts <= F.lit(now_ns - (days + 1) * NS_PER_DAY)


def not_due_yet(due: Column, now_ns: int) -> Column:
    return due >= F.lit(now_ns)


def epoch_ns(ts: str) -> Column:
    """A timestamp without zone as epoch nanoseconds, whatever the session's zone."""
    return F.expr(f"unix_date(to_date({ts})) * 86400000000000L + hour({ts}) * 3600000000000L + minute({ts}) * 60000000000L + cast(extract(SECOND FROM {ts}) * 1000000 AS bigint) * 1000L")
