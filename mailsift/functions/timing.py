"""Backoff delays and timestamps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values: (first delay, longest delay) in seconds.
RECONNECT = (5, 300)
SCORING = (2, 8)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; takes either timestamp type (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def retry_delay(attempt: Column, base: float = 5, cap: float = 300) -> Column:
    """Seconds to wait after the n-th failed attempt: ``min(base * 2^(n-1), cap)``."""
    doubled = F.lit(float(base)) * F.pow(F.lit(2.0), attempt - F.lit(1))
    return F.least(doubled, F.lit(float(cap)))
