"""Row filters and one-pass routing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from mailsift.functions.verdict import disposition


def _cutoff(as_of: Column | dt.datetime | str, hours: int) -> Column:
    if isinstance(as_of, str):
        as_of = F.lit(as_of).cast("timestamp")
    elif isinstance(as_of, dt.datetime):
        as_of = F.lit(as_of)
    return as_of - F.expr(f"INTERVAL {int(hours)} HOURS")


def recent(
    df: DataFrame, as_of: Column | dt.datetime | str, hours: int = 24, ts: str = "received_at"
) -> DataFrame:
    """Messages not older than ``hours`` before ``as_of``, lower bound inclusive.

    A plain comparison with a constant, so it reaches the file scan.
    """
    return df.where(F.col(ts) >= _cutoff(as_of, hours))


def pending(df: DataFrame, name: str = "name") -> DataFrame:
    """Staged entries waiting to be processed: ``.mail`` only."""
    return df.where(F.col(name).endswith(".mail"))


def split_by_verdict(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Add ``disposition``; both branches stay in one DataFrame, so nothing is scanned twice."""
    return df.withColumn("disposition", disposition(F.col(verdict)))


def split_malformed(df: DataFrame, error: str = "error") -> DataFrame:
    """Add ``disposition`` = failed and its ``reason`` to messages that could not be parsed."""
    broken = F.col(error).isNotNull()
    return df.withColumn("disposition", F.when(broken, "failed")).withColumn(
        "reason", F.when(broken, F.concat(F.lit("Parse error: "), F.col(error)))
    )


def retry_first(staged: DataFrame, new: DataFrame) -> DataFrame:
    """Staged and new messages together; lower ``priority`` is to be processed first."""
    return staged.withColumn("priority", F.lit(0)).unionByName(
        new.withColumn("priority", F.lit(1)), allowMissingColumns=True
    )


def folder_union(*folders: DataFrame) -> DataFrame:
    """All messages of several folders, duplicates kept."""
    first, *others = folders
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
