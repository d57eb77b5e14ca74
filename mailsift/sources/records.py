"""Ledger, processor status and scanner log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsift.functions.clean import sanitize_log
from mailsift.sources.batches import BatchTable

LEDGER_LINE = "message_key string, verdict string, reason string"
LEDGER = LEDGER_LINE + ", scanned_at timestamp"
STATUS_JSON = (
    "last_successful_fetch string, consecutive_failures bigint, last_error string, "
    "is_connected boolean, updated_at string"
)
# Line prefixes of the scanner log and the kind of event each stands for.
LOG_KINDS = (
    ("  -> ", "verdict"),
    ("SCAN: ", "scan"),
    ("SKIP: ", "skip"),
    ("RATE LIMITED: ", "rate_limited"),
    ("  ACTION: ", "action"),
    ("  Attempt ", "attempt"),
    ("  WARNING: ", "warning"),
    ("  FAILED: ", "failed"),
)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The table of processed messages."""
    return spark.read.schema(LEDGER).parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Record processed messages."""
    df.select(
        "message_key", "verdict", "reason", F.col("scanned_at").cast("timestamp")
    ).write.mode("append").parquet(path)


def ledger_batches(spark: SparkSession, path: str) -> BatchTable:
    """The ledger kept batch by batch: a batch that is recorded again replaces itself as a whole."""
    return BatchTable(spark, path, LEDGER)


def write_ledger_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """Record the messages of one batch; a replay leaves neither copies nor a gap."""
    rows = df.select("message_key", "verdict", "reason", F.col("scanned_at").cast("timestamp"))
    ledger_batches(df.sparkSession, path).write(rows, batch_id)


def read_ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """Ledger kept as ``name|verdict|reason`` text lines."""
    return spark.read.csv(path, sep="|", schema=LEDGER_LINE, quote="", escape="")


def append_ledger_lines(df: DataFrame, path: str) -> None:
    """Write ledger text lines, the reason cleaned and cut to 50 characters."""
    reason = F.translate(sanitize_log(F.col("reason"), 50), "|", " ")
    line = F.concat_ws("|", "message_key", "verdict", reason)
    df.select(line.alias("value")).write.mode("append").text(path)


def read_status(df: DataFrame, report: str = "status") -> DataFrame:
    """Typed fields of processor status reports; unreadable reports give no row.

    Every report carries ``updated_at``, so a report without it could not be read. Times that
    cannot be read are null; a missing connection flag counts as connected.
    """
    kept = [c for c in df.columns if c != report]
    parsed = df.select(*kept, F.from_json(report, STATUS_JSON).alias("_s"))

    def time(field: str) -> Column:
        return F.try_to_timestamp(F.col(f"_s.{field}"))

    return parsed.where(F.col("_s.updated_at").isNotNull()).select(
        *kept,
        time("last_successful_fetch").alias("last_successful_fetch"),
        F.coalesce("_s.consecutive_failures", F.lit(0).cast("bigint")).alias(
            "consecutive_failures"
        ),
        F.col("_s.last_error").alias("last_error"),
        F.coalesce("_s.is_connected", F.lit(True)).alias("is_connected"),
        time("updated_at").alias("updated_at"),
    )


def parse_scan_log(df: DataFrame, line: str = "value") -> DataFrame:
    """Event table of scanner log lines.

    ``ts, kind, verdict, reason, detail, is_error``; a line without a time stamp, such as one of a
    stack trace, is kept with a null ``ts``. Null lines are dropped.
    """
    stamp = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] "
    kept = [c for c in df.columns if c != line]
    rows = df.where(F.col(line).isNotNull()).select(
        *kept,
        F.nullif(F.regexp_extract(F.col(line), stamp, 1), F.lit("")).alias("_ts"),
        F.regexp_replace(F.col(line), stamp, "").alias("_text"),
    )
    text = F.col("_text")
    is_error = text.contains("ERROR")
    kind = F.when(is_error, "error")
    for prefix, name in LOG_KINDS:
        kind = kind.when(text.startswith(prefix), name)
    verdict = r"^  -> (SAFE|QUARANTINE) \| (.*)$"
    return rows.select(
        *kept,
        F.try_to_timestamp("_ts").alias("ts"),
        kind.otherwise("other").alias("kind"),
        F.nullif(F.regexp_extract(text, verdict, 1), F.lit("")).alias("verdict"),
        F.nullif(F.regexp_extract(text, verdict, 2), F.lit("")).alias("reason"),
        F.ltrim(text).alias("detail"),
        is_error.alias("is_error"),
    )


def log_error_counts(events: DataFrame, key: str = "mailbox") -> DataFrame:
    """Number of log lines that report an error, per mailbox."""
    return events.groupBy(key).agg(F.count_if("is_error").alias("errors"))
