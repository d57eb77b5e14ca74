"""Queue counts and the health roll-up: one row per mailbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift.functions.timing import micros
from mailsift.operators.scans import SECOND

# Thresholds (the message texts below are fixed too).
PENDING_WARNING, PENDING_CRITICAL = 10, 50
FAILURES_CRITICAL = 3
STALE_SECONDS, STALE_CRITICAL_SECONDS = 3600, 21600
CREDENTIAL_SECONDS = 7200
LOG_ERRORS_WARNING = 20
STATUS_NAMES = ("healthy", "warning", "critical")


def queue_counts(queue: DataFrame, mailboxes: DataFrame | None = None) -> DataFrame:
    """``staging_count`` and ``failed_count`` per mailbox from (mailbox, state) rows.

    With ``mailboxes`` every mailbox gets a row, zeros included. The zeros come from a union
    before the aggregate, so the queue is shuffled once and already counted per task.
    """
    rows = queue.select("mailbox", "state")
    if mailboxes is not None:
        rows = rows.unionByName(
            mailboxes.select("mailbox", F.lit(None).cast("string").alias("state"))
        )
    return rows.groupBy("mailbox").agg(
        F.count_if(F.col("state") == "pending").alias("staging_count"),
        F.count_if(F.col("state") == "failed").alias("failed_count"),
    )


def outer_by_mailbox(*tables: DataFrame) -> DataFrame:
    """Full outer combination of tables that have one row per mailbox.

    One union and one aggregate on the key replace a chain of outer joins, each of which
    would shuffle again.
    """
    parts = []
    for i, table in enumerate(tables):
        fields = [c for c in table.columns if c != "mailbox"]
        parts.append(table.select("mailbox", F.struct(*fields).alias(f"t{i}")))
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    names = [f"t{i}" for i in range(len(tables))]
    grouped = combined.groupBy("mailbox").agg(*[F.max(n).alias(n) for n in names])
    return grouped.select("mailbox", *[F.col(f"{n}.*") for n in names])


def health_inputs(counts: DataFrame, probe: DataFrame, status: DataFrame) -> DataFrame:
    """Join queue counts, delivery probe and processor status, with defaults where one is absent.

    ``probe`` has ``lmtp_available``; ``status`` the fields of a parsed status report.
    """
    joined = outer_by_mailbox(
        counts.select("mailbox", "staging_count", "failed_count"),
        probe.select("mailbox", "lmtp_available"),
        status.select(
            "mailbox", F.col("is_connected").alias("imap_connected"),
            F.col("consecutive_failures").alias("imap_failures"), "last_error",
            F.col("last_successful_fetch").alias("last_fetch"),
        ),
    )
    return joined.fillna({"staging_count": 0, "failed_count": 0, "imap_failures": 0}).fillna(
        {"lmtp_available": True, "imap_connected": True}
    )


def _checks(as_of: Column, critical_pending: int, warn_pending: int):
    pending, failed = F.col("staging_count"), F.col("failed_count")
    failures = F.col("imap_failures")
    age_us = micros(as_of) - micros(F.col("last_fetch"))
    hours = F.floor(age_us / (3600 * SECOND))
    minutes = F.floor(age_us / (60 * SECOND))
    disconnected = ~F.col("imap_connected")
    stale_critical = age_us > STALE_CRITICAL_SECONDS * SECOND
    issues = [
        (pending > critical_pending,
         F.concat(pending.cast("string"),
                  F.lit(" emails stuck in staging! Mail delivery may be failing."))),
        (failed > 0,
         F.concat(failed.cast("string"),
                  F.lit(" emails failed delivery! Manual review required."))),
        (~F.col("lmtp_available"),
         F.lit("LMTP service unreachable! Email delivery is broken.")),
        (disconnected,
         F.concat(F.lit("Mail fetcher disconnected from upstream! Error: "),
                  F.substring(F.coalesce("last_error", F.lit("Unknown error")), 1, 100))),
        (~disconnected & (failures >= FAILURES_CRITICAL),
         F.concat(F.lit("Mail fetcher has "), failures.cast("string"),
                  F.lit(" consecutive failures! Check upstream IMAP connectivity."))),
        (stale_critical,
         F.concat(F.lit("No emails fetched in "), hours.cast("string"),
                  F.lit(" hours! Mail processor may be stuck."))),
    ]
    warnings = [
        ((pending > warn_pending) & (pending <= critical_pending),
         F.concat(pending.cast("string"), F.lit(" emails in staging queue"))),
        (~stale_critical & (age_us > STALE_SECONDS * SECOND),
         F.concat(F.lit("Last email fetch was "), minutes.cast("string"),
                  F.lit(" minutes ago"))),
    ]
    return issues, warnings


def _messages(checks: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.coalesce(hit, F.lit(False)), text) for hit, text in checks])
    )


def _with_status(df: DataFrame, as_of: Column) -> DataFrame:
    severity = F.when(F.size("issues") > 0, 2).when(F.size("warnings") > 0, 1).otherwise(0)
    status = F.when(severity == 2, STATUS_NAMES[2]).when(severity == 1, STATUS_NAMES[1])
    return df.withColumn("status", status.otherwise(STATUS_NAMES[0])).withColumn(
        "checked_at", as_of
    )


def health_rollup(
    inputs: DataFrame,
    as_of: Column,
    critical_pending: int = PENDING_CRITICAL,
    warn_pending: int = PENDING_WARNING,
) -> DataFrame:
    """Add ``issues``, ``warnings``, ``status`` and ``checked_at`` to :func:`health_inputs`.

    Any issue makes the mailbox critical, otherwise any warning makes it a warning, so a
    later check never lowers the status.
    """
    issues, warnings = _checks(as_of, critical_pending, warn_pending)
    checked = inputs.withColumns({"issues": _messages(issues), "warnings": _messages(warnings)})
    return _with_status(checked, as_of)


def health_rollup_ext(
    inputs: DataFrame,
    credentials: DataFrame,
    log_errors: DataFrame,
    as_of: Column,
    critical_pending: int = PENDING_CRITICAL,
    warn_pending: int = PENDING_WARNING,
) -> DataFrame:
    """The roll-up with two more checks.

    ``credentials`` (mailbox, expires_at): a mailbox without a row lacks its credentials,
    a null ``expires_at`` is a credential without expiry. ``log_errors`` (mailbox, errors)
    counts scanner log lines that report an error.
    """
    present = credentials.select("mailbox", "expires_at", F.lit(True).alias("has_credentials"))
    wide = outer_by_mailbox(
        inputs, present, log_errors.select("mailbox", F.col("errors").alias("log_errors"))
    ).where(F.col("staging_count").isNotNull())
    issues, warnings = _checks(as_of, critical_pending, warn_pending)
    issues.append(
        (F.col("has_credentials").isNull(), F.lit("Credentials missing! AI scanning disabled."))
    )
    warnings.append(
        (micros(F.col("expires_at")) < micros(as_of) + CREDENTIAL_SECONDS * SECOND,
         F.lit("Credentials expiring soon - may need refresh"))
    )
    warnings.append(
        (F.col("log_errors") > LOG_ERRORS_WARNING,
         F.concat(F.col("log_errors").cast("string"),
                  F.lit(" errors in scanner log - review recommended")))
    )
    checked = wide.withColumns({"issues": _messages(issues), "warnings": _messages(warnings)})
    return _with_status(checked, as_of)


def all_messages(issues: Column | str, warnings: Column | str) -> Column:
    """Issues, then warnings, in one list."""
    return F.concat(issues, warnings)
