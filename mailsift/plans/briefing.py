"""The daily briefing: one row per mailbox with its digest, totals and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift.operators.digest import MAX_ITEMS, folder_totals_wide, mail_digest
from mailsift.operators.filters import recent
from mailsift.operators.health import all_messages, outer_by_mailbox


def daily_briefing(
    messages: DataFrame,
    mailboxes: DataFrame,
    health: DataFrame,
    as_of: Column,
    hours: int = 24,
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """Combine the digest of the last ``hours`` with folder totals and the health roll-up.

    ``messages`` needs the columns of ``mail_digest`` and ``folder_label``; ``health`` is a
    roll-up with status, issues and warnings.
    """
    totals = folder_totals_wide(recent(messages, as_of, hours))
    combined = outer_by_mailbox(
        mail_digest(messages, mailboxes, as_of, max_items, hours),
        totals.select("mailbox", "total", F.col("quarantine").alias("quarantined")),
        health.select("mailbox", "status", all_messages("issues", "warnings").alias("messages")),
    ).where(F.col("digest").isNotNull())
    return combined.fillna({"total": 0, "quarantined": 0})
