"""Daily digests: excerpts, folder totals, categories and the quarantine list.

Lists are only built after ranking has cut each group to the size of the report, so no list
grows with the data; counts cover every message.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mailsift.functions.clean import sanitize_prompt
from mailsift.functions.compose import digest_entry
from mailsift.functions.headers import domain_of
from mailsift.operators.filters import recent
from mailsift.operators.windows import first_n, first_n_per_mailbox

MAX_ITEMS = 50
# Separator between excerpts and the text of an empty digest.
ENTRY_SEPARATOR = "\n---\n"
EMPTY_DIGEST = "No new emails in the last 24 hours."
FOLDER_LABELS = ("INBOX", "SENT", "QUARANTINE", "OTHER")


def _in_order(rank: str, value: str) -> Column:
    ranked = F.array_sort(F.collect_list(F.struct(rank, value)))
    return F.transform(ranked, lambda item: item[value])


def mail_digest(
    messages: DataFrame,
    mailboxes: DataFrame,
    as_of: Column,
    max_items: int = MAX_ITEMS,
    hours: int = 24,
) -> DataFrame:
    """``mailbox, items, digest``: the newest excerpts of each mailbox in one text.

    ``messages`` needs mailbox, received_at, message_key, from_addr, subject, body_preview.
    Excerpts are cleaned after the ranking, for the messages that stay.
    """
    columns = ["mailbox", "received_at", "message_key", "from_addr", "subject", "body_preview"]
    newest = first_n_per_mailbox(recent(messages, as_of, hours).select(*columns), max_items)
    entry = digest_entry(F.col("from_addr"), F.col("subject"), F.col("body_preview"))
    # Mailboxes without mail come in as rows without an entry: no second shuffle for a join.
    rows = newest.select("mailbox", "rank", entry.alias("entry")).unionByName(
        mailboxes.select("mailbox"), allowMissingColumns=True
    )
    grouped = rows.groupBy("mailbox").agg(
        F.count("entry").alias("items"),
        F.array_sort(
            F.collect_list(F.when(F.col("entry").isNotNull(), F.struct("rank", "entry")))
        ).alias("_entries"),
    )
    text = F.array_join(F.transform("_entries", lambda e: e["entry"]), ENTRY_SEPARATOR)
    return grouped.select(
        "mailbox", "items",
        F.when(F.col("items") > 0, text).otherwise(EMPTY_DIGEST).alias("digest"),
    )


def folder_totals(messages: DataFrame, label: str = "folder_label") -> DataFrame:
    """Number of messages per mailbox and folder label."""
    return messages.groupBy("mailbox", label).agg(F.count("*").alias("messages"))


def folder_totals_wide(messages: DataFrame, label: str = "folder_label") -> DataFrame:
    """One row per mailbox with a column per folder label and the total."""
    per_label = [F.count_if(F.col(label) == name).alias(name.lower()) for name in FOLDER_LABELS]
    return messages.groupBy("mailbox").agg(F.count("*").alias("total"), *per_label)


def _counts_and_first(
    df: DataFrame, group: Sequence[str], item: Column, max_items: int
) -> DataFrame:
    """Size of each group and its ``max_items`` newest items.

    Counting aggregates before the shuffle and ranking keeps ``max_items`` rows per task, so
    neither is bound to the size of a hot group.
    """
    counts = df.groupBy(*group).agg(F.count("*").alias("messages"))
    newest_first = [F.col("received_at").desc(), "message_key"]
    items = (
        first_n(df, group, newest_first, max_items, rank="_rank")
        .withColumn("_item", item)
        .groupBy(*group)
        .agg(_in_order("_rank", "_item").alias("items"))
    )
    return counts.join(items, list(group))


def category_rollup(
    messages: DataFrame, max_items: int, category: str = "category"
) -> DataFrame:
    """Messages per mailbox, category and sender domain with the ``max_items`` newest subjects.

    Sections without messages do not appear.
    """
    return _counts_and_first(
        _by_section(messages, category), ("mailbox", "category", "sender_domain"), _subject(), max_items
    )


def category_list(messages: DataFrame, category: str = "category") -> DataFrame:
    """Every message in its section: ``mailbox, category, sender_domain, received_at, message_key, item``."""
    return _by_section(messages, category).withColumn("item", _subject()).drop("subject")


def _subject() -> Column:
    return sanitize_prompt(F.col("subject"), 100)


def _by_section(messages: DataFrame, category: str) -> DataFrame:
    return messages.select(
        "mailbox", F.col(category).alias("category"),
        domain_of(F.col("from_addr")).alias("sender_domain"),
        "received_at", "message_key", "subject",
    )


def quarantine_summary(messages: DataFrame, max_items: int) -> DataFrame:
    """Per mailbox the number of blocked messages and the ``max_items`` newest, with sender and reason.

    ``messages`` are quarantined messages with a ``reason``.
    """
    rows = messages.select(
        "mailbox", "received_at", "message_key", "subject", "from_addr", "reason"
    )
    return _counts_and_first(rows, ("mailbox",), _blocked_item(), max_items)


def quarantine_list(messages: DataFrame) -> DataFrame:
    """Every blocked message: ``mailbox, received_at, message_key, item``."""
    return messages.select("mailbox", "received_at", "message_key", _blocked_item().alias("item"))


def _blocked_item() -> Column:
    return F.concat_ws(
        " | ", _subject(), sanitize_prompt(F.col("from_addr"), 100),
        F.coalesce(F.col("reason"), F.lit("")),
    )
