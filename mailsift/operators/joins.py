"""Keyed combinations of message tables.

No broadcast is forced: Spark broadcasts a side only while its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, where adaptive execution
splits the partitions of a hot key. It only does so where both sides come straight from the
join's own shuffle, so a look-up side that was aggregated by the key is joined on ``_own`` forms
of it: one more shuffle of its few rows, and the hot key of the large side can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift.functions.risk import domain_labels, plain_letters


def _own(key: Column) -> Column:
    """The key as a value that no aggregate has partitioned by."""
    return F.struct(key.alias("k"))


def _join_aggregated(df: DataFrame, side: DataFrame, key: str, how: str) -> DataFrame:
    """Join with a side that has one row per key; null keys match nothing."""
    other = side.where(F.col(key).isNotNull()).withColumnRenamed(key, "_key")
    return df.join(other, _own(df[key]) == _own(other["_key"]), how).drop("_key")


def unprocessed(df: DataFrame, ledger: DataFrame, key: str = "message_key") -> DataFrame:
    """Messages whose key is not in the ledger."""
    return df.join(ledger.select(key), key, "left_anti")


def with_retry_count(
    df: DataFrame, counters: DataFrame, key: str = "message_key", count: str = "retries"
) -> DataFrame:
    """Add the retry counter, 0 where there is none.

    A counter only grows until it is cleared, so of several for one key the largest holds.
    """
    per_key = counters.groupBy(key).agg(F.max(count).alias(count))
    return _join_aggregated(df, per_key, key, "left").withColumn(
        count, F.coalesce(F.col(count), F.lit(0).cast("bigint"))
    )


def audit_landed(
    expected: DataFrame, landed: DataFrame, key: str = "message_key", size: str = "size"
) -> DataFrame:
    """One row per key with ``audit``: ok, missing, size_mismatch or unexpected.

    A union with one grouped aggregate instead of a full outer join: partial aggregation
    collapses repeated keys before the shuffle, so a key with many copies is no hot spot.
    A key is ok only if every copy on both sides has the same size.
    """
    null_size = F.lit(None).cast("bigint")
    both = expected.select(
        key, F.col(size).cast("bigint").alias("_want"), null_size.alias("_have")
    ).unionByName(
        landed.select(key, null_size.alias("_want"), F.col(size).cast("bigint").alias("_have"))
    )
    sizes = both.groupBy(key).agg(
        F.min("_want").alias("_want_min"), F.max("_want").alias("expected_size"),
        F.min("_have").alias("_have_min"), F.max("_have").alias("landed_size"),
    )
    audit = (
        F.when(F.col("landed_size").isNull(), "missing")
        .when(F.col("expected_size").isNull(), "unexpected")
        .when(
            (F.col("_want_min") == F.col("expected_size"))
            & (F.col("_have_min") == F.col("landed_size"))
            & (F.col("expected_size") == F.col("landed_size")),
            "ok",
        )
        .otherwise("size_mismatch")
    )
    return sizes.select(key, "expected_size", "landed_size", audit.alias("audit"))


def purgeable(upstream: DataFrame, audit: DataFrame, key: str = "message_key") -> DataFrame:
    """Upstream messages that have a verified local copy."""
    return _join_aggregated(upstream, audit.where("audit = 'ok'").select(key), key, "left_semi")


def not_purgeable(upstream: DataFrame, audit: DataFrame, key: str = "message_key") -> DataFrame:
    """The complement of :func:`purgeable`: these stay upstream."""
    return _join_aggregated(upstream, audit.where("audit = 'ok'").select(key), key, "left_anti")


def resolve_mailbox(
    df: DataFrame, users: DataFrame, catch_all: str, recipient: str = "recipient"
) -> DataFrame:
    """Mailbox of each recipient; unknown recipients go to the catch-all mailbox.

    ``users`` has columns ``recipient`` and ``mailbox``. A recipient with several mailboxes is an
    alias: the message has one row for each of them. Rows that repeat a pair count once.
    """
    known = users.select(
        F.lower("recipient").alias("_recipient"), F.col("mailbox").alias("_mailbox")
    ).distinct()
    joined = df.join(known, F.lower(F.col(recipient)) == F.col("_recipient"), "left")
    return joined.withColumn(
        "mailbox", F.coalesce(F.col("_mailbox"), F.lit(catch_all))
    ).drop("_recipient", "_mailbox")


def _segment(length: Column, part: Column, k: int) -> tuple[Column, Column]:
    """Start and size of part ``part`` (from 0) of ``k + 1`` nearly equal parts; longer ones come last."""
    size = F.floor(length / F.lit(k + 1)).cast("int")
    short = F.lit(k + 1) - length % F.lit(k + 1)
    return part * size + F.greatest(part - short, F.lit(0)), size + (part >= short).cast("int")


def brand_signatures(brands: DataFrame, k: int) -> DataFrame:
    """``brand`` with ``_of`` (its length, a part's number and the part), a row per part that is not empty.

    A brand of at most ``k`` letters also gets a row that stands for itself.
    """
    parts = brands.select("brand", F.length("brand").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i"))
    start, size = _segment(F.col("n"), F.col("i"), k)
    part = F.substring("brand", start + 1, size)
    of = F.struct(F.col("n").alias("n"), F.col("i").alias("i"), part.alias("part"))
    short = F.struct(F.length("brand").alias("n"), F.lit(-1).alias("i"), F.lit("").alias("part"))
    return parts.where(size > 0).select("brand", of.alias("_of")).unionByName(
        brands.where(F.length("brand") <= k).select("brand", short.alias("_of")))


def word_signatures(words: DataFrame, k: int) -> DataFrame:
    """``_plain`` with every ``_of`` that a brand within ``k`` edits has at least one of.

    ``k`` edits leave one of ``k + 1`` parts as it was, moved by ``k`` places at most. Where a brand
    is so short that parts are empty, a letter of it stays unless the word has ``k`` letters at
    most, too; those words get the row that stands for the short brand itself.
    """
    n = F.length("_plain")
    lengths = F.sequence(F.greatest(n - k, F.lit(0)), n + k)
    tried = (
        words.select("_plain", F.explode(lengths).alias("n"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i"))
        .select("*", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("moved"))
    )
    start, size = _segment(F.col("n"), F.col("i"), k)
    at = start + F.col("moved")
    part = F.substring("_plain", at + 1, size)
    of = F.struct("n", "i", part.alias("part"))
    inside = (size > 0) & (at >= 0) & (at + size <= F.length("_plain"))
    short = F.struct(F.col("n"), F.lit(-1).alias("i"), F.lit("").alias("part"))
    brief = words.where(n <= k).select("_plain", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("n"))
    return tried.where(inside).select("_plain", of.alias("_of")).unionByName(
        brief.select("_plain", short.alias("_of"))).distinct()


def lookalike_domains(
    domains: DataFrame, brands: DataFrame, max_distance: int = 1
) -> DataFrame:
    """Pairs of sender domain and brand that differ in at most ``max_distance`` edits.

    ``domains`` has a column ``domain``, ``brands`` a column ``brand``; both may be large.
    Brands are cut into ``k + 1`` parts; two strings within ``k`` edits share a part of the brand at
    nearly the same place, so an equi-join on length, part and place finds every pair; the
    edit distance then confirms it. The parts of a word are a few dozen, whatever its length.
    Domains are made distinct first: a sender with a third of all mail is one row here. So are the
    labels of a domain and the words near a brand, so the pairs need not be, however many a label
    that all domains have brings; candidates are confirmed before they are made distinct.
    """
    labels = (
        domains.select("domain").distinct()
        .select("domain", F.explode(F.array_distinct(domain_labels(F.col("domain")))).alias("label"))
        .withColumn("_plain", plain_letters(F.col("label")))
    )
    # Words are few bytes but bring many candidates: a task count of its own, which adaptive execution
    # does not lower, keeps them apart. (Dealt by the word itself, the step would be left out.)
    tasks = int(domains.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = labels.select("_plain").distinct().repartition(tasks, F.xxhash64("_plain"))
    names = brands.select("brand").where("brand is not null").distinct()
    distance = F.levenshtein(F.col("_plain"), F.col("brand"), max_distance)
    # Spark's sizes know nothing of how many rows ``explode`` makes: it would take a word for as large as its
    # dozens of signatures and send them all through the driver.
    near = (
        word_signatures(words, max_distance).hint("merge").join(brand_signatures(names, max_distance), "_of")
        .select("_plain", "brand", distance.alias("distance"))
        .where("distance >= 0")
        .distinct()
    )
    return (
        labels.join(near, "_plain")
        .where(F.col("label") != F.col("brand"))
        .select("domain", "label", "brand", "distance")
    )
