"""Physical plans: what must and must not be in them when no side is small enough to broadcast."""

import pytest

from pyspark.sql import Window, functions as F

import __spark_entry__ as entry
from mailsift.operators import joins, windows
from mailsift.plans import catalog

SF = "/root/testdata/sf0.001"
STREAMS = {
    "read_mail_folders", "land_messages", "read_staging_stream", "triage_stream", "dedupe_stream",
    "retry_stream", "rate_limit_stream", "staleness_stream", "digest_window", "write_dispositions", "replayed_batch",
    "ledger", "seen_index", "compacted_batches", "staleness_of_known_mailboxes",
    "read_mail_archive", "read_archive_stream", "triage_archive", "replayed_ledger", "mail_digest_stream", "category_rollup_stream", "quarantine_summary_stream",
}
PYTHON = {"decode_encoded_words", "parse_messages", "score_messages", "rate_limit_drop"}


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - STREAMS))
def test_no_cross_join_and_python_only_where_needed(no_broadcast, name):
    text = plan(no_broadcast, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert any(mark in text for mark in ("Python", "InPandas", "InArrow")) == (name in PYTHON)


SKEWED = {
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
}


def test_a_hot_key_is_split_in_every_keyed_join(no_broadcast):
    spark = no_broadcast
    for key, value in SKEWED.items():
        spark.conf.set(key, value)
    hot = F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.col("id").cast("string"))
    mail = spark.range(0, 120_000, 1, 8).select("id", hot.alias("message_key"), hot.alias("recipient"))
    side = spark.range(0, 2_000, 1, 4).select(F.col("id").cast("string").alias("message_key"), F.lit("ok").alias("audit"))
    some = side.groupBy("message_key").agg(F.max("audit").alias("audit"), F.count("*").alias("retries"))
    users = some.select(F.col("message_key").alias("recipient"), F.col("audit").alias("mailbox"))
    made = {
        "unprocessed": joins.unprocessed(mail, side), "with_retry_count": joins.with_retry_count(mail, some),
        "purgeable": joins.purgeable(mail, some), "not_purgeable": joins.not_purgeable(mail, some),
        "resolve_mailbox": joins.resolve_mailbox(mail, users, "rest"),
    }
    try:
        for name, df in made.items():
            df.collect()
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString(), name
    finally:
        for key in SKEWED:
            spark.conf.unset(key)


def test_top_n_is_cut_before_the_shuffle(no_broadcast):
    for name in ("first_n_per_mailbox", "mail_digest", "category_rollup", "quarantine_summary"):
        assert "WindowGroupLimit" in plan(no_broadcast, name).rpartition("Exchange")[2] or (
            plan(no_broadcast, name).count("WindowGroupLimit") >= 2)


def test_top_n_is_chosen_in_two_levels(no_broadcast):
    """Before and after the exchange by mailbox and group of tasks, then again by mailbox."""
    text = plan(no_broadcast, "first_n_per_mailbox")
    assert text.count("WindowGroupLimit") == 4 and text.count("Exchange hashpartitioning(mailbox") == 2
    assert "Exchange hashpartitioning(mailbox#" in text and "_salt#" in text.partition("Exchange hashpartitioning")[2]


def test_first_n_equals_one_window(spark):
    rows = spark.range(0, 5000, 1, 40).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("v"), "id")
    found = windows.first_n(rows, ["g"], [F.col("v").desc()], 7, task_groups=5)
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc()))
    want = rows.withColumn("rank", place).where("rank <= 7")
    assert sorted(found.collect()) == sorted(want.select(*found.columns).collect())


def test_running_values_shuffle_rows_once(no_broadcast):
    text = plan(no_broadcast, "retry_outcome")
    # Rows, the narrow copy for the block totals, totals by key, totals back by key and block.
    assert text.count("Exchange hashpartitioning") == 4
    assert text.count("hashpartitioning(_key") == 4


def test_no_window_over_a_whole_key(no_broadcast):
    for name in ("trailing_count", "rate_limit_delay", "rate_limit_drop", "retry_outcome", "failure_streak"):
        for line in plan(no_broadcast, name).splitlines():
            if "+- Window [" in line and "_n#" not in line and "_off#" not in line and "_c_" not in line:
                assert "_block#" in line.partition("windowspecdefinition(")[2].partition(" ASC")[0]


def test_scans_read_only_what_is_used(no_broadcast):
    text = plan(no_broadcast, "trailing_count")
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in text
    assert "text" not in plan(no_broadcast, "folder_label").partition("ReadSchema")[2].partition("events.parquet")[0]
