"""Message archives as a data source, in batch and as a stream."""

import datetime as dt
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from mailsift.sources import archive

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "mailbox string, folder string, name string, received_at timestamp, content binary, size string, file string"


def messages(spark, ids, size=100):
    rows = [(f"box{i % 3}", None if i % 5 == 0 else "cur", f"{i}.mail", T0 + dt.timedelta(minutes=i),
             None if i % 7 == 0 else f"{i}:".encode() + os.urandom(size), "x", "x") for i in ids]
    return spark.createDataFrame(rows, SCHEMA), {r[2]: r[4] or b"" for r in rows}


def contents(df):
    return {r["name"]: bytes(r["content"]) for r in df.collect()}


@pytest.mark.parametrize("block_bytes", [1, 700, 1 << 20])
def test_an_archive_reads_back(spark, tmp_path, block_bytes):
    df, want = messages(spark, range(60))
    archive.write_archive(df.repartition(3), str(tmp_path), 0, block_bytes)
    for part_bytes in (1, 2000, 1 << 30):
        got = archive.read_archive(spark, str(tmp_path), partitionBytes=part_bytes)
        assert got.count() == 60 and contents(got) == want
    rows = {r["name"]: r for r in archive.read_archive(spark, str(tmp_path)).collect()}
    assert rows["4.mail"]["received_at"] == T0 + dt.timedelta(minutes=4) and rows["5.mail"]["folder"] is None
    assert all(r["size"] == len(want[n]) for n, r in rows.items())
    assert archive.read_archive(spark, str(tmp_path), content="false").where("content is not null").count() == 0


def test_partitions_are_even(spark, tmp_path):
    df, _ = messages(spark, range(300), 1000)
    archive.write_archive(df.repartition(5), str(tmp_path), 0, 4000)
    got = archive.read_archive(spark, str(tmp_path), partitionBytes=40_000)
    counts = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert len(counts) >= 7 and counts[-1] <= 2 * counts[len(counts) // 2]


def test_only_late_blocks_are_read(spark, tmp_path):
    df, want = messages(spark, range(200))
    archive.write_archive(df.coalesce(1).sortWithinPartitions("received_at"), str(tmp_path), 0, 900)
    after = int((T0 + dt.timedelta(minutes=150)).replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    got = archive.read_archive(spark, str(tmp_path), modifiedAfterUs=after)
    assert sorted(contents(got)) == sorted(f"{i}.mail" for i in range(150, 200))
    plan = archive._Archive({"path": str(tmp_path), "modifiedAfterUs": str(after)}).blocks(-1, 10)
    assert len(plan) < 0.4 * len(archive._Archive({"path": str(tmp_path)}).blocks(-1, 10))


def test_a_batch_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path)
    assert archive.read_archive(spark, path).count() == 0
    df, want = messages(spark, range(10))
    archive.write_archive(df, path, 0)
    (pathlib.Path(path) / "files" / "left-over.mails").write_bytes(b"half a block")
    other, _ = messages(spark, range(90, 95))
    catalog = archive.catalog_of(spark, path)
    rows = spark.createDataFrame([("never.mails", 0, 10, 1, 0, 0)], archive.CATALOG)
    catalog.write_version(rows, 1)  # a stop before the commit
    assert contents(archive.read_archive(spark, path)) == want
    again, want = messages(spark, range(3))
    archive.write_archive(again, path, 0)
    assert contents(archive.read_archive(spark, path)) == want


def test_a_stream_takes_new_batches_and_goes_on_after_a_restart(spark, tmp_path):
    path, all_of = f"{tmp_path}/a", {}

    def run():
        stream = archive.read_archive_stream(spark, path, partitionBytes=500)
        query = stream.select("name", "content").writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
            "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        return contents(spark.read.schema("name string, content binary").parquet(f"{tmp_path}/out"))

    for batch_id, ids in ((3, range(20)), (4, range(20, 25)), (9, range(25, 40))):
        df, want = messages(spark, ids)
        archive.write_archive(df.repartition(2), path, batch_id, 300)
        all_of |= want
        if batch_id != 3:
            assert run() == all_of
    assert run() == all_of and spark.read.parquet(f"{tmp_path}/out").count() == 40


def test_empty_and_null_rows(spark, tmp_path):
    archive.write_archive(spark.createDataFrame([], SCHEMA), str(tmp_path), 0)
    assert archive.read_archive(spark, str(tmp_path)).count() == 0
    rows = [(None, None, None, None, None, None, None)] * 2
    archive.write_archive(spark.createDataFrame(rows, SCHEMA), str(tmp_path), 1)
    got = archive.read_archive(spark, str(tmp_path)).collect()
    assert [(r["name"], r["received_at"], bytes(r["content"]), r["size"]) for r in got] == [(None, None, b"", 0)] * 2


def test_texts_meet_their_events_once(spark, tmp_path, monkeypatch):
    """All batches of both archives read rows that were stored, not the join again."""
    from mailsift.plans import stream_queries
    from mailsift.plans.registry import Inputs

    folder = f"{tmp_path}/sf0"
    docs = [(i, f"text {i}", "en", "web", 6) for i in range(12)] + [(3, "again", None, "web", 5)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    events = [(i, T0 + dt.timedelta(hours=i), i % 3, "view", 1.0, "{}") for i in range(12)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    plans, write = [], archive.write_archive

    def seen(df, *args, **kw):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        write(df, *args, **kw)

    monkeypatch.setattr(archive, "write_archive", seen)
    assert stream_queries.triage_archive(Inputs(spark, folder)).count() == 13
    assert len(plans) == 7 and not any("Join" in plan for plan in plans)
