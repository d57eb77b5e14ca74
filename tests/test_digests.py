"""Streamed digests: partial digests merge, days close once, late mail is left out, restarts go on."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailsift.plans import stream_queries
from mailsift.plans.registry import Inputs
from mailsift.session import few_state_partitions, kept
from mailsift.streaming import digests

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("mailbox string, received_at timestamp, message_key string, from_addr string, subject string, "
          "body_preview string, category string, reason string, g0 string, items string")


def mail(seed, n, days):
    draw, rows = random.Random(seed), []
    for i in range(n):
        box = "hot" if draw.random() < 0.5 else draw.choice(["a", "b", None])
        at = T0 + dt.timedelta(hours=days * 24 * i / n, minutes=draw.randrange(60) // 20 * 20)
        rows.append((box, at, f"k{i:05}", f"x{i % 4}@s{i % 3}.example", f"subject {i}", f"text {i}", draw.choice(["Personal", "Business"]), None, "x", "x"))
    return rows


def day_of(at, hour=8):
    """The local day in US/Central, which is UTC-6 here."""
    local = at - dt.timedelta(hours=6 + hour)
    return dt.datetime(local.year, local.month, local.day) + dt.timedelta(hours=hour)


def run(spark, made, rows, folder, parts):
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        made(stream).writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    schema = made(stream).schema
    return spark.read.schema(schema).parquet(f"{folder}/out").collect()


def plain(rows, group, n, closed_before):
    found = {}
    for r in rows:
        found.setdefault((*[r[g] for g in group], day_of(r[1])), []).append(r)
    return {k: (len(v), [x[4] for x in sorted(v, key=lambda r: (-r[1].timestamp(), r[2]))[:n]])
            for k, v in found.items() if k[-1] + dt.timedelta(days=1) <= closed_before}


@pytest.mark.parametrize("parts", [1, 3])
def test_days_equal_a_plain_version(spark, tmp_path, parts):
    """Micro-batches that cut days, a hot mailbox and ties in time; each part is a restart."""
    rows = mail(1, 900, 6)
    found = run(spark, lambda s: digests.newest_per_day(s, ["mailbox"], F.col("subject"), 4), rows, tmp_path, parts)
    mark = max(r[1] for r in rows) - dt.timedelta(hours=7)
    got = {(r["mailbox"], r["digest_from"]): (r["messages"], r["items"]) for r in found}
    assert len(got) == len(found) and got == plain(rows, [0], 4, mark)
    assert all(r["digest_to"] - r["digest_from"] == dt.timedelta(days=1) for r in found)


def test_several_groups_and_names_that_clash(spark, tmp_path):
    rows = mail(2, 300, 4)
    found = run(spark, lambda s: digests.newest_per_day(s, ["mailbox", "category"], F.struct("subject", "message_key"), 2), rows, tmp_path, 1)
    mark = max(r[1] for r in rows) - dt.timedelta(hours=7)
    got = {(r["mailbox"], r["category"], r["digest_from"]): (r["messages"], [i["subject"] for i in r["items"]]) for r in found}
    assert got == plain(rows, [0, 6], 2, mark)


def test_late_mail_does_not_open_a_closed_day(spark, tmp_path):
    rows = mail(3, 200, 4)
    late = [("hot", T0 + dt.timedelta(hours=20), f"late{i}", "a@b", "late", "t", "Personal", None, "x", "x") for i in range(5)]
    end = [("a", T0 + dt.timedelta(days=9), "end", "a@b", "end", "t", "Personal", None, "x", "x")]
    made = lambda s: digests.mail_digest_stream(s, 3)
    run(spark, made, rows, tmp_path, 1)
    run(spark, made, late, tmp_path, 1)
    found = run(spark, made, end, tmp_path, 1)
    keys = [(r["mailbox"], r["digest_from"]) for r in found]
    assert len(keys) == len(set(keys)) and not any("late" in r["digest"] for r in found)
    assert {k: v[0] for k, v in plain(rows, [0], 3, T0 + dt.timedelta(days=8)).items()} == {
        (r["mailbox"], r["digest_from"]): r["messages"] for r in found}


def test_partial_digests_merge_to_one_of_the_same_size():
    draw = random.Random(4)
    rows = pd.DataFrame([(draw.choice(["a", None]), 0, draw.randrange(50), f"k{i}", f"i{i}", 1) for i in range(500)],
                        columns=["g0", "day_ms", "at_us", "tie", "item", "n"])
    whole = digests.reduced(rows, ["g0"], 5)
    parts = [digests.reduced(rows[i::7], ["g0"], 5) for i in range(7)]
    assert all(len(p) <= 10 for p in parts)
    merged = digests.reduced(pd.concat(parts, ignore_index=True), ["g0"], 5)
    for a, b in ((whole, merged),):
        assert a.sort_values(["g0", "at_us", "tie"]).drop(columns="n").values.tolist().__repr__() == b.sort_values(
            ["g0", "at_us", "tie"]).drop(columns="n").values.tolist().__repr__()
    assert merged["n"].sum() == whole["n"].sum() == 500


def test_a_stream_without_rows(spark, tmp_path):
    assert run(spark, lambda s: digests.category_rollup_stream(s, 2), [], tmp_path, 1) == []
    assert run(spark, lambda s: digests.quarantine_summary_stream(s, 2), [], f"{tmp_path}/q", 1) == []


def test_state_is_shared_by_groups_of_a_day(spark, tmp_path, monkeypatch):
    """Far more mailboxes than buckets, a null one and large numbers: few calls to the state, the same digests."""
    draw, big, rows = random.Random(5), 1 << 60, []
    for i in range(600):
        box = None if i % 50 == 0 else big + i % 49
        at = T0 + dt.timedelta(hours=96 * i / 600)
        rows.append((box, at, f"k{i:05}", draw.choice(["a@x.example", None]), f"s{i}"))
    schema = "mailbox bigint, received_at timestamp, message_key string, from_addr string, subject string"
    calls = spark.sparkContext.accumulator(0)

    class Counted(digests._Newest):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(digests, "_Newest", Counted)
    for part in (rows[:350], rows[350:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        made = digests.newest_per_day(stream, ["mailbox", "from_addr"], F.col("subject"), 2, buckets=3)
        made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
            "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(made.schema).parquet(f"{tmp_path}/out").collect()
    assert dict(made.dtypes)["mailbox"] == "bigint"
    got = {(r["mailbox"], r["from_addr"], r["digest_from"]): (r["messages"], r["items"]) for r in found}
    assert len(got) == len(found) and got == plain(rows, [0, 3], 2, rows[-1][1] - dt.timedelta(hours=7))
    assert 0 < calls.value <= 3 * 6 + 3  # three buckets of at most six days, one of them in both parts


def test_a_stream_has_a_state_partition_per_core_at_most(spark, tmp_path):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "50")
    try:
        with few_state_partitions(spark):
            run(spark, lambda s: digests.newest_per_day(s, ["mailbox"], F.col("subject"), 4), mail(1, 50, 2), tmp_path, 1)
        assert spark.conf.get(name) == "50"
        with pytest.raises(ZeroDivisionError), few_state_partitions(spark):
            raise ZeroDivisionError
        assert spark.conf.get(name) == "50"
        spark.conf.set(name, "2")
        with few_state_partitions(spark):
            assert spark.conf.get(name) == "2"
    finally:
        spark.conf.set(name, before)
    parts = [p for p in (tmp_path / "c/state/0").iterdir() if p.name.isdigit()]
    assert len(parts) == max(8, spark.sparkContext.defaultParallelism)


def test_batches_of_documents_join_the_events_that_have_one(spark, tmp_path, monkeypatch):
    """Not the whole table for every batch; events that come twice, and those without a number, count as before."""
    docs = [(i, f"text {i}", "en", "src1", 6) for i in (*range(40), 7, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(
        f"{tmp_path}/documents.parquet")
    events = [(i, T0 + dt.timedelta(minutes=40 * min(i, 99)), i % 3, "view", 1.0, "{}") for i in (*range(500), 9)] + [(None, T0, 1, "view", 1.0, "{}")]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    held = []
    monkeypatch.setattr(stream_queries, "kept", lambda df, label: held.append(kept(df, label)) or held[-1])
    rows = stream_queries._mail_stream(Inputs(spark, str(tmp_path)))
    assert sorted(r[0] for r in held[0].select("event_id").collect()) == sorted((*range(40), 9))
    rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    keys = [int(r[0][1:].split("@")[0]) for r in spark.read.parquet(f"{tmp_path}/out").select("message_key").collect()]
    assert sorted(keys) == sorted((*range(40), 7, 9))
