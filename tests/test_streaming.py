import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mailsift.operators import scoring, windows
from mailsift.plans import catalog
from mailsift.sources import mail
from mailsift.streaming import keyed, triage

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key bigint, id bigint, ts timestamp, ts_us bigint, ok boolean"


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """Attempts in time order, cut into several files that arrive one by one."""
    rng = random.Random(2)
    path = str(tmp_path_factory.mktemp("attempts"))
    rows, at = [], T0
    for i in range(600):
        at += dt.timedelta(seconds=rng.randint(1, 900))
        us = int((at - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        rows.append((1 if rng.random() < 0.4 else rng.randint(2, 6), i, at, us, rng.random() < 0.3))
    for part in range(4):
        chunk = spark.createDataFrame(rows[part * 150:(part + 1) * 150], SCHEMA)
        chunk.coalesce(1).write.mode("append").parquet(path)
    return path


def run(stream, folder, out="out"):
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/{out}")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_retry_counters_equal_the_batch_form(spark, split, tmp_path):
    query = run(keyed.retry_stream(source(spark, split).drop("ts"), 4), tmp_path)
    assert len(query.recentProgress) >= 4
    got = spark.read.parquet(f"{tmp_path}/out").select("key", "id", "attempt", "outcome")
    want = windows.retry_outcome(spark.read.parquet(split), 4, key="key").select(
        "key", "id", "attempt", "outcome")
    assert sorted(got.collect()) == sorted(want.collect())


def test_retry_counters_survive_a_restart(spark, tmp_path):
    schema = "key bigint, id bigint, ts_us bigint, ok boolean"
    for i in (1, 2, 3):
        spark.createDataFrame([(7, i, i, False)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(keyed.retry_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("id").collect()
    assert [(r["attempt"], r["outcome"]) for r in got] == [(1, "retry"), (2, "retry"), (3, "failed")]


def test_string_keys(spark, tmp_path):
    schema = "key string, id string, ts timestamp, ts_us bigint, ok boolean, fetch_ms bigint"
    rows = [("m-1", "a", T0, 1, False, 1), ("m-1", "b", T0, 2, True, 2)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for name, made in (("retry", keyed.retry_stream(stream.drop("ts"))), ("rate", keyed.rate_limit_stream(stream.drop("ts"), 1))):
        run(made, f"{tmp_path}/{name}")
        assert {(r["key"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/{name}/out").collect()} == {("m-1", "a"), ("m-1", "b")}
    assert dict(keyed.staleness_stream(stream).dtypes)["key"] == "string"


def test_tables_stream_as_one_file_or_many(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartition(4).write.parquet(f"{tmp_path}/many/events.parquet")
    for sf_dir in ("/root/testdata/sf0.001", f"{tmp_path}/many"):
        got = catalog.QUERIES["dedupe_stream"](spark, sf_dir)
        assert got.count() == table.select("user_id", "event_type").distinct().count()


def test_rate_limit_equals_the_batch_form(spark, split, tmp_path):
    run(keyed.rate_limit_stream(source(spark, split).select("key", "id", "ts_us"), 3, 3600), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").select("id", "admitted")
    want = windows.rate_limit(spark.read.parquet(split), limit=3, seconds=3600, mode="drop")
    assert sorted(got.collect()) == sorted(want.select("id", "admitted").collect())
    assert got.where("not admitted").count() > 0


def test_staleness_alerts(spark, tmp_path):
    hour = 3_600_000
    fetches = {1: [0, 0.5, 2.0, 9.0, 20.0], 2: [0, 20.0], 3: [19.9]}
    rows = [(k, T0 + dt.timedelta(hours=h), int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000 + h * hour))
            for k, hs in fetches.items() for h in hs]
    rows.sort(key=lambda r: r[2])
    schema = "key bigint, ts timestamp, fetch_ms bigint"
    for i in range(0, len(rows), 2):
        spark.createDataFrame(rows[i:i + 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(keyed.staleness_stream(stream), tmp_path)
    start = rows[0][2]
    got = sorted(((r[0], (r[1] - start) / hour, r[2]) for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == [
        (1, 0.5, "warning"), (1, 2.0, "critical"), (1, 2.0, "warning"), (1, 9.0, "critical"),
        (1, 9.0, "warning"), (2, 0.0, "critical"), (2, 0.0, "warning"),
    ]


def test_keys_that_never_fetched_are_alerted(spark, tmp_path):
    hour, start = 3_600_000, int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    rows = [(k, T0 + dt.timedelta(hours=h), start + int(h * hour)) for k, h in ((1, 0.5), (2, 3), (9, 4), (1, 20))]
    schema = "key bigint, ts timestamp, fetch_ms bigint"
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    known = spark.createDataFrame([(1, start), (2, start), (3, start), (3, start + hour), (4, start + 19 * hour)], "key bigint, since_ms bigint")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(keyed.staleness_stream(stream, known=known), tmp_path)
    got = {(r[0], None if r[1] is None else (r[1] - start) / hour, r[2]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        (1, 0.5, "warning"), (1, 0.5, "critical"), (2, None, "warning"), (2, 3.0, "warning"), (2, 3.0, "critical"),
        (3, None, "warning"), (3, None, "critical"), (9, 4.0, "warning"), (9, 4.0, "critical"),
    }


def staged_files(spark, root, names):
    rows = [(f"box{i % 2}", "", f"{n}.mail", f"From: {n}@x.org\nSubject: s{n}\n\nbody {n}\n".encode()) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "mailbox string, folder string, name string, content binary")
    mail.land_messages(df, root).collect()


def test_triage_handles_each_message_once(spark, tmp_path):
    root, table = f"{tmp_path}/staging", f"{tmp_path}/table"
    staged_files(spark, root, [f"a{i}" for i in range(8)] + ["amaz0n"])

    def go(checkpoint, first=0):
        stream = mail.read_staging_stream(spark, root, max_files=4)
        triage.triage_stream(stream, table, f"{tmp_path}/{checkpoint}", scoring.rule_scorer,
                             first_batch=first, tasks=2).start().awaitTermination()

    go("c1")
    done = triage.read_dispositions(spark, table)
    assert done.count() == 9 and done.select("batch_id").distinct().count() == 3
    assert [r["from_addr"] for r in done.where("disposition = 'quarantine'").collect()] == ["amaz0n@x.org"]
    staged_files(spark, root, ["late"])
    go("c1")
    assert triage.read_dispositions(spark, table).count() == 10
    go("c2", first=100)
    assert triage.read_dispositions(spark, table).count() == 10


def test_replayed_batch_replaces_itself(spark, tmp_path):
    rows = [("b", f"{i}.mail", f"From: a{i}@x\n\nb".encode()) for i in range(3)] * 20 + [("b", "bad.mail", None)]
    batch = spark.createDataFrame(rows, "mailbox string, name string, content binary")
    for _ in range(2):
        triage.triage_batch(batch, 5, f"{tmp_path}/t")
    rows = triage.read_dispositions(spark, f"{tmp_path}/t").collect()
    assert sorted((r["disposition"], r["reason"]) for r in rows) == [
        ("delivered", "No clear sign of harm")] * 3 + [("failed", "Parse error: no content")]
    triage.triage_batch(batch, 6, f"{tmp_path}/t")
    assert triage.read_dispositions(spark, f"{tmp_path}/t").count() == 4


def test_replay_with_other_verdicts(spark, tmp_path):
    for verdict in ("quarantine", "delivered"):
        rows = spark.createDataFrame([("m1", verdict)], "message_key string, disposition string")
        mail.write_disposition_batch(rows, 5, f"{tmp_path}/t")
    got = triage.read_dispositions(spark, f"{tmp_path}/t").collect()
    assert [(r["message_key"], r["batch_id"], r["disposition"]) for r in got] == [("m1", 5, "delivered")]


def test_disposition_stream_and_dedupe(spark, split, tmp_path):
    rows = source(spark, split).select(
        F.col("key").cast("string").alias("message_key"), F.col("ts").alias("received_at"), F.lit("delivered").alias("disposition"))
    once = triage.dedupe_stream(rows, "30 days")
    mail.disposition_stream(once, f"{tmp_path}/t", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["message_key"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == list("123456")


def test_digest_days_follow_the_local_clock(spark, tmp_path):
    """2024-03-10 has 23 hours in the zone; every message still falls into one day."""
    rows = [(1, "INBOX", dt.datetime(2024, 3, 9, 14, 0) + dt.timedelta(hours=h)) for h in range(0, 100)]
    schema = "mailbox int, folder_label string, received_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    run(triage.digest_window(stream), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("digest_from").collect()
    assert [(r["digest_from"].day, r["messages"]) for r in got] == [(9, 23), (10, 24), (11, 24), (12, 24)]


def test_staged_files_are_listed_in_few_tasks(spark, tmp_path):
    """A batch of many files is a few listing tasks, and the log of a long backlog is seldom written anew."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.unset(name)
    spark.conf.unset(mail.LOG_INTERVAL)
    staged_files(spark, f"{tmp_path}/staging", [f"n{i}" for i in range(6)])
    stream = mail.read_staging_stream(spark, f"{tmp_path}/staging", max_files=500)
    assert int(spark.conf.get(name)) <= max(32, 4 * spark.sparkContext.defaultParallelism)
    assert int(spark.conf.get(mail.LOG_INTERVAL)) == 100
    run(stream.select("mailbox", "name", "size"), tmp_path)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    spark.conf.set(name, "3")
    mail.read_staging_stream(spark, f"{tmp_path}/staging")
    assert spark.conf.get(name) == "3" and spark.conf.get(mail.LOG_INTERVAL) == "100"
    spark.conf.unset(name)
    spark.conf.unset(mail.LOG_INTERVAL)


def test_staleness_state_is_shared_by_groups_of_keys(spark, tmp_path):
    """More keys than groups, keys of any type, a null key and fetches without a time; few calls to the state."""
    hour, start = 3_600_000, int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    hours = ((0, range(40)), (2, range(10)), (20, [0]))
    rows = [(f"box {k}", T0 + dt.timedelta(hours=h), start + h * hour) for h, ks in hours for k in ks]
    rows += [(None, T0, start), ("box 1", None, None), ("odd", None, None)]
    schema = "key string, ts timestamp, fetch_ms bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    calls = spark.sparkContext.accumulator(0)

    class Counted(keyed._Staleness):
        def _write(self, last):
            calls.add(1)
            super()._write(last)

    known = spark.createDataFrame([(f"new {k}", start) for k in range(40)], "key string, since_ms bigint")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    held, keyed._Staleness = keyed._Staleness, Counted
    try:
        run(keyed.staleness_stream(stream, known=known, groups=2), tmp_path)
    finally:
        keyed._Staleness = held
    got = sorted(((r[0], None if r[1] is None else (r[1] - start) // hour, r[2]) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    late = lambda name, h: [(name, h, "critical"), (name, h, "warning")]
    want = [x for k in range(40) for x in late(f"new {k}", None)] + late(None, 0)
    want += [x for k in range(10, 40) for x in late(f"box {k}", 0)] + [(f"box {k}", 0, "warning") for k in range(10)]
    want += [x for k in range(10) for x in late(f"box {k}", 2)]
    assert got == sorted(want, key=str)
    assert 0 < calls.value <= 12


def test_a_batch_without_a_new_message_is_not_parsed(spark, tmp_path, monkeypatch):
    """Its keys settle it; with one new message among them the batch is parsed and only that one is scored."""
    rows = [("b", f"{i}.mail", f"From: a{i}@x\n\nb".encode()) for i in range(5)]
    schema, path = "mailbox string, name string, content binary", f"{tmp_path}/t"
    triage.triage_batch(spark.createDataFrame(rows, schema), 1, path)
    scored = []
    score = triage.score_batch
    monkeypatch.setattr(triage, "score_batch", lambda df, *a, **b: scored.append(df.count()) or score(df, *a, **b))
    triage.triage_batch(spark.createDataFrame([*rows, rows[0]], schema), 2, path)
    assert scored == [] and triage.read_dispositions(spark, path).count() == 5
    assert [c[:2] for c in triage.disposition_table(spark, path).commits()] == [(1, 1), (2, 2)]
    new = ("b", "new.mail", b"From: new@x\n\nb")
    triage.triage_batch(spark.createDataFrame([*rows, new, new], schema), 3, path)
    assert scored == [1] and triage.read_dispositions(spark, path).where("batch_id = 3").first()["from_addr"] == "new@x"
    triage.triage_batch(spark.createDataFrame(rows[:2], schema), 2, path)  # replays find what they found before
    assert triage.read_dispositions(spark, path).groupBy("batch_id").count().collect().__len__() == 2


def test_small_messages_are_few_tasks(spark, tmp_path):
    """Also where the session reads 16 MB in a task: a Python worker starts for hundreds of messages, not for 64."""
    name, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.unset(cost)
    spark.conf.set(name, "16m")
    try:
        staged_files(spark, f"{tmp_path}/staging", [f"n{i}" for i in range(1500)])
        mail.read_staging_stream(spark, f"{tmp_path}/staging")
        files = spark.read.format("binaryFile").load(f"{tmp_path}/staging/*/*.mail")
        assert files.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
    finally:
        spark.conf.set(name, before)
        spark.conf.unset(cost)
