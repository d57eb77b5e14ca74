import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.operators import scans, windows

T0 = dt.datetime(2024, 1, 1)
US = 1_000_000


def times(seed, n, span_seconds, step_us=1):
    """Requests of a key with a third of all rows, several ordinary keys and a null key."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", "d", None])
        at = rng.randrange(0, span_seconds * US, step_us)
        rows.append((key, i, T0 + dt.timedelta(microseconds=at), rng.random() < 0.3))
    return rows


@pytest.fixture(scope="module")
def busy(spark):
    """Ties on purpose: times are whole tenths of a second."""
    rows = times(1, 3000, 400, US // 10)
    return rows, spark.createDataFrame(rows, "key string, id bigint, ts timestamp_ntz, ok boolean").cache()


def by_key(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    return [sorted(g, key=lambda r: (r[2], r[1])) for g in groups.values()]


@pytest.mark.parametrize("block", [7, 60, 100_000])
def test_running_values(busy, block):
    rows, df = busy
    got = {
        r["id"]: r for r in scans.running_values(
            df, ["key"], "ts", "id", marks={"mark": F.col("ok")},
            maxima={"top": F.when(F.col("ok"), F.col("id"))}, block_seconds=block,
        ).collect()
    }
    assert len(got) == len(rows)
    for group in by_key(rows):
        mark = top = None
        for n, (_, i, _, ok) in enumerate(group, 1):
            if ok:
                mark, top = n, max(i, top if top is not None else -1)
            assert (got[i]["position"], got[i]["mark"], got[i]["top"]) == (n, mark, top)


@pytest.mark.parametrize("block", [1, 10, 100_000])
def test_trailing_count(busy, block):
    rows, df = busy
    got = {
        r["id"]: r["trailing"]
        for r in windows.trailing_count(df, seconds=10, block_seconds=block).collect()
    }
    span = dt.timedelta(seconds=10)
    for group in by_key(rows):
        for _, i, at, _ in group:
            assert got[i] == sum(at - span < t <= at for _, _, t, _ in group)


def test_trailing_count_boundary_is_exclusive(spark):
    rows = [(1, 1, T0), (1, 2, T0 + dt.timedelta(seconds=60)), (1, 3, T0 + dt.timedelta(seconds=60))]
    df = spark.createDataFrame(rows, "key int, id int, ts timestamp_ntz")
    got = {r["id"]: r["trailing"] for r in windows.trailing_count(df).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


@pytest.fixture(scope="module")
def burst(spark):
    """One key with most rows inside one microsecond, some inside a second, and quiet times around."""
    rng, rows = random.Random(8), []
    for i in range(6000):
        if i < 3500:
            at = 100 * US
        elif i < 5000:
            at = 100 * US + rng.randrange(US)
        else:
            at = rng.randrange(400) * US
        key = "hot" if i < 5300 else rng.choice(["a", None])
        rows.append((key, i, T0 + dt.timedelta(microseconds=at), rng.random() < 0.02))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key string, id bigint, ts timestamp_ntz, ok boolean").cache()


def test_a_burst_is_cut_into_blocks_of_equal_depth(burst):
    rows, df = burst
    at_us, order = windows.micros(F.col("ts")), F.struct(F.col("ts").alias("at"), F.col("id").alias("tie"))
    cuts = scans.dense_cuts(df, ["key"], at_us, order, rows_per_block=320)
    blocks = scans.with_blocks(df, cuts, at_us, order).where("key = 'hot'")
    sizes = sorted(r["count"] for r in blocks.groupBy("_block").count().collect())
    assert len(sizes) >= 10 and sizes[-1] < 2 * sizes[len(sizes) // 2] and sum(sizes) == 5300
    lows = blocks.groupBy("_block").agg(F.min(order).alias("low"), F.max(order).alias("high")).orderBy("_block").collect()
    assert all(tuple(a["high"]) < tuple(b["low"]) for a, b in zip(lows, lows[1:]))
    assert scans.dense_cuts(df, ["key"], at_us, order).table is None


@pytest.mark.parametrize("depth", [32, 320])
def test_running_values_in_a_burst(burst, depth):
    rows, df = burst
    got = {r["id"]: r for r in scans.running_values(
        df, ["key"], "ts", "id", marks={"mark": F.col("ok")}, maxima={"top": F.when(F.col("ok"), F.col("id"))},
        rows_per_block=depth).collect()}
    assert len(got) == len(rows)
    for group in by_key(rows):
        mark = top = None
        for n, (_, i, _, ok) in enumerate(group, 1):
            if ok:
                mark, top = n, max(i, top if top is not None else -1)
            assert (got[i]["position"], got[i]["mark"], got[i]["top"]) == (n, mark, top)


@pytest.mark.parametrize("depth, seconds", [(32, 1), (64, 10), (640, 300)])
def test_trailing_count_in_a_burst(burst, depth, seconds):
    rows, df = burst
    got = {r["id"]: r["trailing"] for r in windows.trailing_count(df, seconds=seconds, rows_per_block=depth).collect()}
    span = dt.timedelta(seconds=seconds)
    for group in by_key(rows):
        at = np.array([np.datetime64(r[2]) for r in group])
        want = np.searchsorted(at, at, "right") - np.searchsorted(at, at - np.timedelta64(span), "right")
        assert [got[r[1]] for r in group] == want.tolist()


@pytest.mark.parametrize("limit", [3, 400])
def test_rate_limits_in_a_burst(burst, limit):
    rows, df = burst
    got = {mode: {r["id"]: r[-1] for r in windows.rate_limit(df, limit=limit, seconds=30, mode=mode, rows_per_block=160).collect()}
           for mode in ("drop", "delay")}
    for group in by_key(rows):
        admitted, times = [], []
        for _, i, at, _ in group:
            live = [a for a in admitted[-limit:] if at - dt.timedelta(seconds=30) < a]
            assert got["drop"][i] == (len(live) < limit)
            if got["drop"][i]:
                admitted.append(at)
            t = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
            t = max(t, times[-1] if times else t, times[-limit] + 30 * US if len(times) >= limit else t)
            times.append(t)
            assert got["delay"][i] == t


def slow_drop(at, limit, span):
    admitted, flags = [], []
    for t in at:
        flags.append(sum(t - span < a for a in admitted) < limit)
        if flags[-1]:
            admitted.append(t)
    return flags


@pytest.mark.parametrize("limit,seconds,block", [(1, 5, 5), (4, 10, 10), (30, 60, 3600), (200, 60, 60)])
def test_drop_mode(busy, limit, seconds, block):
    rows, df = busy
    got = {
        r["id"]: r["admitted"] for r in windows.rate_limit(
            df, limit=limit, seconds=seconds, mode="drop", block_seconds=block
        ).collect()
    }
    assert len(got) == len(rows)
    for group in by_key(rows):
        want = slow_drop([r[2] for r in group], limit, dt.timedelta(seconds=seconds))
        assert [got[r[1]] for r in group] == want


def test_a_saturated_key_over_many_blocks(spark):
    """A key that is over its limit all the time: rounds grow with the logarithm of its blocks."""
    rng, at, rows = random.Random(5), 0, []
    for i in range(6400):
        at += rng.randrange(US // 5)
        rows.append(("hot", i, T0 + dt.timedelta(microseconds=at)))
    rows += [(f"k{i % 50}", 7000 + i, T0 + dt.timedelta(seconds=rng.randrange(600))) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, id bigint, ts timestamp_ntz")
    got = {r["id"]: r["admitted"] for r in windows.drop_requests(df, limit=7, seconds=10, rows_per_block=200).collect()}
    for group in by_key(rows):
        want = slow_drop([r[2] for r in group], 7, dt.timedelta(seconds=10))
        assert [got[r[1]] for r in group] == want
    us = windows.micros(F.col("ts"))
    hot = df.where("key = 'hot'").withColumn("pos", F.col("id"))
    placed = hot.select(F.struct("key").alias("_episode"), F.floor(F.col("pos") / 200).alias("_chunk"), us.alias("_us"), "id")
    entries, rounds = windows.settle_blocks(placed, "id", 7, 10 * US)
    assert entries.count() == 32 and 1 <= rounds <= 7
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = windows._in_blocks(placed, "id", entries.withColumn("_run", F.col("_chunk")))
        assert dealt.groupBy(F.spark_partition_id()).count().count() >= 6  # the blocks of the one key run in many tasks
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_states_agree_again_after_a_pause(spark):
    """Pauses inside the window's length forget wrong entries, so few rounds are needed."""
    rows = [("e", c, (c * 400 + i) * US // 4 + c * 30 * US, c * 400 + i) for c in range(24) for i in range(400)]
    placed = spark.createDataFrame(rows, "_episode string, _chunk bigint, _us bigint, id bigint")
    entries, rounds = windows.settle_blocks(placed, "id", 5, 20 * US)
    assert rounds == 0 and entries.where(F.size("_entry") > 0).count() == 0
    entries, rounds = windows.settle_blocks(placed, "id", 5, 45 * US)
    assert rounds >= 1 and entries.where(F.size("_entry") > 0).count() > 0
    assert windows.settle_blocks(placed.where("_chunk = 0"), "id", 5, US)[1] == 0


@pytest.mark.parametrize("limit,seconds,block", [(1, 5, 7), (4, 10, 60), (30, 60, 3600)])
def test_delay_mode(busy, limit, seconds, block):
    rows, df = busy
    got = {
        r["id"]: r["admitted_us"] for r in windows.rate_limit(
            df, limit=limit, seconds=seconds, mode="delay", block_seconds=block
        ).collect()
    }
    for group in by_key(rows):
        admitted = []
        for _, i, at, _ in group:
            t = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
            if admitted:
                t = max(t, admitted[-1])
            if len(admitted) >= limit:
                t = max(t, admitted[-limit] + seconds * US)
            admitted.append(t)
            assert got[i] == t


def test_drop_mode_with_large_and_null_numbers_as_keys(spark):
    keys = [2**62 + 1, 2**62 + 2, None]
    rows = [(k, i, T0 + dt.timedelta(seconds=i % 50)) for i, k in enumerate(keys * 100)]
    df = spark.createDataFrame(rows, "key bigint, id bigint, ts timestamp")
    got = {r["id"]: r for r in windows.rate_limit(df, limit=2, seconds=20, mode="drop").collect()}
    for group in by_key(rows):
        want = slow_drop([r[2] for r in group], 2, dt.timedelta(seconds=20))
        assert [got[r[1]]["admitted"] for r in group] == want
        assert all((got[r[1]]["key"], got[r[1]]["ts"]) == (r[0], r[2]) for r in group)


def test_calm_keys_are_admitted(spark):
    rows = [(1, i, T0 + dt.timedelta(seconds=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "key int, id int, ts timestamp_ntz")
    out = windows.rate_limit(df, limit=60, seconds=60, mode="drop").collect()
    assert all(r["admitted"] for r in out) and len(out) == 300


def test_admission_skips_refused_requests():
    at = np.arange(0, 10 * US, 1000)
    latest = []
    flags = windows.admit_in_order(at, latest, 3, US)
    assert flags.tolist() == slow_drop(at.tolist(), 3, US)
    # Cut anywhere, the state carries over.
    latest, parts = [], []
    for piece in np.array_split(at, 7):
        parts += windows.admit_in_order(piece, latest, 3, US).tolist()
    assert parts == flags.tolist()


@pytest.mark.parametrize("max_retries", [1, 3, 20])
def test_retry_outcome(busy, max_retries):
    rows, df = busy
    got = {
        r["id"]: r for r in windows.retry_outcome(
            df, max_retries, key="key", block_seconds=13
        ).collect()
    }
    for group in by_key(rows):
        count = 0
        for _, i, _, ok in group:
            count = 0 if ok else count + 1
            attempt = count
            outcome = "delivered" if ok else "retry"
            if count >= max_retries:
                outcome, count = "failed", 0
            assert (got[i]["attempt"], got[i]["outcome"]) == (attempt, outcome)
            assert got[i]["retry_in"] == (min(5 * 2.0 ** (attempt - 1), 300) if outcome == "retry" else None)


def test_failure_streak(busy):
    rows, df = busy
    log = df.withColumnRenamed("key", "mailbox").withColumn("error", F.concat(F.lit("e"), "id"))
    got = {r["id"]: r for r in windows.failure_streak(log, block_seconds=13).collect()}
    for group in by_key(rows):
        streak, last = 0, None
        for _, i, at, ok in group:
            streak, last = (0, at) if ok else (streak + 1, last)
            want_us = last and (last - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
            assert got[i]["consecutive_failures"] == streak
            assert got[i]["last_error"] == (None if ok else f"e{i}")
            assert got[i]["last_success_us"] == want_us


def test_latest_status_and_first_n(busy):
    rows, df = busy
    status = df.withColumnRenamed("key", "mailbox")
    latest = {r["mailbox"]: r["id"] for r in windows.latest_status(status, "mailbox", "ts", "id").collect()}
    first = defaultdict(list)
    for r in windows.first_n_per_mailbox(status, 5, ts="ts", tie="id").orderBy("rank").collect():
        first[r["mailbox"]].append(r["id"])
    for group in by_key(rows):
        assert latest[group[0][0]] == group[-1][1]
        newest = sorted(group, key=lambda r: (-(r[2] - T0).total_seconds(), r[1]))
        assert first[group[0][0]] == [r[1] for r in newest[:5]]
