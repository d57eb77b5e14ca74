"""Stream operators with durable state per key (RocksDB state store)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mailsift.operators.scans import SECOND
from mailsift.operators.windows import admit_in_order

HOUR_MS = 3_600_000


def _in_time_order(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """This key's rows of one micro-batch; the trigger limits of the source bound their number."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable")


class _Retries(StatefulProcessor):
    def __init__(self, max_retries: int):
        self.max_retries = max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = self.failures.get() if self.failures.exists() else None
        count = int(found[0]) if found else 0
        batch = _in_time_order(rows, "ts_us", "id")
        attempts, outcomes = [], []
        for ok in batch["ok"]:
            count = 0 if ok else count + 1
            attempts.append(count)
            failed = count >= self.max_retries
            outcomes.append("delivered" if ok else "failed" if failed else "retry")
            count = 0 if failed else count
        self.failures.update((count,))
        yield pd.DataFrame(
            {"key": key[0], "id": batch["id"], "attempt": attempts, "outcome": outcomes}
        )

    def close(self) -> None:
        pass


def _types(df: DataFrame, *columns: str) -> str:
    """Columns with the types they have in ``df``, as the start of a schema."""
    types = dict(df.dtypes)
    return ", ".join(f"{c} {types[c]}" for c in columns)


def retry_stream(attempts: DataFrame, max_retries: int = 20) -> DataFrame:
    """Retry counters that survive a restart; ``attempts`` has key, id, ts_us, ok."""
    return attempts.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Retries(max_retries),
        outputStructType=_types(attempts, "key", "id") + ", attempt bigint, outcome string",
        outputMode="Append",
        timeMode="None",
    )


class _RateLimit(StatefulProcessor):
    def __init__(self, limit: int, seconds: int):
        self.limit, self.span = limit, seconds * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("admitted", "at_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = [int(t[0]) for t in self.times.get()] if self.times.exists() else []
        batch = _in_time_order(rows, "ts_us", "id")
        at_us = batch["ts_us"].to_numpy(dtype=np.int64)
        flags = admit_in_order(at_us, latest, self.limit, self.span)
        self.times.put([(t,) for t in latest])
        yield pd.DataFrame({"key": key[0], "id": batch["id"], "admitted": flags})

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int = 30, seconds: int = 60) -> DataFrame:
    """Refuse requests over the limit per key; ``requests`` has key, id, ts_us.

    The state is the last ``limit`` admitted times, however busy the key is.
    """
    return requests.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_RateLimit(limit, seconds),
        outputStructType=_types(requests, "key", "id") + ", admitted boolean",
        outputMode="Append",
        timeMode="None",
    )


class _Staleness(StatefulProcessor):
    """Keys in groups by hash: one look at the state, and one timer, for all keys of a group."""

    LEVELS = ((1 * HOUR_MS, "warning"), (6 * HOUR_MS, "critical"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # By key: since when there was no fetch, alerts sent, and whether that time is one of a fetch.
        self.held = handle.getValueState(
            "last", "names array<string>, since_ms array<bigint>, sent array<int>, fetched array<boolean>")

    def _read(self) -> dict:
        found = self.held.get() if self.held.exists() else None
        return {name: tuple(rest) for name, *rest in zip(*found)} if found else {}

    def _write(self, last: dict) -> None:
        if not last:
            return
        self.held.update((list(last), *map(list, zip(*last.values()))))
        due = [since_ms + self.LEVELS[sent][0] + 1 for since_ms, sent, _ in last.values() if sent < len(self.LEVELS)]
        first = min(due, default=None)
        timers = list(self.handle.listTimers())
        for timer in timers:
            if timer != first:
                self.handle.deleteTimer(timer)
        if first is not None and first not in timers:
            self.handle.registerTimer(first)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Keys that are known before their first fetch."""
        last = self._read()
        for name, since_ms in zip(initialState["name"], initialState["since_ms"]):
            since_ms = int(since_ms)
            if name not in last or since_ms < last[name][0]:
                last[name] = (since_ms, 0, False)
        self._write(last)

    def _passed(self, name, since_ms: int, sent: int, fetched: bool, now_ms: int, out: list[tuple]) -> int:
        """Adds the alerts due at ``now_ms`` that were not sent yet; returns how many are sent."""
        for age, level in self.LEVELS[sent:]:
            if now_ms - since_ms <= age:
                break
            out.append((name, since_ms if fetched else None, level))
            sent += 1
        return sent

    def _told(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            names, ids, levels = zip(*out)
            yield pd.DataFrame({"name": names, "last_fetch_ms": pd.array(ids, "Int64"), "level": levels})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, out = self._read(), []
        batch = _in_time_order(rows, "fetch_ms").dropna(subset=["fetch_ms"])
        for name, at_ms in zip(batch["name"], batch["fetch_ms"].tolist()):
            at_ms = int(at_ms)
            if name not in last:
                last[name] = (at_ms, 0, True)
                continue
            since_ms, sent, fetched = last[name]
            if at_ms > since_ms:
                self._passed(name, since_ms, sent, fetched, at_ms, out)
            if at_ms > since_ms or not fetched:
                last[name] = (max(at_ms, since_ms), 0, True)
        self._write(last)
        yield from self._told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms, last, out = timerValues.getCurrentWatermarkInMs(), self._read(), []
        for name, (since_ms, sent, fetched) in last.items():
            last[name] = (since_ms, self._passed(name, since_ms, sent, fetched, now_ms, out), fetched)
        self._write(last)
        yield from self._told(out)

    def close(self) -> None:
        pass


def staleness_stream(
    fetches: DataFrame, delay: str = "10 minutes", known: DataFrame | None = None, groups: int = 1024
) -> DataFrame:
    """Alert when a key had no successful fetch for one hour, and again after six.

    ``fetches`` has key, ts (timestamp) and fetch_ms, one row per successful fetch. An alert
    names the fetch it follows; it comes with the next fetch or when the watermark passes.

    ``known`` has key and since_ms: keys that are to fetch from that time on. They are the initial
    state of the operator, read when a checkpoint is new, so a key that never fetched is alerted too,
    with a null ``last_fetch_ms``. Of several rows of a key the earliest holds.

    A call to the state store costs more than the work on a key, so the state lies in ``groups`` of
    keys by their hash. A checkpoint holds on to the number it began with.
    """
    def grouped(df: DataFrame) -> DataFrame:
        return df.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")).withColumn(
            "name", F.col("key").cast("string"))

    seeds = None if known is None else grouped(known).select("group", "name", "since_ms").groupBy("group")
    rows = grouped(fetches.withWatermark("ts", delay)).select("group", "name", "ts", "fetch_ms")
    alerts = rows.groupBy("group").transformWithStateInPandas(
        statefulProcessor=_Staleness(),
        outputStructType="name string, last_fetch_ms bigint, level string",
        outputMode="Append",
        timeMode="EventTime",
        initialState=seeds,
    )
    key = F.col("name").cast(dict(fetches.dtypes)["key"]).alias("key")
    return alerts.select(key, "last_fetch_ms", "level")
