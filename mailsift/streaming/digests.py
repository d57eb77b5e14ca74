"""Digests over streams: counts and the newest items of every group and day, kept as mergeable state.

A partial digest of a group and day is a count and its ``n`` newest items; two partial ones merge
into one of the same size. Each task reduces its rows of a micro-batch to partial digests, so a
mailbox with a third of all mail sends ``n`` rows per task to the state, which merges them with
what it holds. When the watermark passes the end of a day, the digest is given out and its state
released. No batch reads the mail of another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mailsift.functions.clean import sanitize_prompt
from mailsift.functions.compose import digest_entry
from mailsift.functions.headers import domain_of
from mailsift.functions.timing import micros
from mailsift.operators.digest import ENTRY_SEPARATOR, MAX_ITEMS

DAY_MS = 86_400_000
HELD_ROWS = 50_000


def reduced(rows: pd.DataFrame, group: list[str], n: int) -> pd.DataFrame:
    """Partial digests as rows: the ``n`` newest items of each group, the first with the count."""
    rows = rows.sort_values(["at_us", "tie"], ascending=[False, True], kind="stable")
    groups = rows.groupby([*group, "day_ms"], dropna=False, sort=False)
    counts, place = groups["n"].transform("sum"), groups.cumcount()
    rows = rows.assign(n=counts.where(place == 0, 0))
    return rows[place < n]


def _partial(group: list[str], n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = reduced(batch if held is None else pd.concat([held, batch], ignore_index=True), group, n)
            if len(held) > HELD_ROWS:  # many groups: what is told twice is merged in the state
                yield held
                held = None
        if held is not None:
            yield held

    return run


class _Newest(StatefulProcessor):
    """Digests of a day in groups by hash: one look at the state, and one timer, for all of a group."""

    def __init__(self, group: list[str], n: int):
        self.group, self.n = group, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "digests binary")

    def _read(self, day_ms: int) -> pd.DataFrame:
        return pa.ipc.open_stream(pa.py_buffer(self.held.get()[0])).read_pandas().assign(day_ms=day_ms)

    def _write(self, rows: pd.DataFrame) -> None:
        table = pa.Table.from_pandas(rows[[*self.group, "at_us", "tie", "item", "n"]], preserve_index=False)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as packed:
            packed.write_table(table)
        self.held.update((out.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        day_ms = int(key[0])
        new = pd.concat(list(rows), ignore_index=True)
        if day_ms + DAY_MS <= timerValues.getCurrentWatermarkInMs():
            return  # the digests of that day have been given out
        new = new.assign(day_ms=day_ms)
        if self.held.exists():
            new = pd.concat([new, self._read(day_ms)], ignore_index=True)
        else:
            self.handle.registerTimer(day_ms + DAY_MS)
        self._write(reduced(new, self.group, self.n))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = self._read(int(key[0]))
        self.held.clear()
        first = rows[rows["n"] > 0]  # that of each group has its count
        items = rows.groupby([*self.group, "day_ms"], dropna=False, sort=False)["item"].agg(list)
        told = first[[*self.group, "day_ms"]].assign(messages=first["n"], items=items.to_numpy())
        yield told.reset_index(drop=True)

    def close(self) -> None:
        pass


def newest_per_day(
    stream: DataFrame, group: Sequence[str], item: Column, n: int, hour: int = 8, tz: str = "US/Central",
    delay: str = "1 hour", ts: str = "received_at", tie: str = "message_key", buckets: int = 64,
) -> DataFrame:
    """``group..., digest_from, digest_to, messages, items``: a row per group and closed day.

    Days begin at the local ``hour`` of ``tz``, as in ``digest_window``; the times given out are
    local. ``items`` are the ``n`` newest, newest first, ``item`` of each, which may be a struct.
    Messages of a day that has closed are left out; those without a time have no day.

    A call to the state store costs more than the work on a group, so the state of a day lies in
    ``buckets`` of groups by their hash. A checkpoint holds on to the number it began with.
    """
    types, keys = dict(stream.dtypes), [f"g{i}" for i in range(len(group))]
    timed = stream.where(F.col(ts).isNotNull()).withColumn("_local", F.from_utc_timestamp(F.col(ts), tz)).withWatermark("_local", delay)
    into_day = F.pmod(F.unix_millis("_local") - hour * 3_600_000, F.lit(DAY_MS))
    rows = timed.select(
        *[F.col(c).cast("string").alias(k) for c, k in zip(group, keys)], (F.unix_millis("_local") - into_day).alias("day_ms"),
        micros(F.col(ts)).alias("at_us"), F.col(tie).cast("string").alias("tie"),
        F.to_json(F.struct(item.alias("v"))).alias("item"), F.lit(1).cast("bigint").alias("n"))
    partial = rows.mapInPandas(_partial(keys, n), rows.schema)
    bucket = F.pmod(F.xxhash64("day_ms", *keys), F.lit(buckets)).cast("int").alias("bucket")
    named = "".join(f"{k} string, " for k in keys)
    days = partial.select("*", bucket).groupBy("day_ms", "bucket").transformWithStateInPandas(
        statefulProcessor=_Newest(keys, n),
        outputStructType=f"{named}day_ms bigint, messages bigint, items array<string>",
        outputMode="Append",
        timeMode="EventTime",
    )
    kind = stream.select(item.alias("v")).schema["v"].dataType.simpleString()
    items = F.transform("items", lambda x: F.from_json(x, f"v {kind}")["v"])
    return days.select(
        *[F.col(k).cast(types[c]).alias(c) for c, k in zip(group, keys)], F.timestamp_millis("day_ms").alias("digest_from"),
        F.timestamp_millis(F.col("day_ms") + DAY_MS).alias("digest_to"), "messages", items.alias("items"))


def mail_digest_stream(stream: DataFrame, max_items: int = MAX_ITEMS, **days) -> DataFrame:
    """``mailbox, digest_from, digest_to, messages, items, digest``, the stream form of ``mail_digest``.

    Excerpts are cleaned for the messages that are in the digest. A mailbox without mail on a day
    has no row.
    """
    excerpt = F.struct("from_addr", "subject", "body_preview")
    found = newest_per_day(stream, ["mailbox"], excerpt, max_items, **days)
    entries = F.transform("items", lambda x: digest_entry(x["from_addr"], x["subject"], x["body_preview"]))
    return found.select(
        "mailbox", "digest_from", "digest_to", "messages", F.size("items").cast("bigint").alias("items"),
        F.array_join(entries, ENTRY_SEPARATOR).alias("digest"))


def _cleaned_subjects(found: DataFrame, clean) -> DataFrame:
    return found.withColumn("items", F.transform("items", clean))


def category_rollup_stream(stream: DataFrame, max_items: int, category: str = "category", **days) -> DataFrame:
    """Messages and newest subjects per mailbox, category, sender domain and day."""
    rows = stream.withColumns({"category": F.col(category), "sender_domain": domain_of(F.col("from_addr"))})
    found = newest_per_day(rows, ["mailbox", "category", "sender_domain"], F.col("subject"), max_items, **days)
    return _cleaned_subjects(found, lambda x: sanitize_prompt(x, 100))


def quarantine_summary_stream(stream: DataFrame, max_items: int, **days) -> DataFrame:
    """Blocked messages of each mailbox and day, the newest with subject, sender and reason."""
    found = newest_per_day(stream, ["mailbox"], F.struct("subject", "from_addr", "reason"), max_items, **days)
    return _cleaned_subjects(found, lambda x: F.concat_ws(
        " | ", sanitize_prompt(x["subject"], 100), sanitize_prompt(x["from_addr"], 100), F.coalesce(x["reason"], F.lit(""))))
