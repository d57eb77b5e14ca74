"""Windowed operators over attempts, requests and status reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from mailsift.functions.timing import RECONNECT, micros, retry_delay
from mailsift.operators.scans import (
    BLOCK_SECONDS, ROWS_PER_BLOCK, SECOND, dense_cuts, event_cuts, running_values, trailing_sum,
)
from mailsift.session import kept


def trailing_count(
    df: DataFrame,
    key: str = "key",
    ts: str = "ts",
    tie: str = "id",
    seconds: int = 60,
    block_seconds: int = BLOCK_SECONDS,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ``trailing``: requests of the key in the last ``seconds``, lower bound exclusive.

    Select the columns you need first: each request is two or three rows of the shuffle, of
    which one carries its columns.
    """
    return trailing_sum(
        df, [key], micros(F.col(ts)), tie, seconds, "trailing", block_seconds=block_seconds,
        rows_per_block=rows_per_block,
    )


def delay_requests(
    df: DataFrame,
    key: str = "key",
    ts: str = "ts",
    tie: str = "id",
    limit: int = 30,
    seconds: int = 60,
    block_seconds: int = BLOCK_SECONDS,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Rate limit that waits: add ``admitted_us``, the time each request may go ahead.

    The rule ``admit[i] = max(arrive[i], admit[i-1], admit[i-limit] + seconds)`` unrolls to
    ``max over j of (arrive[i - j*limit] + j*seconds)`` because arrivals are sorted. Every
    ``limit``-th request forms a lane, and in a lane that is a running maximum of
    ``arrive - turn*seconds``: an ordinary window, cut into blocks like the others.
    """
    span = seconds * SECOND
    order = F.struct(F.col(ts).alias("at"), F.col(tie).alias("tie"))
    cuts = dense_cuts(df, [key], micros(F.col(ts)), order, rows_per_block, block_seconds)
    rows = running_values(df, [key], ts, tie, block_seconds=block_seconds, cuts=cuts)
    turn = F.floor((F.col("position") - 1) / F.lit(limit)).cast("bigint")
    rows = rows.withColumn("_lane", (F.col("position") - 1) % limit)
    rows = rows.withColumn("_turn_us", turn * span).drop("position")
    rows = running_values(
        rows, [key, "_lane"], ts, tie,
        maxima={"_late": micros(F.col(ts)) - F.col("_turn_us")}, block_seconds=block_seconds, cuts=cuts,
    )
    return rows.withColumn("admitted_us", F.col("_late") + F.col("_turn_us")).select(
        *df.columns, "admitted_us"
    )


def admit_in_order(at_us: np.ndarray, admitted: list[int], limit: int, span: int) -> np.ndarray:
    """Which of the sorted times are admitted; ``admitted`` (the latest ones) is updated.

    While the limit is reached the next request that can pass is found by binary search, so
    the work follows the admitted requests rather than all of them.
    """
    flags = np.zeros(len(at_us), dtype=bool)
    i = 0
    while i < len(at_us):
        if len(admitted) >= limit and at_us[i] < admitted[-limit] + span:
            i += int(np.searchsorted(at_us[i:], admitted[-limit] + span))
            continue
        flags[i] = True
        admitted.append(int(at_us[i]))
        del admitted[:-limit]
        i += 1
    return flags


def drop_requests(
    df: DataFrame,
    key: str = "key",
    ts: str = "ts",
    tie: str = "id",
    limit: int = 30,
    seconds: int = 60,
    block_seconds: int = BLOCK_SECONDS,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Rate limit that refuses: ``key, tie, ts, admitted`` for every request.

    Admitted means that fewer than ``limit`` admitted requests lie in the last ``seconds``.
    Each decision depends on earlier ones, but only where the limit is really reached:

    * a request with at most ``limit`` requests of any kind in its window is admitted, which
      ordinary windows find out;
    * only requests less than ``seconds`` before a contested one matter to it, and a pause of
      ``seconds`` between those separates them into episodes that do not affect each other;
    * an episode of more than ``rows_per_block`` requests is cut into blocks of that many, which
      run at the same time from guessed states; see :func:`settle_blocks`.

    Over a stream, ``rate_limit_stream`` does the same bit by bit. Every request needs a time.
    """
    rows = df.select(key, tie, micros(F.col(ts)).alias("_us"))
    order = F.struct(F.col("_us").alias("at"), F.col(tie).alias("tie"))
    cuts = dense_cuts(rows, [key], F.col("_us"), order, rows_per_block, block_seconds)
    forth, back = (event_cuts(rows, [key], at, tie, seconds, rows_per_block, block_seconds)
                   for at in (F.col("_us"), -F.col("_us")))
    rows = trailing_sum(
        rows, [key], F.col("_us"), tie, seconds, "_load", block_seconds=block_seconds, cuts=forth
    )
    contested = (F.col("_load") > limit).cast("int")
    rows = trailing_sum(
        rows, [key], -F.col("_us"), tie, seconds, "_ahead", weight=contested,
        block_seconds=block_seconds, cuts=back,
    )
    rows = rows.select(key, tie, "_us", (F.col("_ahead") > 0).alias("_involved"))
    rows = trailing_sum(
        rows, [key], F.col("_us"), tie, seconds, "_before",
        weight=F.col("_involved").cast("int"), include_peers=False, block_seconds=block_seconds,
        cuts=forth,
    )
    opens = F.col("_involved") & (F.col("_before") == 1)
    rows = running_values(
        rows.select(key, tie, "_us", "_involved", opens.alias("_opens")),
        [key], "_us", tie, marks={"_first": F.col("_opens")}, block_seconds=block_seconds, cuts=cuts,
    )
    chunk = F.floor((F.col("position") - F.col("_first")) / F.lit(rows_per_block))
    placed = kept(rows.select(
        F.struct(F.col(key).alias("key"), "_first").alias("_episode"), chunk.alias("_chunk"),
        key, tie, "_us", "_involved"), "requests")
    schema = T.StructType(
        [*placed.select(key, tie, "_us").schema.fields, T.StructField("admitted", T.BooleanType())])
    involved, span = placed.where("_involved").drop("_involved"), seconds * SECOND
    entries, _ = settle_blocks(involved, tie, limit, span)
    flags = _in_blocks(involved, tie, entries.withColumn("_run", F.col("_chunk")), key).mapInArrow(
        _flags(key, tie, limit, span), schema)
    free = placed.where("not _involved").select(key, tie, "_us", F.lit(True).alias("admitted"))
    return free.unionByName(flags).select(
        key, tie, F.timestamp_micros("_us").cast(df.schema[ts].dataType).alias(ts), "admitted"
    )


def _in_blocks(rows: DataFrame, tie: str, blocks: DataFrame, *keep: str) -> DataFrame:
    """Rows of ``blocks`` in the order of episode, run, chunk and time, each run in one task.

    The first row of a block has no time: it carries ``_node``, ``_from`` (the block's first time)
    and ``_entry`` (the state to start from; null to go on from the block before in the run).
    """
    place = ["_episode", "_run", "_chunk"]
    body = rows.join(blocks.select(*place), ["_episode", "_chunk"]).select(*place, "_us", tie, *keep)
    return body.unionByName(
        blocks.select(*place, "_node", "_from", "_entry"), allowMissingColumns=True
    ).repartition("_episode", "_run").sortWithinPartitions(*place, "_us", tie)


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, int]]:
    """``(row of a block's first row, or None, start, end)`` of the requests of each block."""
    heads = np.flatnonzero(batch.column("_us").is_null().to_numpy(zero_copy_only=False)).tolist()
    if not heads or heads[0] > 0:
        yield None, 0, heads[0] if heads else batch.num_rows
    for head, end in zip(heads, [*heads[1:], batch.num_rows]):
        yield head, head + 1, end


def _start(batch: pa.RecordBatch, head: int, latest: list[int], span: int) -> list[int]:
    """The state at the start of a block: the given one, or what still counts of the last."""
    entry = batch.column("_entry")[head].as_py()
    if entry is not None:
        return entry
    first = batch.column("_from")[head].as_py()
    return [t for t in latest if t > first - span]


def _flags(key: str, tie: str, limit: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latest: list[int] = []
        for batch in batches:
            at_us, requests, flags = batch.column("_us"), [], []
            for head, start, end in _segments(batch):
                if head is not None:
                    latest = _start(batch, head, latest, span)
                requests.append(np.arange(start, end))
                flags.append(admit_in_order(at_us.slice(start, end - start).to_numpy(), latest, limit, span))
            rows = pa.array(np.concatenate(requests))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(rows) for c in (key, tie, "_us")], pa.array(np.concatenate(flags))],
                names=[key, tie, "_us", "admitted"])

    return run


def _exits(limit: int, span: int):
    """The state that each block was entered with and the one it leaves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, entry, latest = None, [], []

        def told(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                names=["_node", "_used", "_exit"])

        for batch in batches:
            at_us, done = batch.column("_us"), []
            for head, start, end in _segments(batch):
                if head is not None:
                    if node is not None:
                        done.append((node, entry, list(latest)))
                    latest = _start(batch, head, latest, span)
                    node, entry = batch.column("_node")[head].as_py(), list(latest)
                admit_in_order(at_us.slice(start, end - start).to_numpy(), latest, limit, span)
            if done:
                yield told(done)
        if node is not None:
            yield told([(node, entry, list(latest))])

    return run


def settle_blocks(rows: DataFrame, tie: str, limit: int, span: int) -> tuple[DataFrame, int]:
    """The true entry state of every block, and in how many rounds it was found.

    All blocks of long episodes run at the same time, as if nothing came before them. Then
    each block's entry is compared with what the block before it left (of that, what is still
    inside the window), and those that were entered wrongly run again, until none was. In
    round ``r`` up to ``2 ** r`` blocks in a row run one after the other in one task, so a key
    that is over its limit without a pause, where a wrong entry is never forgotten, takes a
    number of rounds that grows with the logarithm of its blocks; its chain of decisions is
    sequential by nature, and the last of those rounds walks all of it. Where the limit is not
    reached for a moment, states agree again and one or two rounds are enough. The result has
    ``_episode, _chunk, _node, _from, _entry``.
    """
    blocks = kept(
        rows.groupBy("_episode", "_chunk").agg(F.min("_us").alias("_from"))
        .withColumn("_node", F.monotonically_increasing_id()), "request-blocks")
    nothing = F.array().cast("array<bigint>")
    long = blocks.where("_chunk > 0").select("_episode").distinct()
    entered = blocks.join(long, "_episode").withColumns({"_entry": nothing, "_run": F.col("_chunk")})
    if entered.isEmpty():
        return blocks.withColumn("_entry", nothing), 0

    def walked(todo: DataFrame, number: int) -> DataFrame:
        return kept(
            _in_blocks(rows, tie, todo).mapInArrow(_exits(limit, span), "_node bigint, _used array<bigint>, _exit array<bigint>"),
            f"request-states-{number}")

    states = walked(entered, 0)
    in_order, rounds = Window.partitionBy("_episode").orderBy("_chunk"), 0
    while True:
        live = F.filter(F.lag("_exit").over(in_order), lambda t: t > F.col("_from") - span)
        told = blocks.join(states, "_node").withColumn("_entry", F.coalesce(live, nothing))
        told = kept(told.withColumn("_wrong", F.col("_entry") != F.col("_used")), f"request-entries-{rounds}")
        if told.where("_wrong").isEmpty():
            known = told.select("_node", "_entry")
            return blocks.join(known, "_node", "left").withColumn("_entry", F.coalesce("_entry", nothing)), rounds
        rounds += 1
        run = told.withColumn("_run", F.floor(F.col("_chunk") / F.lit(1 << rounds)))
        first = F.min(F.when(F.col("_wrong"), F.col("_chunk"))).over(Window.partitionBy("_episode", "_run"))
        todo = run.withColumn("_first_wrong", first).where("_chunk >= _first_wrong").withColumn(
            "_entry", F.when(F.col("_chunk") == F.col("_first_wrong"), F.col("_entry")))
        todo = kept(todo.select("_episode", "_chunk", "_run", "_node", "_from", "_entry"), f"request-turns-{rounds}")
        again = walked(todo, rounds)
        states = kept(states.join(again.select("_node"), "_node", "left_anti").unionByName(again), f"request-known-{rounds}")


def rate_limit(
    df: DataFrame,
    key: str = "key",
    ts: str = "ts",
    tie: str = "id",
    limit: int = 30,
    seconds: int = 60,
    mode: str = "delay",
    block_seconds: int = BLOCK_SECONDS,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Apply a rate limit per key; see :func:`delay_requests` and :func:`drop_requests`."""
    if mode not in ("delay", "drop"):
        raise ValueError(f"unknown mode: {mode}")
    apply = delay_requests if mode == "delay" else drop_requests
    return apply(df, key, ts, tie, limit, seconds, block_seconds, rows_per_block)


def retry_outcome(
    df: DataFrame,
    max_retries: int = 20,
    key: str = "message_key",
    ts: str = "ts",
    tie: str = "id",
    success: str = "ok",
    delay: tuple[float, float] = RECONNECT,
    block_seconds: int = BLOCK_SECONDS,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Number each delivery attempt and decide what follows.

    ``attempt`` counts failures since the last success (0 on a success). The failure that
    reaches ``max_retries`` is ``failed`` and restarts the count, an earlier one is ``retry``
    and gets ``retry_in`` seconds of backoff, to be tried again at ``next_attempt_us``.
    """
    rows = running_values(
        df, [key], ts, tie, marks={"_reset": F.col(success)}, block_seconds=block_seconds,
        rows_per_block=rows_per_block,
    )
    failures = F.col("position") - F.coalesce(F.col("_reset"), F.lit(0))
    attempt = F.when(F.col(success), 0).otherwise((failures - 1) % max_retries + 1)
    rows = rows.withColumn("attempt", attempt.cast("bigint"))
    outcome = (
        F.when(F.col(success), "delivered")
        .when(F.col("attempt") >= max_retries, "failed")
        .otherwise("retry")
    )
    rows = rows.withColumn("outcome", outcome)
    retry_in = F.when(F.col("outcome") == "retry", retry_delay(F.col("attempt"), *delay))
    next_us = micros(F.col(ts)) + (F.col("retry_in") * SECOND).cast("bigint")
    return rows.withColumn("retry_in", retry_in).select(
        *df.columns, "attempt", "outcome", "retry_in", next_us.alias("next_attempt_us")
    )


def failure_streak(
    df: DataFrame,
    key: str = "mailbox",
    ts: str = "ts",
    tie: str = "id",
    success: str = "ok",
    error: str = "error",
    block_seconds: int = BLOCK_SECONDS,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """State of the fetcher after every poll.

    ``consecutive_failures`` since the last success, ``last_error`` while failing, and
    ``last_success_us``, the time of the latest success.
    """
    rows = running_values(
        df, [key], ts, tie,
        marks={"_reset": F.col(success)},
        maxima={"last_success_us": F.when(F.col(success), micros(F.col(ts)))},
        block_seconds=block_seconds, rows_per_block=rows_per_block,
    )
    streak = F.col("position") - F.coalesce(F.col("_reset"), F.lit(0))
    last_error = F.when(~F.col(success), F.col(error))
    return rows.select(
        *df.columns,
        streak.alias("consecutive_failures"), last_error.alias("last_error"), "last_success_us",
    )


def latest_status(df: DataFrame, key: str = "mailbox", ts: str = "updated_at", *tie: str) -> DataFrame:
    """Last report per key. ``max_by`` aggregates before the shuffle, one row per task and key."""
    fields = [c for c in df.columns if c != key]
    latest = F.max_by(F.struct(*fields), F.struct(ts, *tie))
    return df.groupBy(key).agg(latest.alias("_latest")).select(key, "_latest.*")


def first_n(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank",
    task_groups: int = 32,
) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``, chosen in two levels.

    Each task keeps ``n`` rows of a group, but with very many tasks those of a hot group would
    still meet in one. So they meet by group and group of tasks first, where again ``n`` are kept:
    the last level gets ``n * task_groups`` rows of a group at most, whatever the input.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(task_groups)))
    for keys in ((*group, "_salt"), group):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        salted = salted.withColumn(rank, place).where(F.col(rank) <= n)
    return salted.drop("_salt")


def first_n_per_mailbox(
    df: DataFrame, n: int = 50, mailbox: str = "mailbox", ts: str = "received_at",
    tie: str = "message_key",
) -> DataFrame:
    """The ``n`` newest messages of each mailbox with their ``rank``; see :func:`first_n`."""
    return first_n(df, [mailbox], [F.col(ts).desc(), F.col(tie)], n)
