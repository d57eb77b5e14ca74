"""Running values over the time line of a key, split into blocks.

``Window.partitionBy(key)`` puts a whole key into one task, which fails when one key holds a
third of the data. Here a key's rows are cut into blocks of time. Running values are computed
inside each block, one row per block is carried forward, and both are added up. The carried
table has one short row per key and block; the rows themselves are shuffled once, by
(key, block), and the join back uses that same partitioning.

A block is a cell of fixed length, and where a key has more rows in a cell than fit a task, the
cell is cut into blocks of equal depth. A first pass draws one row in every few thousand by its
hash and takes the quantiles of (time, tie) of each dense cell as cuts, so a burst is cut
wherever it is, also inside one and the same microsecond.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from mailsift.functions.timing import micros
from mailsift.session import kept

SECOND = 1_000_000
BLOCK_SECONDS = 3600
ROWS_PER_BLOCK = 100_000
DRAWN_PER_BLOCK = 32
# Block of rows without a time; they come first.
NO_BLOCK = -(1 << 62)


class Cuts(NamedTuple):
    """Where the dense cells of some key columns are cut: (``_at_cell``, ``_cuts``), or no table."""

    key: list[str]
    table: DataFrame | None


def _block(ts_us: Column, block_seconds: int) -> Column:
    return F.floor(ts_us / F.lit(block_seconds * SECOND)).cast("bigint")


def _micros_of(df: DataFrame, ts: str) -> Column:
    """A time column in microseconds; a bigint column holds them already."""
    return F.col(ts) if df.schema[ts].dataType == T.LongType() else micros(F.col(ts))


def _cell(at_us: Column, block_seconds: int) -> Column:
    return F.coalesce(_block(at_us, block_seconds), F.lit(NO_BLOCK))


def dense_cuts(
    df: DataFrame, key: Sequence[str], at_us: Column, order: Column,
    rows_per_block: int = ROWS_PER_BLOCK, block_seconds: int = BLOCK_SECONDS,
) -> Cuts:
    """First pass over ``df``: cuts of every cell of a key with more than about ``rows_per_block`` rows.

    ``order`` is a struct that puts the rows in a unique order and begins with their time. Draws
    depend on the rows alone, so reruns agree. What is gathered per cell is its drawn rows, one
    in ``rows_per_block / 32``.
    """
    every = max(1, rows_per_block // DRAWN_PER_BLOCK)
    cell = F.struct(*key, _cell(at_us, block_seconds).alias("_cell"))
    drawn = df.select(cell.alias("_at_cell"), order.alias("_order")).where(
        F.pmod(F.xxhash64("_at_cell", "_order"), F.lit(every)) == 0)
    depth = F.array_sort(F.collect_list("_order"))
    cuts = F.filter("_drawn", lambda x, i: (i + 1) % DRAWN_PER_BLOCK == 0)
    table = kept(
        drawn.groupBy("_at_cell").agg(depth.alias("_drawn")).where(F.size("_drawn") >= 2 * DRAWN_PER_BLOCK)
        .select("_at_cell", cuts.alias("_cuts")), "block-cuts")
    return Cuts(list(key), None if table.isEmpty() else table)


def _cuts_before(cuts: Column, value: Column) -> Column:
    """How many of the sorted cuts are not above ``value``, by halving."""
    def step(at, _):
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        right = F.get(cuts, mid) <= value
        return F.when(at["lo"] >= at["hi"], at).otherwise(F.struct(
            F.when(right, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(right, at["hi"]).otherwise(mid).alias("hi")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cuts) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(steps, start, step, lambda at: at["lo"])


def with_blocks(
    df: DataFrame, cuts: Cuts, at_us: Column, order: Column, block_seconds: int = BLOCK_SECONDS
) -> DataFrame:
    """Add ``_block``, which sorts like the rows of a key do.

    The cuts are few and read from a table, so Spark broadcasts them by their size or else
    splits the partition of a dense cell in the join.
    """
    cell = _cell(at_us, block_seconds)
    if cuts.table is None:
        return df.withColumn("_block", cell)
    rows = df.withColumns({"_order": order, "_at_cell": F.struct(*cuts.key, cell.alias("_cell"))})
    place = F.when(F.col("_cuts").isNull(), 0).otherwise(_cuts_before(F.col("_cuts"), F.col("_order")))
    same = rows["_at_cell"].eqNullSafe(cuts.table["_at_cell"])
    return rows.join(cuts.table, same, "left").withColumn("_block", F.struct(rows["_at_cell"]["_cell"].alias("cell"), place.alias("place"))).drop(
        rows["_at_cell"]).drop("_order", "_cuts", "_at_cell")


def running_values(
    df: DataFrame,
    key: Sequence[str],
    ts: str,
    tie: str,
    marks: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    block_seconds: int = BLOCK_SECONDS,
    rows_per_block: int = ROWS_PER_BLOCK,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Add running values in the order (``ts``, ``tie``) within ``key``, current row included.

    position  number of the row, from 1
    marks     position of the latest row where the condition held (null before the first)
    maxima    largest value so far

    ``tie`` must make the order unique. A task gets a block, of about ``rows_per_block`` rows at
    most. ``cuts`` are those of the same rows by ``key``, or by some columns of it, where they
    are known already; otherwise the first pass runs here.
    """
    marks, maxima = dict(marks or {}), dict(maxima or {})
    key, at_us, order = list(key), _micros_of(df, ts), F.struct(F.col(ts).alias("at"), F.col(tie).alias("tie"))
    if cuts is None:
        cuts = dense_cuts(df, key, at_us, order, rows_per_block, block_seconds)
    # As a struct, a key with nulls still matches itself in the join below.
    rows = df.withColumns({f"_{n}": c for n, c in (marks | maxima).items()})
    rows = with_blocks(rows, cuts, at_us, order, block_seconds).select(
        F.struct(*key).alias("_key"), "_block",
        *[c for c in df.columns if c not in key], *[f"_{n}" for n in (*marks, *maxima)],
    )
    in_block = Window.partitionBy("_key", "_block").orderBy(ts, tie)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_pos", F.row_number().over(in_block).cast("bigint"))
    local = local.withColumns(
        {f"_{n}": F.max(F.when(F.col(f"_{n}"), F.col("_pos"))).over(so_far) for n in marks}
        | {f"_{n}": F.max(f"_{n}").over(so_far) for n in maxima}
    )

    # Without marks the totals need no order, so they are counted before anything is shuffled.
    blocks = (local if marks else rows).groupBy("_key", "_block").agg(
        F.count("*").alias("_n"), *[F.max(f"_{n}").alias(f"_{n}") for n in (*marks, *maxima)]
    )
    before = (
        Window.partitionBy("_key").orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carried = blocks.select(
        "_key", "_block", "_off",
        *[F.max(F.col("_off") + F.col(f"_{n}")).over(before).alias(f"_c_{n}") for n in marks],
        *[F.max(f"_{n}").over(before).alias(f"_c_{n}") for n in maxima],
    )
    joined = local.join(carried, ["_key", "_block"])
    out = {"position": F.col("_off") + F.col("_pos")}
    for n in marks:
        out[n] = F.coalesce(F.col("_off") + F.col(f"_{n}"), F.col(f"_c_{n}"))
    for n in maxima:
        out[n] = F.greatest(F.col(f"_{n}"), F.col(f"_c_{n}"))
    return joined.select(
        *[F.col(f"_key.{c}" if c in key else c) for c in df.columns],
        *[v.alias(n) for n, v in out.items()],
    )


def event_cuts(
    df: DataFrame, key: Sequence[str], at_us: Column, tie: str, seconds: int,
    rows_per_block: int = ROWS_PER_BLOCK, block_seconds: int = BLOCK_SECONDS,
) -> Cuts:
    """The cuts of the time line on which each row arrives and, ``seconds`` later, expires."""
    ends = F.array(*[F.struct((at_us + later).alias("at"), F.lit(own).alias("own"), F.col(tie).alias("tie"))
                     for later, own in ((0, True), (seconds * SECOND, False))])
    events = df.select(*key, F.explode(ends).alias("_e"))
    return dense_cuts(events, key, F.col("_e.at"), F.col("_e"), rows_per_block, max(block_seconds, seconds))


def trailing_sum(
    df: DataFrame,
    key: Sequence[str],
    at_us: Column,
    tie: str,
    seconds: int,
    name: str,
    weight: Column | None = None,
    include_peers: bool = True,
    block_seconds: int = BLOCK_SECONDS,
    rows_per_block: int = ROWS_PER_BLOCK,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` (default 1) over the last ``seconds``, lower bound exclusive.

    Each row counts from its own time until ``seconds`` later: +weight when it arrives and
    -weight when it expires, so a running total gives the answer in one ordered pass. (A
    sliding range frame walks the whole frame for every row, quadratic for a busy key.)
    With ``include_peers`` rows with the same time count for each other, otherwise only those
    earlier by ``tie``. ``cuts`` are those of :func:`event_cuts` where they are known already.

    Without dense cells, a row that expires in a later cell is also opened there, so every
    cell is complete by itself and nothing is joined. With them, the total of each block is
    carried forward, and rows at the end of a block also get their peers at the start of the next.
    """
    span, key = seconds * SECOND, list(key)
    block_seconds = max(block_seconds, seconds)
    if cuts is None:
        cuts = event_cuts(df, key, at_us, tie, seconds, rows_per_block, block_seconds)
    rows = df.withColumn("_at", at_us).withColumn(
        "_w", (F.lit(1) if weight is None else weight).cast("bigint")
    )
    here = _block(F.col("_at"), block_seconds)
    there = _block(F.col("_at") + span, block_seconds)

    def event(block: Column, at: Column, delta: Column, own: bool) -> Column:
        return F.struct(
            block.alias("block"), at.alias("at"), delta.alias("delta"), F.lit(own).alias("own")
        )

    opening = event(here, F.col("_at"), F.col("_w"), True)
    closing = event(there, F.col("_at") + span, -F.col("_w"), False)
    events = F.array(opening, closing)
    if cuts.table is None:
        again = event(there, F.col("_at"), F.col("_w"), False)
        events = F.when(here == there, events).otherwise(F.array(opening, again, closing))
    rows = rows.withColumn("_e", F.explode(events)).drop("_at", "_w")
    # Only the row itself carries the other columns through the shuffle.
    own = F.col("_e.own")
    rows = rows.select(
        *[F.col(c) if c in (*key, tie) else F.when(own, F.col(c)).alias(c) for c in df.columns],
        F.col("_e.block").alias("_block"), F.col("_e.at").alias("_at"),
        F.col("_e.delta").alias("_delta"), own.alias("_own"),
    )
    if cuts.table is not None:
        order = F.struct(F.col("_at").alias("at"), F.col("_own").alias("own"), F.col(tie).alias("tie"))
        rows = with_blocks(rows.drop("_block"), cuts, F.col("_at"), order, block_seconds)
    window = Window.partitionBy(*key, "_block")
    if include_peers:
        window = window.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        window = window.orderBy("_at", "_own", tie).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
    rows = rows.withColumn(name, F.sum("_delta").over(window))
    if cuts.table is not None:
        rows = _carried_totals(rows, key, name, include_peers)
    return rows.where("_own").select(*df.columns, name)


def _carried_totals(rows: DataFrame, key: list[str], name: str, include_peers: bool) -> DataFrame:
    """Totals inside blocks to totals of the key."""
    rows = rows.withColumn("_key", F.struct(*key))
    blocks = rows.groupBy("_key", "_block").agg(
        F.sum("_delta").alias("_n"), F.min("_at").alias("_first"), F.max("_at").alias("_last"),
        F.min_by(name, "_at").alias("_head"))
    in_order = Window.partitionBy("_key").orderBy("_block")
    off = F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.lit(0)
    if include_peers:
        # What a run of blocks that begin at one time holds of that time, from each of them on.
        on = Window.partitionBy("_key", "_first").orderBy("_block").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        blocks = blocks.withColumn("_heads", F.sum("_head").over(on))
        peers = F.lead("_first").over(in_order) == F.col("_last")
        later = F.when(peers, F.lead("_heads").over(in_order)).otherwise(0)
    carried = blocks.select("_key", "_block", "_last", off.alias("_off"), later.alias("_later"))
    own = F.col(name) + F.col("_off") + F.when(F.col("_at") == F.col("_last"), F.col("_later")).otherwise(0)
    return rows.join(carried, ["_key", "_block"]).withColumn(name, own)
