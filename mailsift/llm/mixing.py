"""Mixing sources to target weights by the cube method of balanced sampling.

Each source is to give ``target / size`` copies of its documents, at most two: all get the whole
part, and the fraction is the inclusion probability of one copy more. The cube method moves the
vector of fractional probabilities along directions in the null space of the balancing constraints
(the number of documents and of words), so both expected totals hold exactly while at each step at
least one probability becomes 0 or 1. When fewer fractional documents than constraints are left it
cannot go on: that is the landing problem.

The flight runs in blocks of a source, dealt by a hash of the document, so a source may hold any
share of all rows. What each block could not settle (two documents at most) is dealt to larger
blocks of the same source and flown again, level by level, until a source has a single block with
at most two left, which are landed by rounding to the nearest total of words.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.llm.common import n_words, stored

BLOCK_ROWS = 4096
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, top: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` of ``(source, size)`` rows.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all sizes. A
    target stops at ``top`` times its source's size and the excess is shared among the others by
    weight until none is above, so that ``target = min(top * size, level * weight)`` for the level
    at which the targets add up. The windows run over one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    ranked = per_source.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(top))
    # In order of cap / weight: a source is full when the level that fits all before it is above its own.
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    first_open = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("c"), F.col("level").alias("level")))).over(every)
    found = levels.withColumn("final", first_open["level"])
    target = F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap"))
    return found.select("source", "source_size", target.alias("target"))


def fly(p: np.ndarray, size: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """The flight phase for balancing ``sum(p)`` and ``sum(p * size)``; at most two stay fractional."""
    p = p.astype(float).copy()
    active: list[int] = []
    todo = iter(np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist())
    scale = float(size.max()) or 1.0 if len(size) else 1.0
    z = size / scale
    k = 0
    while True:
        while len(active) < 3:
            nxt = next(todo, None)
            if nxt is None:
                return p
            active.append(nxt)
        a, b, c = active
        u = (z[c] - z[b], z[a] - z[c], z[b] - z[a])  # orthogonal to (1, 1, 1) and to the sizes
        if abs(u[0]) < 1e-15 and abs(u[1]) < 1e-15 and abs(u[2]) < 1e-15:
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for i, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, -p[i] / d), min(down, (p[i] - 1) / d)
        step = up if uniform[k % len(uniform)] * (up + down) < down else -down
        k += 1
        rest = []
        for i, d in zip(active, u):
            p[i] += step * d
            if p[i] < EPS:
                p[i] = 0.0
            elif p[i] > 1 - EPS:
                p[i] = 1.0
            else:
                rest.append(i)
        active = rest if len(rest) < 3 else rest[:2]  # cannot be: a step settles one at least


def _fly_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["draw", "at"], kind="stable")
    uniform = (rows["draw"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)) / float(1 << 53)
    rows["p"] = fly(rows["p"].to_numpy(), rows["size"].to_numpy(float), uniform)
    return rows


def _land(rows: pd.DataFrame) -> pd.DataFrame:
    """At most two are left: the choice whose total of words is nearest."""
    rows = rows.sort_values(["draw", "at"], kind="stable")
    p, size = rows["p"].to_numpy(), rows["size"].to_numpy(float)
    open_, want = np.flatnonzero((p > EPS) & (p < 1 - EPS)), float((p * size).sum())
    best = None
    for bits in range(1 << len(open_)):
        trial = p.copy()
        trial[open_] = [bits >> j & 1 for j in range(len(open_))]
        off = abs(float((trial * size).sum()) - want)
        if best is None or off < best[0]:
            best = off, trial
    rows["p"] = best[1] if best else p
    return rows


_ROWS = "at long, source string, size long, draw long, p double"


def cube_sample(units: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(at, pick)`` for units ``(at, source, size, draw, p)``: 1 where the copy is taken."""
    settled: DataFrame | None = None
    level = 0
    while True:
        per_source = stored(units.groupBy("source").agg(F.count("*").alias("n")), f"cube-counts-{level}")
        most = per_source.agg(F.max("n")).first()[0] or 0
        last = most <= block_rows
        dealt = units.join(per_source, units["source"].eqNullSafe(per_source["source"])).select(
            *[units[c] for c in units.columns],
            F.pmod(F.xxhash64("draw", F.lit(level)), F.ceil(F.col("n") / block_rows)).alias("block"),
        )
        flown = stored(
            dealt.groupBy("source", "block").applyInPandas(
                lambda rows: _fly_block(rows.drop(columns="block")), _ROWS), f"cube-flight-{level}")
        is_open = f"p > {EPS} and p < {1 - EPS}"
        done = flown.where(f"not ({is_open})").select("at", F.col("p").cast("long").alias("pick"))
        settled = done if settled is None else settled.unionByName(done)
        units = flown.where(is_open)
        if last:
            landed = units.groupBy("source").applyInPandas(_land, _ROWS)
            return settled.unionByName(landed.select("at", F.col("p").cast("long").alias("pick")))
        level += 1


def numbered(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Add ``number``: 0, 1, 2, ... for the rows of each ``key``.

    Counted within the partition that ``at`` (a monotonically increasing id) tells, and carried from
    partition to partition, so a key that very many rows share is in no task as a whole.
    """
    rows = rows.withColumn("part", F.shiftright(F.col(at), 33))
    counts = rows.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(key).alias("k"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    local = F.row_number().over(Window.partitionBy(key, "part").orderBy(at)) - 1
    counted = rows.withColumn("local", local)
    return counted.join(counts, (F.col(key) == F.col("k")) & (F.col("part") == F.col("p"))).withColumn(
        "number", (F.col("off") + F.col("local")).cast("long")).drop("k", "p", "part", "off", "local")


def _text_hash() -> Column:
    return F.xxhash64("text")


def mix_sources(docs: DataFrame, size: Column | None = None, seed: int = 17, **targets) -> DataFrame:
    """A row per row of ``docs``: ``doc_id _hash _size _source_size _target _copies`` (0, 1 or 2 copies).

    ``size`` is the words of ``text`` unless given; null text has none. Documents of size 0 and of
    sources without words get no copy, unless a source's ratio is whole. The draw depends on
    ``doc_id``, text and ``seed`` alone: reruns agree, and equal rows that repeat are told apart by an
    order that does not change the result as a whole. An empty table gives an empty one.
    """
    size = n_words(F.col("text")) if size is None else size
    narrow = stored(
        docs.select(
            F.col("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"),
            _text_hash().alias("hash"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("draw"),
        ).withColumn("at", F.monotonically_increasing_id()), "mix-draws",
    )
    # Equal rows get draws of their own by their number, which is the same set of draws in every rerun.
    narrow = stored(numbered(narrow, "draw", "at").withColumn("draw", F.xxhash64("draw", "number")).drop("number"), "mix-sizes")
    goals = stored(source_targets(narrow, **targets), "mix-targets")
    joined = narrow.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ratio = F.when(ratio > 2 - 1e-12, 2.0).otherwise(ratio)
    rows = stored(joined.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio)), "mix-rows")
    units = rows.where(f"p > {EPS} and size > 0").select("at", "source", "size", "draw", "p")
    picks = stored(cube_sample(units), "mix-picks")
    return rows.join(picks, "at", "left").select(
        "doc_id", F.col("hash").alias("_hash"), F.col("size").alias("_size"), F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        F.when(F.col("size") > 0, F.col("whole") + F.coalesce("pick", F.lit(0))).otherwise(0).cast("long").alias("_copies"),
    )


def take_mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, a row per copy, with the columns of ``docs``.

    Rows that repeat an id and its text share their copies, which are then copies of one of them.
    """
    key = ["doc_id", "_size", "_hash"]
    shared = stored(
        mix_sources(docs).groupBy(*key).agg(F.sum("_copies").alias("_copies"), F.count("*").alias("_rows"))
        .where("_copies > 0"), "mix-copies",
    ).alias("c")
    marked = docs.select(
        F.struct(*docs.columns).alias("row"), "doc_id", n_words(F.col("text")).alias("_size"), _text_hash().alias("_hash")).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d._size") == F.col("c._size")) & (
        F.col("d._hash") == F.col("c._hash"))
    single = marked.join(shared.where("c._rows = 1"), on).select("d.*", "c._copies")
    twins = marked.join(shared.where("c._rows > 1"), on).select("d.*", "c._copies").dropDuplicates(key)
    copies = F.sequence(F.lit(1), F.col("_copies").cast("int"))
    return single.unionByName(twins).select("row", F.explode(copies).alias("_copy")).select("row.*")
