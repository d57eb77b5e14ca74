"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A document of more words than a bin holds is cut into full pieces, each a bin of its own, and a
rest. Rests are dealt by hash to blocks of bounded size, so a source or cluster of any share spreads
evenly, and each block is packed by best fit in decreasing size: open bins stand in the order of
their residual, each with a bitmap of the duplicate clusters it holds and one of the sources it may
take no more of. From the first bin with room enough the search goes on through its successors until
one has no conflict; that is the tightest compatible bin. Without one a bin is opened.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.llm.common import WORD, n_words, single_spaced, stored, text_slices, word_spans

CAPACITY = 2048
BLOCK_PIECES = 8192
PER_SOURCE = 4


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """The bin of each item, items taken in the order given; bins are numbered as they are opened.

    No bin exceeds ``capacity``, holds two items of a cluster, or more than ``per_source`` of a source.
    """
    order: list[tuple[int, int]] = []  # (residual, bin) of open bins
    held: list[int] = []  # bitmap of clusters
    full: list[int] = []  # bitmap of sources with no more room
    counts: list[dict[int, int]] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        i = bisect_left(order, (size, -1))
        while i < len(order) and (held[order[i][1]] >> cluster & 1 or full[order[i][1]] >> source & 1):
            i += 1
        if i < len(order):
            residual, bin_ = order.pop(i)
        else:
            residual, bin_ = capacity, len(held)
            held.append(0)
            full.append(0)
            counts.append({})
        held[bin_] |= 1 << cluster
        counts[bin_][source] = counts[bin_].get(source, 0) + 1
        if counts[bin_][source] >= per_source:
            full[bin_] |= 1 << source
        if residual > size:
            insort(order, (residual - size, bin_))
        out.append(bin_)
    return out


def _pack_block(capacity: int, per_source: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "draw", "at"], ascending=[False, True, True], kind="stable")
        sources = pd.factorize(rows["source"], use_na_sentinel=False)[0].tolist()
        clusters = pd.factorize(rows["cluster"], use_na_sentinel=False)[0].tolist()
        bins = best_fit(rows["n"].tolist(), sources, clusters, capacity, per_source)
        return pd.DataFrame({"at": rows["at"], "bin_id": rows["block"] * (1 << 24) + bins})

    return run


def _cluster() -> Column:
    return F.md5(single_spaced(F.col("text")))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE,
                   block_pieces: int = BLOCK_PIECES, cluster: Column | None = None) -> DataFrame:
    """``doc_id piece start n_words bin_id bin_at cluster``, a row per piece of each row of ``docs``.

    ``start`` is the first word of the piece, ``bin_at`` its first word in the bin. A text without
    words (or null) has one piece of no words and a null bin. ``cluster`` is equal for copies that
    must not share a bin; it is a digest of the white-space-normalised text unless given. Null
    sources count as one source. Bins of one number are the same bin.
    """
    cluster = _cluster() if cluster is None else cluster
    narrow = stored(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"), cluster.alias("cluster"),
            n_words(F.col("text")).alias("size"),
        ).withColumn("at", F.monotonically_increasing_id())
        .withColumn("draw", F.xxhash64("doc_id", "cluster", "at")), "pack-sizes",
    )
    full, rest = F.floor(F.col("size") / capacity), F.col("size") % capacity
    rests = narrow.withColumn("n", rest).where("n > 0")
    blocks = max(1, -(-rests.count() // block_pieces))
    packed = rests.withColumn("block", F.pmod("draw", F.lit(blocks))).groupBy("block").applyInPandas(
        _pack_block(capacity, per_source), "at long, bin_id long")
    # Full pieces: bins of their own, numbered below zero one after the other.
    wholes = _numbered(narrow.where(full > 0), full.cast("long")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)))
    of_whole = wholes.select(
        "doc_id", "at", "cluster", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n_words"),
        (-1 - F.coalesce("before", F.lit(0)) - F.col("piece")).alias("bin_id"))
    of_rest = narrow.where((rest > 0) | (F.col("size") == 0)).join(stored(packed, "pack-bins"), "at", "left").select(
        "doc_id", "at", "cluster", full.cast("long").alias("piece"), (full * capacity).cast("long").alias("start"),
        rest.alias("n_words"), "bin_id")
    pieces = of_rest.unionByName(of_whole)
    # A bin holds at most `capacity` words, so this window has a bound.
    in_bin = Window.partitionBy("bin_id").orderBy(F.desc("n_words"), "at", "piece")
    place = F.sum("n_words").over(in_bin.rowsBetween(Window.unboundedPreceding, -1))
    placed = pieces.where("bin_id is not null").withColumn("bin_at", F.coalesce(place, F.lit(0)))
    nowhere = pieces.where("bin_id is null").withColumn("bin_at", F.lit(None).cast("long"))
    return placed.unionByName(nowhere).drop("at")


def _numbered(rows: DataFrame, n: Column) -> DataFrame:
    """Add ``before``: the sum of ``n`` over all rows with a smaller ``at``.

    Sums are taken per input partition, which ``at`` tells, and one number per partition is carried.
    """
    rows = rows.withColumns({"part": F.shiftright("at", 33), "n_": n})
    parts = rows.groupBy("part").agg(F.sum("n_").alias("n"))
    earlier = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.sum("n").over(earlier(Window.orderBy("part"))).alias("off"))
    local = rows.withColumn("local", F.sum("n_").over(earlier(Window.partitionBy("part").orderBy("at"))))
    return local.join(parts, F.col("part") == F.col("p")).withColumn(
        "before", F.coalesce("off", F.lit(0)) + F.coalesce("local", F.lit(0))).drop("part", "n_", "p", "off", "local")


# ---- bins with their texts ------------------------------------------------------------------

_PIECES = "block long, draw long, doc_id long, source string, cluster binary, piece long, n long, text string"
FLUSH_BYTES = 256 << 10


def _cut(blocks: int, capacity: int):
    """(doc_id, source, text, at) to the pieces of each text, dealt to blocks; the text is cut once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources, _, rows_at = (c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns))
            for first, last, data, offsets in text_slices(batch.column(2), FLUSH_BYTES):
                starts, ends, at = word_spans(data, offsets)
                raw, rows = data.tobytes(), []
                for i in range(last - first):
                    words = [raw[a:b] for a, b in zip(starts[at[i] : at[i + 1]].tolist(), ends[at[i] : at[i + 1]].tolist())]
                    cluster = hashlib.md5(b" ".join(words)).digest()
                    told = rows_at[first + i].to_bytes(8) + cluster
                    for piece, begin in enumerate(range(0, len(words), capacity)):
                        own = words[begin : begin + capacity]
                        draw = xxhash.xxh3_64_intdigest(told, seed=piece) >> 1
                        rows.append((draw % blocks, draw, ids[first + i], sources[first + i], cluster, piece, len(own), b" ".join(own).decode()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(zip(*rows), (
                            pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string()))],
                        names=[part.split()[0] for part in _PIECES.split(", ")])

    return run


def _fill(capacity: int, per_source: int):
    """The pieces of a block to its bins."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block = key[0].as_py()
        rows = rows.sort_by([("n", "descending"), ("draw", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        at = {name: rows.column(name).combine_chunks() for name in ("n", "source", "cluster", "doc_id")}
        sources, clusters = (at[c].dictionary_encode("encode").indices.to_pylist() for c in ("source", "cluster"))
        bins = np.array(best_fit(at["n"].to_pylist(), sources, clusters, capacity, per_source), np.int64)
        order = np.argsort(bins, kind="stable")
        ids, n = at["doc_id"].take(order), at["n"].to_numpy()[order]
        cuts = np.flatnonzero(np.diff(bins[order], prepend=-1))
        ends = pa.array(np.append(cuts, len(order)).astype(np.int32))
        texts = pa.ListArray.from_arrays(ends, rows.column("text").combine_chunks().take(order))
        return pa.table({
            "bin_id": pa.array(bins[order][cuts] + (block << 24)), "doc_ids": pa.ListArray.from_arrays(ends, ids),
            "n_words": pa.array(np.add.reduceat(n, cuts)), "text": pc.binary_join(texts, "\n")})

    return run


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, block_pieces: int = 2048) -> DataFrame:
    """``bin_id doc_ids n_words text``: the rows of ``docs`` packed into bins, with their texts.

    The rule is that of :func:`pack_documents`: a bin holds at most ``capacity`` words, no two
    pieces of equal texts and at most ``per_source`` pieces of a source. A piece is its words
    joined by single spaces; pieces are joined by a line break. Each text is cut where it is read and
    each piece moves once, with its text, to the block that packs it; a block is of bounded size,
    as pieces are. Rows that repeat are packed each for itself, and dealt by their place in the
    input, so however many there are they spread. Null sources count as one source. Texts without
    words are in no bin. Pieces of one size are taken in the order of their draw. Other columns
    are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    pieces = own.agg(F.sum(F.ceil(n_words(F.col("text")) / capacity))).first()[0] or 0
    blocks = max(1, -(-int(pieces) // block_pieces))
    own = own.withColumn("at", F.monotonically_increasing_id())
    return own.mapInArrow(_cut(blocks, capacity), _PIECES).groupBy("block").applyInArrow(
        _fill(capacity, per_source), "bin_id long, doc_ids array<long>, n_words long, text string")


def assemble(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """``bin_id doc_ids n_words text``: the bins of ``pack_documents(docs)`` with their texts.

    A piece is its words joined by single spaces; pieces are joined by a line break.
    """
    key = ["doc_id", "cluster"]
    texts = docs.select("doc_id", _cluster().alias("cluster"), "text").dropDuplicates(key).alias("t")
    own = placed.where("bin_id is not null").alias("p")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    piece = F.array_join(F.slice(words, (F.col("start") + 1).cast("int"), F.col("p.n_words").cast("int")), " ")
    rows = own.join(texts, F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.cluster") == F.col("t.cluster"))).select(
        "bin_id", F.struct("bin_at", F.col("p.doc_id").alias("doc_id"), "p.n_words", piece.alias("text")).alias("x"))
    return rows.groupBy("bin_id").agg(F.sort_array(F.collect_list("x")).alias("xs")).select(
        "bin_id", F.transform("xs", lambda x: x["doc_id"]).alias("doc_ids"),
        F.aggregate("xs", F.lit(0).cast("long"), lambda s, x: s + x["n_words"]).alias("n_words"),
        F.array_join(F.transform("xs", lambda x: x["text"]), "\n").alias("text"))
