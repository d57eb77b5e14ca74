"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes has eleven zero bits, so equal passages are
cut alike wherever they stand. Chunks get identifiers that are verified on their content: the
64-bit hash of a chunk, and where two contents share a hash, their rank among the contents of that
hash. A text is then its recipe, the ordered list of chunk identifiers, and two texts are equal if
and only if their recipes are. Only recipes are grouped and joined: the text itself moves once, as
distinct chunks, for the verification.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from mailsift.llm.common import single_spaced, split_by_bitmap, stored, text_slices

MEAN_BITS = 11  # a cut every 2 KiB on average
SMALLEST, LARGEST = 256, 32_768
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def _cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: hashes of the last 32 bytes, by doubling windows."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            longer = h.copy()
            longer[step:] += h[:-step] << np.uint32(step)
            h = longer
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def cut_text(start: int, end: int, points: np.ndarray) -> list[tuple[int, int]]:
    """Chunks of one text. Windows that reach before its start do not count."""
    out, at = [], start
    i = int(np.searchsorted(points, start + 32))
    while at < end:
        i = max(i, int(np.searchsorted(points, at + SMALLEST)))
        stop = min(int(points[i]) if i < len(points) else end, end)
        stop = min(stop, at + LARGEST)
        out.append((at, stop))
        at = stop
    return out


def _chunk_hash(piece: bytes, bits: int) -> int:
    h = xxhash.xxh3_64_intdigest(piece) & ((1 << bits) - 1)
    return h - (1 << 64) if h >= 1 << 63 else h


def recipe_batches(bits: int, with_chunks: bool):
    """Batches of (row, text) to (row, text_sha256, recipe), or to the chunks (hash, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, told = batch.column(0), set()
            for first, last, data, offsets in text_slices(batch.column(1)):
                points, raw = _cut_points(data), memoryview(data)
                hashes, digests, counts, chunks = [], [], [], []
                for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    pieces = cut_text(start, end, points)
                    own = [_chunk_hash(raw[a:b], bits) for a, b in pieces]
                    if with_chunks:
                        for h, (a, b) in zip(own, pieces):
                            piece = bytes(raw[a:b])
                            if (h, piece) not in told:
                                told.add((h, piece))
                                hashes.append(h)
                                chunks.append(piece)
                    else:
                        hashes += own
                        counts.append(len(own))
                        digests.append(hashlib.sha256(raw[start:end]).hexdigest())
                if with_chunks:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes, pa.int64()), pa.array(chunks, pa.binary())], names=["hash", "chunk"]
                    )
                else:
                    at = np.zeros(len(counts) + 1, np.int32)
                    np.cumsum(counts, out=at[1:])
                    recipe = pa.ListArray.from_arrays(pa.array(at), pa.array(hashes, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [rows.slice(first, last - first), pa.array(digests, pa.string()), recipe],
                        names=["row", "text_sha256", "recipe"],
                    )

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)``, a row per input row.

    Texts are equal when identical after each run of ASCII white space is replaced by one space;
    null counts as empty. Of equal texts the row with the smallest id stays (a null id is larger
    than any); of rows equal in that too, one. ``keep_id`` is its id. Other columns are ignored.
    ``bits`` is the width of the chunk hash; every width gives the same result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("row"), single_spaced(F.col(text_col)).alias("text"))
    recipes = stored(
        own.mapInArrow(recipe_batches(bits, False), "row long, text_sha256 string, recipe array<long>")
        .withColumn("at", F.monotonically_increasing_id()), "recipes",
    )
    contents = (
        own.mapInArrow(recipe_batches(bits, True), "hash long, chunk binary")
        .dropDuplicates(["hash", "chunk"])
    )
    by_hash = Window.partitionBy("hash").orderBy("chunk")
    shared = stored(contents.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "shared-hashes")
    recipes = recipes.withColumn("recipe", F.transform("recipe", lambda h: F.struct(h.alias("h"), F.lit(0).alias("rank")))) \
        if shared.isEmpty() else _ranked(own, recipes, stored(
            contents.join(shared, "hash").withColumn("rank", F.row_number().over(by_hash)), "ranked-chunks"), bits)
    order = F.struct(F.col("row").isNull().alias("nameless"), F.col("row").alias("id"), F.col("at").alias("at"))
    groups = stored(
        recipes.groupBy("recipe").agg(F.min(order).alias("keep"), F.count("*").alias("group_size"))
        .where("group_size > 1"), "equal-texts",
    )
    # Both sides are plain shuffles of stored rows here, so a recipe with very many rows is split.
    return recipes.join(groups, "recipe", "left").select(
        F.col("row").alias(id_col), F.when(F.col("keep").isNull(), F.col("row")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.at") == F.col("at"), F.lit(True)).alias("kept"), "text_sha256",
    )


def _ranked(own: DataFrame, recipes: DataFrame, ranked: DataFrame, bits: int) -> DataFrame:
    """Recipes whose identifiers tell contents of one hash apart: a column ``at`` names the row.

    Only texts with such a chunk are cut again; they are found by their digest.
    """
    touched = recipes.select("text_sha256", F.explode("recipe").alias("hash")).join(
        ranked.select("hash").distinct(), "hash").select("text_sha256").distinct()
    texts = own.select("text", F.sha2("text", 256).alias("text_sha256")).join(touched, "text_sha256").dropDuplicates(["text_sha256"])
    pieces = texts.mapInArrow(_pieces(bits), "text_sha256 string, place int, hash long, chunk binary")
    resolved = (
        pieces.join(ranked, ["hash", "chunk"], "left")
        .groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct(
            "place", F.struct(F.col("hash").alias("h"), F.coalesce("rank", F.lit(0)).alias("rank")).alias("id")))).alias("x"))
        .select("text_sha256", F.transform("x", lambda v: v["id"]).alias("exact"))
    )
    plain = F.transform("recipe", lambda h: F.struct(h.alias("h"), F.lit(0).alias("rank")))
    return stored(
        recipes.join(resolved, "text_sha256", "left")
        .select("row", "text_sha256", F.coalesce("exact", plain).alias("recipe"), "at"), "ranked-recipes")


def _pieces(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            for first, last, data, offsets in text_slices(batch.column(0)):
                points, out = _cut_points(data), []
                for i in range(last - first):
                    for place, (a, b) in enumerate(cut_text(int(offsets[i]), int(offsets[i + 1]), points)):
                        piece = data[a:b].tobytes()
                        out.append((keys[first + i], place, _chunk_hash(piece, bits), piece))
                if out:
                    sha, place, h, piece = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sha), pa.array(place, pa.int32()), pa.array(h, pa.int64()), pa.array(piece, pa.binary())],
                        names=["text_sha256", "place", "hash", "chunk"],
                    )

    return run


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows equal in id and text, one.

    Rows whose id is not among those of dropped rows pass without being hashed or moved.
    """
    found = stored(exact_duplicates(docs), "exact-duplicates")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = stored(
        found.where(~F.col("kept")).select("doc_id", F.col("text_sha256").alias("sha"), same.alias("twin")).distinct(),
        "dropped-copies").alias("g")
    sure, perhaps = split_by_bitmap(docs, F.col("doc_id"), gone, F.col("doc_id"))
    marked = perhaps.select(
        F.struct(*docs.columns).alias("row"), "doc_id", F.sha2(single_spaced(F.col("text")), 256).alias("sha")).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.sha") == F.col("g.sha"))
    stay = marked.join(gone, on, "left_anti")
    # Rows that repeat the id and the text of the one that stays are told apart by nothing else.
    twins = marked.join(gone.where("g.twin"), on, "left_semi").dropDuplicates(["doc_id", "sha"])
    return sure.unionByName(stay.unionByName(twins).select("row.*"))


SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
