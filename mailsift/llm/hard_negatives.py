"""Hard negatives: for each anchor and positive, the best rows of other labels in a score window.

Candidates are laid out in Parquet as blocks of neighbouring rows, in the order of their label and
of a Hilbert curve through all dimensions. Each block has a zone map, the least and greatest value
per dimension. For an anchor ``a`` the inner products with all rows of a block lie between
``sum(min(a*lo, a*hi))`` and ``sum(max(a*lo, a*hi))``, so a block is read for an anchor only where
this interval meets one of the anchor's windows. Bounds and scores are matrix products of a tile of
anchors, taken from neighbouring blocks, with many zones or with the rows of one block.

The first pass finds the positives. Their window is open above; its lower end is what the anchor
finds in its own block. The second pass has a window below each positive's score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.llm.common import stored

BLOCK_ROWS = 1024
TILE_ANCHORS = 256
ZONES_TOGETHER = 2048
REGION_BLOCKS = 64
FILE_BYTES = 64 << 20
CURVE_BITS = 4
LARGEST = 1 << 26
NO_ID = np.iinfo(np.int64).max  # stands for a null id, which sorts last
NONE = np.iinfo(np.int64).min

ROWS = "id long, label long, is_anchor boolean, vector array<int>, key binary"
BLOCKS = ("n int, label_lo long, label_hi long, lo array<int>, hi array<int>, ids array<long>, "
          "labels array<long>, vectors array<int>, anchors array<int>")
TILES = "home array<long>, place array<int>, t_ids array<long>, t_labels array<long>, t_vectors array<int>, seeds array<long>"


class ScoreWindow(NamedTuple):
    """Negatives score from ``low`` to ``high`` per ``per`` of the positive's score."""

    low: int = 80
    high: int = 100
    per: int = 100

    def ends(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest integer score inside."""
        return -((-score * self.low) // self.per), (score * self.high) // self.per


# ---- the curve ------------------------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on a Hilbert curve of each row of ``cells`` (n x d, below 2**bits), as big-endian bytes.

    Skilling's transposition, for all rows at once: undo the excess rotations from the top bit down,
    Gray-encode, then read the bit planes from the top.
    """
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    d = len(x)
    for bit in range(bits - 1, 0, -1):
        high, below = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for i in range(d):
            swap = np.where(x[i] & high, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(x[i] & high, below, swap)
            x[i] ^= swap
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << bit), np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)


# ---- Arrow lists ----------------------------------------------------------------------------


def _list(column: pa.Array, i: int) -> np.ndarray:
    first, last = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    return column.values.slice(first, last - first).to_numpy(zero_copy_only=False)


def _matrix(column: pa.Array, i: int, d: int) -> np.ndarray:
    return _list(column, i).reshape(-1, d)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([a.size for a in arrays], out=ends[1:])
    values = np.concatenate([a.ravel() for a in arrays]) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def _record(values: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(values.values()), names=list(values))


# ---- layout ---------------------------------------------------------------------------------


def _keyed(d: int, largest: int):
    """Adds the place on the curve; shorter vectors are filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.zeros((batch.num_rows, d), np.int32)
            for i in range(batch.num_rows):
                own = _list(batch.column(3), i)
                vectors[i, : len(own)] = own
            cells = ((vectors.astype(np.int64) + largest) << CURVE_BITS) // (2 * largest + 1)
            keys = hilbert_keys(cells, CURVE_BITS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], _lists(list(vectors), pa.int32()), pa.array([k.tobytes() for k in keys], pa.binary())],
                names=["id", "label", "is_anchor", "vector", "key"])

    return run


def _blocks(d: int):
    """Sorted rows (id, label, is_anchor, vector) to blocks of at most BLOCK_ROWS of them."""

    def block(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
        anchors = np.flatnonzero(part.column(2).to_numpy())
        vectors = part.column(3).chunk(0).flatten().to_numpy().reshape(-1, d)
        return _record({
            "n": pa.array([len(ids)], pa.int32()), "label_lo": pa.array([labels.min()]), "label_hi": pa.array([labels.max()]),
            "lo": _lists([vectors.min(axis=0)], pa.int32()), "hi": _lists([vectors.max(axis=0)], pa.int32()),
            "ids": _lists([ids], pa.int64()), "labels": _lists([labels], pa.int64()),
            "vectors": _lists([vectors], pa.int32()), "anchors": _lists([anchors], pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while len(held) >= BLOCK_ROWS:
                yield block(held.slice(0, BLOCK_ROWS))
                held = held.slice(BLOCK_ROWS)
        if held is not None and len(held):
            yield block(held)

    return run


def scores_of(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles while they hold every integer that can occur."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(rows).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ rows.astype(np.int64).T


def bounds_of(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any point of each zone, rounded outwards."""
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    lo, hi = lo.astype(np.float64).T, hi.astype(np.float64).T
    least, most = up @ lo + down @ hi, up @ hi + down @ lo
    return least - 1 - np.abs(least) * 1e-9, most + 1 + np.abs(most) * 1e-9


def best_of(scores: np.ndarray, valid: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(anchor, row)`` of the k best valid rows of each anchor, higher scores and then smaller ids first."""
    scores = np.where(valid, scores, NONE)
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        valid = valid & (scores >= edge[:, None])
    anchor, row = np.nonzero(valid)
    order = np.lexsort((row, ids[row], -scores[anchor, row], anchor))
    anchor, row = anchor[order], row[order]
    first = np.searchsorted(anchor, np.arange(len(scores)))
    keep = np.arange(len(anchor)) - first[anchor] < k
    return anchor[keep], row[keep]


def _tiles(d: int, positives: int):
    """Blocks to tiles of their anchors, each with the score of its last positive inside its own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                place = _list(at["anchors"], i)
                if not len(place):
                    continue
                ids, labels, rows = _list(at["ids"], i), _list(at["labels"], i), _matrix(at["vectors"], i, d)
                scores = scores_of(rows[place], rows)
                same = labels[place][:, None] == labels[None, :]
                same[np.arange(len(place)), place] = False
                anchor, row = best_of(scores, same, ids, positives)
                seeds = np.full(len(place), NONE)
                enough = np.bincount(anchor, minlength=len(place)) >= positives
                last = np.searchsorted(anchor, np.arange(len(place)), "right") - 1
                seeds[enough] = scores[anchor[last[enough]], row[last[enough]]]
                home = np.full(len(place), at["block"][i].as_py())
                for first in range(0, len(place), TILE_ANCHORS):
                    cut = slice(first, first + TILE_ANCHORS)
                    if n and n + len(place[cut]) > TILE_ANCHORS:
                        yield tile(held)
                        held, n = [], 0
                    held.append((home[cut], place[cut], ids[place[cut]], labels[place[cut]], rows[place[cut]], seeds[cut]))
                    n += len(place[cut])
        if held:
            yield tile(held)

    def tile(held: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        names = [part.split()[0] for part in TILES.split(", ")]
        return _record({name: _lists([np.concatenate([p.ravel() for p in parts])], kind)
                        for name, parts, kind in zip(names, zip(*held), kinds)})

    return run


# ---- choosing and reading blocks ------------------------------------------------------------


def _windows(batch: dict, i: int, window: ScoreWindow) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile's positives: (place in the tile, rank, low, high)."""
    place, rank, score = (_list(batch[name], i) for name in ("p_place", "p_rank", "p_score"))
    return place, rank, *window.ends(score)


def _choose(d: int, window: ScoreWindow | None):
    """Tile and zones to (tile, region, wanted blocks). Without a window, for the positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                blocks, lo, hi = _list(at["z_block"], i), _matrix(at["z_lo"], i, d), _matrix(at["z_hi"], i, d)
                first, last = _list(at["z_label_lo"], i), _list(at["z_label_hi"], i)
                labels = _list(at["t_labels"], i)[:, None]
                least, most = bounds_of(_matrix(at["t_vectors"], i, d), lo, hi)
                if window is None:
                    wanted = (first <= labels) & (labels <= last) & (most >= _list(at["seeds"], i)[:, None])
                    wanted = wanted.any(axis=0)
                else:
                    place, _, low, high = _windows(at, i, window)
                    meets = (low <= high)[:, None] & (most[place] >= low[:, None]) & (least[place] <= high[:, None])
                    wanted = (meets & ~((first == labels) & (last == labels))[place]).any(axis=0)
                blocks = np.sort(blocks[wanted])
                regions, start = np.unique(blocks // REGION_BLOCKS, return_index=True)
                if len(regions):
                    yield _record({
                        "tile": pa.array(np.full(len(regions), at["tile"][i].as_py())), "region": pa.array(regions),
                        "wanted": _lists(np.split(blocks, start[1:]), pa.int64())})

    return run


def _read_positives(d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                ids, rows, block = _list(at["ids"], i), _matrix(at["vectors"], i, d), at["block"][i].as_py()
                scores = scores_of(_matrix(at["t_vectors"], i, d), rows)
                own = _list(at["home"], i) == block
                valid = _list(at["t_labels"], i)[:, None] == _list(at["labels"], i)[None, :]
                valid &= scores >= _list(at["seeds"], i)[:, None]
                valid[np.flatnonzero(own), _list(at["place"], i)[own]] = False
                anchor, row = best_of(scores, valid, ids, k)
                if len(anchor):
                    yield _record({
                        "tile": pa.array(np.full(len(anchor), at["tile"][i].as_py())), "place": pa.array(anchor.astype(np.int32)),
                        "score": pa.array(scores[anchor, row]), "id": pa.array(ids[row]),
                        "block": pa.array(np.full(len(row), block)), "row": pa.array(row.astype(np.int32))})

    return run


def _read_negatives(d: int, k: int, window: ScoreWindow):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                ids, rows = _list(at["ids"], i), _matrix(at["vectors"], i, d)
                scores = scores_of(_matrix(at["t_vectors"], i, d), rows)
                other = _list(at["t_labels"], i)[:, None] != _list(at["labels"], i)[None, :]
                place, rank, low, high = _windows(at, i, window)
                for r in np.unique(rank):
                    of = rank == r
                    mine, where = scores[place[of]], place[of]
                    valid = other[where] & (mine >= low[of][:, None]) & (mine <= high[of][:, None])
                    anchor, row = best_of(mine, valid, ids, k)
                    if len(anchor):
                        yield _record({
                            "tile": pa.array(np.full(len(anchor), at["tile"][i].as_py())),
                            "place": pa.array(where[anchor].astype(np.int32)), "positive": pa.array(np.full(len(anchor), r, np.int32)),
                            "score": pa.array(mine[anchor, row]), "id": pa.array(ids[row]),
                            "block": pa.array(np.full(len(row), at["block"][i].as_py())), "row": pa.array(row.astype(np.int32))})

    return run


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key, with their rank. Limits apply before the rows are shuffled."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "block", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as an integer, held within plus and minus 2**26."""
    held = lambda x: F.least(F.greatest(x * scale, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(held(x)).cast("int"))


def usable(vector: Column) -> Column:
    """A vector, null in no component, and each of them finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda x: F.coalesce(finite(x), F.lit(False)))


RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def mine_hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label",
                        vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5,
                        window: ScoreWindow = ScoreWindow()) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(scale * x)``, scores are integer inner products, higher ones and then
    smaller ids come first; rows that repeat an id are rows of their own, in the order of the
    layout. ``anchors`` says which rows are anchors, ``positives`` how many other rows of an
    anchor's label count (all, if fewer), ``negatives`` how many rows of other labels in the window
    below each positive are returned. A row without a label, a vector or with a component that is
    null or not finite takes no part. A shorter vector counts as filled up with zeros; a quantised
    component beyond 2**26 counts as that. A null id sorts last (the largest 64-bit integer is read
    as one). Other columns are ignored.
    """
    spark = vectors.sparkSession
    own = vectors.where(F.col(label_col).isNotNull() & usable(F.col(vector_col))).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"), quantised(F.col(vector_col), scale).alias("vector"))
    n, d, most = own.agg(
        F.count("*"), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    d, most = max(d, 1), max(most or 0, 1)

    files = max(math.ceil(n * d * 4 / FILE_BYTES), spark.sparkContext.defaultParallelism)
    order = ("label", "key", "id", "at")  # equal vectors are dealt out by id
    blocks = stored(
        own.mapInArrow(_keyed(d, most), ROWS).withColumn("at", F.monotonically_increasing_id())
        .repartitionByRange(files, *order).sortWithinPartitions(*order).select("id", "label", "is_anchor", "vector")
        .mapInArrow(_blocks(d), BLOCKS).withColumn("block", F.monotonically_increasing_id())
        .withColumn("region", F.floor(F.col("block") / REGION_BLOCKS)), "blocks")
    tiles = stored(
        blocks.select("block", "ids", "labels", "vectors", "anchors").mapInArrow(_tiles(d, positives), TILES)
        .withColumn("tile", F.monotonically_increasing_id()), "anchor-tiles")
    groups = math.ceil(blocks.count() / ZONES_TOGETHER)
    zones = stored(
        blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
        .groupBy("group").agg(F.collect_list(F.struct("block", "label_lo", "label_hi", "lo", "hi")).alias("z"))
        .select("group", *(F.col(f"z.{c}").alias(f"z_{c}") for c in ("block", "label_lo", "label_hi")),
                F.flatten("z.lo").alias("z_lo"), F.flatten("z.hi").alias("z_hi")), "zone-maps")

    def reading(tiles: DataFrame, window: ScoreWindow | None, label: str) -> DataFrame:
        """Tiles beside each block that one of their anchors must read; a tile moves once per region."""
        every = tiles.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn(
            "group", F.col("group").cast("long"))
        wanted = stored(every.join(zones, "group").mapInArrow(
            _choose(d, window), "tile long, region long, wanted array<long>"), label)
        return wanted.join(tiles, "tile").join(blocks, "region").where(F.array_contains("wanted", F.col("block")))

    found = reading(tiles, None, "positive-blocks").select(
        "tile", "home", "place", "t_labels", "t_vectors", "seeds", "block", "ids", "labels", "vectors",
    ).mapInArrow(_read_positives(d, positives), "tile long, place int, score long, id long, block long, row int")
    chosen = stored(_first(found, ["tile", "place"], positives), "positives")
    per_tile = chosen.groupBy("tile").agg(F.collect_list(F.struct("place", "rank", "score")).alias("p")).select(
        "tile", F.col("p.place").alias("p_place"), F.col("p.rank").alias("p_rank"), F.col("p.score").alias("p_score"))
    armed = stored(tiles.select("tile", "t_labels", "t_vectors").join(per_tile, "tile"), "armed-tiles")
    found = reading(armed, window, "negative-blocks").select(
        "tile", "t_labels", "t_vectors", "p_place", "p_rank", "p_score", "block", "ids", "labels", "vectors",
    ).mapInArrow(_read_negatives(d, negatives, window),
                 "tile long, place int, positive int, score long, id long, block long, row int")
    best = _first(found, ["tile", "place", "positive"], negatives)
    named = lambda c: F.when(F.col(c) != F.lit(int(NO_ID)), F.col(c))
    anchors_of = tiles.select("tile", F.posexplode("t_ids").alias("place", "anchor"))
    return (
        best.join(chosen.select("tile", "place", F.col("rank").alias("positive"), F.col("id").alias("positive_id"),
                                F.col("score").alias("positive_score")), ["tile", "place", "positive"])
        .join(anchors_of, ["tile", "place"])
        .select(named("anchor").alias("anchor_id"), named("positive_id").alias("positive_id"), "rank",
                named("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, a.label, a.q, b.vec_id AS other_id, b.label AS other_label,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM p WHERE label = other_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
neg AS (
  SELECT pos.*, p.other_id AS negative_id, p.score AS negative_score,
    row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM pos JOIN p USING (anchor_id)
  WHERE label <> other_label AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM neg WHERE rank <= 5
"""
