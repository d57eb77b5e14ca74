"""Helpers shared by the corpus operators: stored tables, words, and vectorised hashing of texts.

Texts reach Python in Arrow batches. ``text_slices`` walks them in slices of bounded size, so
memory does not follow the batch, and the hashes below are computed on all bytes of a slice at
once instead of word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsift.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 128 << 10  # of text; n-grams of a slice take about 120 times that
PAGE_BITS = 32_768  # of Spark's bitmap functions
MOST_PAGES = 16_384
U64 = np.uint64


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let Arrow batches hold ``most`` bytes at most, unless the session has set fewer.

    Every task holds some batches on either side of its Python worker; with long texts the
    default of 64 MiB adds up to more than the work needs.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, f"{most}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here."""
    path = path or scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of our own in the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def split_by_bitmap(docs: DataFrame, key: Column, ids: DataFrame, id_key: Column) -> tuple[DataFrame, DataFrame]:
    """``docs`` as ``(sure, perhaps)``: rows whose ``key`` is in no row of ``ids``, and those that may be.

    A bitmap of hashes tells them apart, 64 bits an id but 64 MiB at most, so that it can be sent
    to every task. It only spares movement: what may be in ``ids`` is left to an exact join, and
    with far more ids than bits everything may be.
    """
    pages = min(max(1, -(-ids.count() * 64 // PAGE_BITS)), MOST_PAGES)

    def place(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(pages * PAGE_BITS)) + 1

    maps = ids.select(place(id_key).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), place(key).alias("p")).withColumn("page", F.bitmap_bucket_number("p"))
    byte = "cast(conv(hex(substring(bitmap, cast(bitmap_bit_position(p) div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"coalesce(shiftright({byte}, cast(bitmap_bit_position(p) % 8 as int)) & 1, 0)") == 1
    told = rows.join(F.broadcast(maps), "page", "left")
    return told.where(~hit).select("row.*"), told.where(hit).select("row.*")


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def single_spaced(text: Column) -> Column:
    """Each run of white space as one space; null as empty. Single spaces are not matched at all."""
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), runs, " ")


# ---- Arrow batches --------------------------------------------------------------------------


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` for runs of texts of about ``limit`` bytes; null is empty.

    A single text above the limit is a slice of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    n, (_, offsets, data) = len(texts), texts.buffers()
    if n == 0:
        return
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


# ---- hashing --------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CODES = np.random.default_rng(20_240_501).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]
_STEP = U64(0x5851F42D4C957F2D)
_STEP_INVERSE = U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    found = _POWERS.get(name)
    if found is None or len(found) < n:
        found = np.full(n, base, np.uint64)
        found[:1] = 1
        _POWERS[name] = found = np.cumprod(found, dtype=np.uint64)
    return found[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of ``h`` over all bits."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False,
                block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; ``lower`` reads A-Z as a-z. Spans are in order.

    Prefix sums of a polynomial give all spans at once. A long input is walked in blocks: a span
    that crosses blocks adds up its parts.
    """
    codes = _LOWER_CODES if lower else _CODES
    total = np.zeros(len(starts), np.uint64)
    for at in range(0, len(data), block):
        part = data[at : at + block]
        i = int(np.searchsorted(ends, at, "right"))
        j = int(np.searchsorted(starts, at + len(part), "left"))
        if i >= j:
            continue
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes[part] * _powers("step", _STEP, len(part)), dtype=np.uint64, out=sums[1:])
        lo = np.maximum(starts[i:j] - at, 0)
        hi = np.minimum(ends[i:j] - at, len(part))
        # Bring the part to the position that it has in its span.
        gone = at + lo - starts[i:j]
        value = (sums[hi] - sums[lo]) * _powers("back", _STEP_INVERSE, len(part) + 1)[lo]
        if gone.any():
            for k in np.flatnonzero(gone):
                value[k : k + 1] *= U64(pow(int(_STEP), int(gone[k]), 1 << 64))
        total[i:j] += value
    return mix(total + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, first)``: the words in bytes, and for each text the index of its first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    opens[edges] = solid[edges]
    before = edges[edges > 0] - 1
    closes[before] = solid[before]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


_SHINGLE = (np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2)) + U64(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; with fewer words, the one of the whole sequence."""
    if not len(words):
        return words
    k = min(k, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * _SHINGLE[i % 64] + U64(i)
    return mix(total + U64(k))
