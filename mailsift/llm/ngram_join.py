"""Similarity join of texts on word n-gram sets, and near-duplicate groups, by parity sketches.

A document's set holds the hashes of its distinct word n-grams. Folding tokens by XOR keeps parity:
a token in both sets cancels, so two XOR sketches differ in at most as many places as the sets have
tokens that are not shared. Sets of ``a`` and ``b`` tokens with a Jaccard similarity of at least
``p`` per cent differ in at most ``d = (a + b) * (100 - p) / (100 + p)`` tokens. Hence

* **pigeonhole**: deal tokens by hash to ``m`` blocks and fold each block by XOR to one code;
  similar sets agree in at least ``m - d`` blocks. Sorted by any fixed order of block codes, the
  first ``d + s`` codes of either set then share ``s`` codes at least. The order puts well-filled
  blocks first, so that empty blocks and those that hold only a token or two of a common passage,
  which match by chance, are the ones left out. Nothing is lost by it;
* **size bands**: ``m`` and ``d`` are those of a band of sizes; a set also enters lower bands from
  which a partner can come;
* **bound**: 512-bit parity sketches of two candidates are compared; a Hamming distance above
  ``d`` rules the pair out without its texts, inside the join on the code;
* **verify**: what remains is decided on the token sets themselves.

As similar sets share ``s`` codes of a band, a document with fewer codes that any other document
has is out of that band at once; that sieve leaves little but near copies.

Documents with equal sets are one class from the start. Within a bucket (documents with an equal
block code) members are first held against the smallest one only. After the links found so far
are closed to components, pairs of a bucket that lie in different components are compared as well:
all others are joined already, so no link between components is lost and a large group of near
copies is never expanded into its pairs. Before that, a few turns hold the members of each bucket
that is in several components against another one of it. A code of a common passage can be in very many texts that
are not similar. As similar sets share ``s`` codes, one with fewer than ``s`` crowded codes shares
an uncrowded one with each partner; so only documents with ``s`` crowded codes or more, hardly
anything but common passages, are compared within crowded buckets. Buckets are reduced to their smallest member within each
slice of the input before the shuffle; a code that very many documents share arrives as one row
per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.llm.common import (
    U64, discard, mix, shingle_hashes, span_hashes, split_by_bitmap, stored, text_slices, word_spans,
)
from mailsift.llm.components import components
from mailsift.session import scratch_path

BAND_RATIO = 1.4
SHARED, LEFT_OUT = 0.2, 0.1  # codes shared for certain beyond the second, and blocks left out, as shares of d
PIVOT_TURNS = 3
CROWDED = 24  # documents of a bucket beyond which its pairs are not simply compared
SKETCH_WORDS = 8
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def band_of(size: int) -> int:
    """Bands are (1.4 ** (i - 1), 1.4 ** i], with whole ends."""
    i = max(0, int(np.ceil(np.log(size) / np.log(BAND_RATIO) - 1e-9)))
    return i - 1 if i and size <= band_top(i - 1) else i if size <= band_top(i) else i + 1


def band_top(i: int) -> int:
    return int(BAND_RATIO**i + 1e-9)


def band_plan(i: int, percent: int) -> tuple[int, int, int]:
    """``(m, d, s)`` of band ``i``: no pair whose smaller set is in it differs in more than ``d`` tokens.

    Of ``m`` blocks ``d + s`` give codes, of which such a pair shares ``s``.
    """
    top = band_top(i)
    d = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
    s = 2 + int(SHARED * d)
    return d + s + int(LEFT_OUT * d), d, s


def bands_for(size: int, percent: int) -> Iterator[int]:
    """Its own band, and lower ones whose sets can be similar to one of ``size``."""
    i = band_of(size)
    yield i
    while i > 0 and band_top(i - 1) * 100 >= size * percent:
        i -= 1
        yield i


def block_codes(tokens: np.ndarray, band: int, percent: int) -> np.ndarray:
    """The codes of the first ``d + s`` blocks of sorted ``tokens``: 42 bits, and the band in the low six.

    A band in which similar sets are equal gives none: equal sets are one class. Codes are the bulk of
    what is moved, so they are no longer than keeps chance matches rare; one costs a seat, no link.
    """
    m, d, s = band_plan(band, percent)
    if not d:
        return np.zeros(0, np.uint64)
    block = ((tokens >> U64(32)) * U64(m)) >> U64(32)  # does not fall, as tokens are sorted
    filled = np.bincount(block.astype(np.int64), minlength=m)
    used = np.flatnonzero(filled)
    fold = np.zeros(m, np.uint64)
    fold[used] = np.bitwise_xor.reduceat(tokens, (np.cumsum(filled) - filled)[used])
    place = np.arange(m, dtype=np.uint64) + U64(band << 32)
    codes = mix(mix(fold + U64(1)) ^ mix(place * U64(0x9E3779B97F4A7C15) + filled.astype(np.uint64)))
    order = np.lexsort((codes, -filled))
    return (codes[order[: d + s]] >> U64(16) & ~U64(63)) | U64(min(band, 63))


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """512 parity bits in 8 words."""
    bits = np.bincount((tokens & U64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def token_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each slice its first index and the sorted token set of each text."""
    for first, last, data, offsets in text_slices(texts):
        starts, ends, at = word_spans(data, offsets)
        words = span_hashes(data, starts, ends, lower=True)
        yield first, [_distinct(shingle_hashes(words[at[i] : at[i + 1]], k)) for i in range(last - first)]


SIGNATURES = "doc long, n_tokens long, digest_a long, digest_b long, near array<struct<code: long, pivot: long>>"
CODES = "doc long, codes array<long>"


def signature_batches(k: int, percent: int, codes_only: bool, slice_codes: int = 1_000_000):
    """Batches of (doc, text) to signatures, or to the codes that a document stands for.

    Within a slice the smallest document of a code stands for it, and ``near`` names it to the others.
    Slices follow the rows of a partition alone, so both forms cut them alike; the codes, by far
    the larger part, are made again on their way into the shuffle rather than stored.
    """
    near_kind = pa.list_(pa.struct([("code", pa.int64()), ("pivot", pa.int64())]))

    def lists(values, counts, type_):
        at = np.zeros(len(counts) + 1, np.int32)
        np.cumsum(counts, out=at[1:])
        return pa.ListArray.from_arrays(pa.array(at), values, type=type_)

    def flush(docs, sizes, a, b, codes):
        n = len(docs)
        counts = np.array([len(c) for c in codes], np.int64)
        owner = np.repeat(np.arange(n), counts)
        flat = np.concatenate(codes) if n else np.zeros(0, np.uint64)
        doc = np.array(docs, np.int64)
        # The smallest document of each code stands for it beyond this slice.
        order = np.lexsort((doc[owner], flat)) if len(flat) else np.zeros(0, np.int64)
        head = np.ones(len(flat), bool)
        head[1:] = flat[order][1:] != flat[order][:-1]
        pivot = doc[owner[order]][np.flatnonzero(head)[np.cumsum(head) - 1]] if len(flat) else doc[:0]
        stands, pivots = np.zeros(len(flat), bool), np.zeros(len(flat), np.int64)
        stands[order], pivots[order] = head, pivot
        signed = flat.view(np.int64)
        if codes_only:
            own = lists(pa.array(signed[stands]), np.bincount(owner[stands], minlength=n), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(doc), own], names=["doc", "codes"])
        near = pa.StructArray.from_arrays(
            [pa.array(signed[~stands]), pa.array(pivots[~stands])], ["code", "pivot"]
        )
        return pa.RecordBatch.from_arrays([
            pa.array(doc), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
            lists(near, np.bincount(owner[~stands], minlength=n), near_kind),
        ], names=["doc", "n_tokens", "digest_a", "digest_b", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list, ...] = ([], [], [], [], [])
        known: dict[tuple[int, int], int] = {}
        held = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, sets in token_sets(batch.column(1), k):
                for i, tokens in enumerate(sets):
                    size = len(tokens)
                    a, b = 0, 0
                    codes = np.zeros(0, np.uint64)
                    if size:
                        a = int(np.bitwise_xor.reduce(tokens).view(np.int64))
                        b = int(np.add.reduce(tokens).view(np.int64))
                        if known.setdefault((a, b), int(ids[first + i])) == int(ids[first + i]):
                            codes = np.concatenate([block_codes(tokens, x, percent) for x in bands_for(size, percent)])
                    for put, value in zip(rows, (int(ids[first + i]), size, a, b, codes)):
                        put.append(value)
                    held += len(codes) + 32
                    if held > slice_codes:
                        yield flush(*rows)
                        rows, held = ([], [], [], [], []), 0
                        known.clear()
        if rows[0]:
            yield flush(*rows)

    return run


def set_batches(k: int):
    """Batches of (doc, text) to (doc, n_tokens, sketch, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, sets in token_sets(batch.column(1), k):
                sketches = np.stack([parity_sketch(x) for x in sets])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, len(sets)), pa.array([len(x) for x in sets], pa.int64()),
                    *[pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(SKETCH_WORDS)],
                    pa.array([x.tobytes() for x in sets], pa.binary()),
                ], names=["doc", "n_tokens", *SKETCH, "tokens"])

    return run


SET_SCHEMA = "doc long, n_tokens long, " + "".join(f"{c} long, " for c in SKETCH) + "tokens binary"


def verify_batches(percent: int):
    """Batches of (a, b, tokens_a, tokens_b) to the pairs (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"]
            )

    return run


def _put(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A stored table and its path, to discard it when nothing reads it any more."""
    path = scratch_path(df.sparkSession, label)
    return stored(df, label, path), path


def _may_be_similar(x: str, y: str, percent: int) -> Column:
    """Sizes and the Hamming distance of the sketches allow it; columns are named ``x_n_tokens`` and so on."""
    a, b = F.col(f"{x}_n_tokens"), F.col(f"{y}_n_tokens")
    apart = sum((F.bit_count(F.col(f"{x}_{c}").bitwiseXOR(F.col(f"{y}_{c}"))) for c in SKETCH), F.lit(0))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (apart * (100 + percent) <= (a + b) * (100 - percent))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id)``, a row per input row.

    Texts are lower-cased in A-Z and cut at ASCII white space. Two documents link when their sets
    of distinct ``k``-word shingles have a Jaccard similarity of at least ``percent`` / 100; a text
    of fewer words is one shingle. Without words (or text) a document links with nothing.
    ``component_id`` is the smallest id reachable by links, its own included. A row without id gets
    its ``n_shingles`` and a null component; rows with one id are one node. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = own.where("doc is not null")
    spark, scratch = docs.sparkSession, scratch_path(docs.sparkSession, "signatures")
    signatures = stored(known.mapInArrow(signature_batches(k, percent, False), SIGNATURES), "signatures", scratch)

    digest = ["n_tokens", "digest_a", "digest_b"]
    sizes = signatures.select("doc", *digest)
    groups = stored(
        sizes.where("n_tokens > 0").groupBy(*digest).agg(F.min("doc").alias("rep"), F.count("*").alias("n"))
        .where("n > 1").drop("n"), "classes",
    )
    classes = stored(sizes.join(groups, digest, "left").select(
        "doc", "n_tokens", F.coalesce("rep", "doc").alias("rep")), "members-of-classes")

    by_code = Window.partitionBy("code")
    buckets = (
        known.mapInArrow(signature_batches(k, percent, True), CODES).select("doc", F.explode("codes").alias("code"))
        .withColumns({"pivot": F.min("doc").over(by_code), "n": F.count("*").over(by_code)})
        .where("n > 1").select("code", "doc", "pivot")
    )
    inside = signatures.select("doc", F.explode("near").alias("x")).select("x.code", "doc", "x.pivot")
    # Seats: who stands in a bucket, those met inside slices and those that stood for the slices.
    members = buckets.unionByName(inside)
    seats, at = _put(members.select("code", "doc").union(members.select("code", "pivot")).distinct(), "seats")
    discard(spark, scratch)  # all that matters of it is in the seats
    band = F.expr("cast(code & 63 as int)").alias("band")
    shared = F.element_at(F.array(*[F.lit(band_plan(i, percent)[2]) for i in range(64)]), F.col("band") + 1)
    # Who shares fewer codes of a band than similar sets do has no partner in it. A document's codes are
    # as many as its text is long, so they can stand in one row.
    own_codes = seats.groupBy("doc", band).agg(F.collect_list("code").alias("codes")).where(F.size("codes") >= shared)
    seats, sieved = _put(own_codes.select(F.explode("codes").alias("code"), "doc", F.size("codes").alias("weight")), "sieved")
    discard(spark, at)
    involved = stored(seats.select("doc").distinct(), "involved")
    sets, sets_at = _put(
        # Few of them are not involved after all; a set too many is never asked for.
        split_by_bitmap(known, F.col("doc"), involved, F.col("doc"))[1].select("doc", "text")
        .mapInArrow(set_batches(k), SET_SCHEMA), "sets",
    )

    def side(table: DataFrame, x: str, keep: tuple[str, ...] = ()) -> DataFrame:
        return table.select(*keep, *[F.col(c).alias(x if c == "doc" else f"{x}_{c}") for c in table.columns if c not in keep])

    sketches = sets.drop("tokens")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        close = stored(pairs.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").where(
            _may_be_similar("a", "b", percent)).select("a", "b"), f"close-{label}")
        asked = close.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        tokens = split_by_bitmap(sets.select("doc", "tokens"), F.col("doc"), stored(asked, f"asked-{label}"), F.col("doc"))[1]
        return stored(
            close.join(side(tokens, "a"), "a").join(side(tokens, "b"), "b").select("a", "b", "a_tokens", "b_tokens")
            .mapInArrow(verify_batches(percent), "a long, b long"), label,
        )

    # Only documents that have a seat take part; the rest of their class follows its representative.
    links = stored(involved.join(classes, "doc").where("doc <> rep").select(
        F.col("doc").alias("a"), F.col("rep").alias("b")), "links-of-classes")
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("component_id"))

    def labelled(rows: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            rows = rows.join(
                labels.select(F.col("node").alias(c), F.col("component_id").alias(f"{c}_in")), c, "left"
            ).withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))
        return rows

    for turn in range(PIVOT_TURNS):
        # The members of each open bucket are held against one of it, first the one with most seats.
        placed, at = _put(labelled(seats, "doc"), f"placed-{turn}")
        draw = (-F.col("weight") if turn < 2 else F.xxhash64("doc", F.lit(turn))).alias("draw")
        pivots = stored(
            placed.groupBy("code").agg(
                F.min("doc_in").alias("lo"), F.max("doc_in").alias("hi"),
                F.min(F.struct(draw, F.col("doc"), F.col("doc_in"))).alias("pivot"))
            .where("lo <> hi").select("code", "pivot"), f"pivots-{turn}")
        open_, left = _put(placed.join(pivots, "code"), f"open-{turn}")
        discard(spark, at)
        apart = open_.where("doc_in <> pivot.doc_in").groupBy(
            "doc", F.col("pivot.doc").alias("pivot")).agg(F.count("*").alias("n"))
        if turn == 0:  # one for each: the pivot of most of its codes
            apart = apart.groupBy("doc").agg(F.max(F.struct("n", "pivot")).alias("x")).select("doc", "x.pivot")
        more = verified(apart.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct(),
                        f"links-{turn}")
        # A bucket that is in one component stays so: only the seats of open ones go on.
        discard(spark, sieved)
        seats, sieved = open_.select("code", "doc", "weight"), left
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = stored(components(links, "a", "b"), f"labels-{turn}")
        elif turn:
            break
    placed = labelled(seats.drop("weight"), "doc")
    mixed = stored(
        placed.groupBy("code").agg(F.min("doc_in").alias("lo"), F.max("doc_in").alias("hi"), F.count("*").alias("n"))
        .where("lo <> hi").select("code", "n"), "mixed")
    seats = stored(placed.join(mixed, "code"), "open-seats")
    settled = []
    for turn in range(3):
        settled.append(seats.where(F.col("n") <= CROWDED))
        crowded = seats.where(F.col("n") > CROWDED).drop("n")
        enough = (
            crowded.groupBy("doc", band).agg(F.count("*").alias("h")).where(F.col("h") >= shared).select("doc", "band")
        )
        kept = stored(crowded.select("*", band).join(enough, ["doc", "band"], "left_semi").drop("band"),
                      f"crowded-{turn}")
        seats = stored(kept.join(kept.groupBy("code").agg(F.count("*").alias("n")), "code"), f"seats-{turn}")
    open_seats = seats
    for part in settled:
        open_seats = open_seats.unionByName(part)
    near = open_seats.select("code", "doc", "doc_in").join(sketches, "doc")
    across = (
        side(near, "x", ("code",)).join(side(near, "y", ("code",)), "code")
        .where((F.col("x_doc_in") < F.col("y_doc_in")) & _may_be_similar("x", "y", percent))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    )
    more = verified(across, "links-across")
    if not more.isEmpty():
        labels = stored(components(links.unionByName(more), "a", "b"), "labels-across")

    of_class = labels.select(F.col("node").alias("rep"), "component_id")
    found = stored(
        classes.join(of_class, "rep", "left").select(
            F.col("doc").alias(id_col), F.col("n_tokens").alias("n_shingles"),
            F.coalesce("component_id", "rep").alias("component_id"),
        ), "near-duplicates",
    )
    for path in (sets_at, sieved):
        discard(spark, path)
    nameless = own.where("doc is null").mapInArrow(set_batches(k), SET_SCHEMA)
    return found.unionByName(nameless.select(
        F.col("doc").alias(id_col), F.col("n_tokens").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")
    ))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of ``docs`` without the near copies: of each group the smallest ``doc_id`` stays.

    All columns and rows of what stays are kept; rows without id have no group and stay.
    """
    gone = stored(near_duplicates(docs, k, percent).where("doc_id <> component_id").select("doc_id"), "near-copies")
    sure, perhaps = split_by_bitmap(docs, F.col("doc_id"), gone, F.col("doc_id"))
    return sure.unionByName(perhaps.join(gone, "doc_id", "left_anti").select(*docs.columns))
