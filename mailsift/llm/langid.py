"""Language identification by a string kernel with Nystroem landmarks and ridge regression.

The kernel is the blended spectrum of byte n-grams of one to four bytes in presence form: two texts
are as similar as the share of n-grams they have in common, ``|A & B| / sqrt(|A| |B|)``. A bounded
sample of labelled texts is the training set and part of it the landmarks; kernel ridge regression
in the Nystroem space is fitted one language against the rest. Scoring is a product of the batch's
presence matrix with the landmarks and their coefficients; as the kernel is linear in the presence
vector but for its length, both factors are multiplied once and each batch needs one product.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from mailsift.llm.common import U64, text_slices

BINS = 1 << 16
STRETCH = 1 << 18  # of bytes that are turned into n-grams at once
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 400  # bound of the training sample, texts of each language
SAMPLE_TEXTS = 40_000  # of all languages; with over 10,000 of them, four texts of each
LANDMARKS = 100  # of each language
ALL_LANDMARKS = 1000  # of all languages; with over 1,000 of them, one of each
RIDGE = 1e-2
UNKNOWN = "und"
_MULTIPLIER = U64(0x9E3779B97F4A7C15)


def presence(data: np.ndarray, offsets: np.ndarray, lower: bool = True, rows: int = 64) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, row, bin)``: the distinct n-gram bins of the texts of a slice, in groups of texts.

    ``lower`` reads A-Z as a-z; a text counts as if in spaces.
    """
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8) if lower else data
    for first in range(0, len(offsets) - 1, rows):
        last = min(first + rows, len(offsets) - 1)
        own = offsets[first : last + 1]
        sizes = np.diff(own)
        # One space before and after each text keeps n-grams from running across texts.
        shift = np.repeat(np.arange(last - first) * 2 + 1, sizes)
        text = np.full(int(own[-1] - own[0]) + 2 * (last - first), 32, np.uint8)
        text[np.arange(own[-1] - own[0]) + shift] = low[own[0] : own[-1]]
        ends = np.cumsum(sizes + 2)
        seen = np.zeros((last - first) * BINS, bool)
        for start in range(0, len(text), STRETCH):  # n-grams that begin in this stretch
            code = text[start : start + STRETCH + max(ORDERS) - 1].astype(np.uint64)
            row = np.searchsorted(ends, np.arange(start, start + len(code)), "right")
            gram = np.zeros(min(len(code), STRETCH), np.uint64)
            for n in range(1, max(ORDERS) + 1):
                gram = gram[: len(code) - n + 1]
                gram |= code[n - 1 : n - 1 + len(gram)] << U64(8 * (n - 1))
                if n in ORDERS and len(gram):
                    inside = row[: len(gram)] == row[n - 1 : n - 1 + len(gram)]
                    place = ((gram + U64(n << 40)) * _MULTIPLIER >> U64(48)).astype(np.int64)
                    seen[(row[: len(gram)] * BINS + place)[inside]] = True
        at = np.flatnonzero(seen)
        yield first, last, at // BINS, at % BINS


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in text_slices(batch.column(1)):
            for first, last, row, bin_ in presence(data, offsets):
                cuts = np.searchsorted(row, np.arange(last - first + 1))
                packed = [bin_[cuts[i] : cuts[i + 1]].astype(np.uint16).tobytes() for i in range(last - first)]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(at + first, last - first) for c in (batch.column(0), batch.column(2))], pa.array(packed, pa.binary())],
                    names=["lang", "draw", "bins"])


def _dense(rows: list[bytes]) -> np.ndarray:
    """Unit presence vectors."""
    x = np.zeros((len(rows), BINS), np.float32)
    for i, packed in enumerate(rows):
        own = np.frombuffer(packed, np.uint16)
        x[i, own] = 1 / np.sqrt(max(len(own), 1))
    return x


def fit(sample: list[tuple[str, bytes]]) -> tuple[list[str], np.ndarray]:
    """Languages and weights (bins x languages) so that ``presence / sqrt(size) @ weights`` is the regression."""
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return [], np.zeros((BINS, 0), np.float32)
    ordered = sorted(sample)
    of_each, marks, taken = min(LANDMARKS, max(1, ALL_LANDMARKS // len(languages))), [], Counter()
    for lang, bins in ordered:
        if taken[lang] < of_each:
            marks.append(bins)
            taken[lang] += 1
    z = _dense(marks)
    inner = (z @ z.T).astype(np.float64)
    values, vectors = np.linalg.eigh(inner)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])  # maps kernel rows to the Nystroem space
    known = [l for l, _ in ordered]
    k = np.vstack([_dense([b for _, b in ordered[i : i + 256]]) @ z.T for i in range(0, len(ordered), 256)])
    phi = np.hstack([k.astype(np.float64) @ root, np.ones((len(ordered), 1))])
    of = {lang: i for i, lang in enumerate(languages)}
    y = np.zeros((len(known), len(languages)))
    y[np.arange(len(known)), [of[l] for l in known]] = 1.0
    # Each language weighs the same, however many texts of it are in the sample.
    often = Counter(known)
    weight = np.array([len(known) / len(languages) / often[l] for l in known])[:, None]
    penalty = RIDGE * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(phi.T @ (phi * weight) + penalty * len(known) / 100, phi.T @ (y * weight))
    weights = z.T @ (root @ beta[:-1]).astype(np.float32)
    return languages, np.vstack([weights, beta[-1:].astype(np.float32)])


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, bytes]]:
    """Presence bins of at most ``per_language`` texts of each language and about SAMPLE_TEXTS in all.

    Ids are drawn by hash. The number of ids of each language tells below which hash about twice
    as many lie as are wanted; only those are ranked, so no task ranks a whole language. One text
    is kept of each drawn id, however many rows repeat it, and the smallest bins of them.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(id_col, F.lit(5)).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    if not sizes:
        return []
    wanted = min(per_language, max(4, SAMPLE_TEXTS // len(sizes)))
    below = {lang: min(1.0, 2.0 * (wanted + 10) / max(n, 1)) for lang, n in sizes.items()}
    chosen, todo = [], below
    while todo:
        limits = spark.createDataFrame(
            [(lang, int(share * (1 << 63)) * 2 - (1 << 63) if share < 1 else (1 << 63) - 1) for lang, share in todo.items()],
            "lang string, highest long")
        ids = rows.join(F.broadcast(limits), "lang").where("draw <= highest").select("lang", "draw").distinct()
        ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))
        found = ranked.where(F.col("rank") <= wanted).select("lang", "draw").collect()
        counts = Counter(r["lang"] for r in found)
        # Too few below the limit: again for that language, from all its ids in the end.
        again = {lang: min(1.0, share * 16) for lang, share in todo.items() if share < 1 and counts[lang] < wanted}
        chosen += [tuple(r) for r in found if r["lang"] not in again]
        todo = again
    # At most SAMPLE_TEXTS pairs, or four of each language.
    drawn = F.broadcast(spark.createDataFrame(chosen, "c_lang string, c_draw long"))
    texts = docs.withColumn("_draw", F.xxhash64(id_col, F.lit(5))).join(
        drawn, (F.col("_draw") == F.col("c_draw")) & (F.col(lang_col) == F.col("c_lang"))
    ).select(F.col("c_lang").alias("lang"), F.col(text_col).alias("text"), F.col("c_draw").alias("draw"))
    found = texts.mapInArrow(_bins, "lang string, draw long, bins binary")
    return [(r["lang"], bytes(r["bins"])) for r in found.groupBy("lang", "draw").agg(F.min("bins").alias("bins")).collect()]


def score_batches(languages: list[str], weights: np.ndarray, inside: int | None = None):
    """Batches whose last two columns are the text and whether it has a letter.

    With ``inside`` the text is that field of a struct, which is kept, so it is not sent twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*languages, UNKNOWN])
        for batch in batches:
            has_letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            texts = batch.column(batch.num_columns - 2)
            kept = batch.num_columns - 2
            if inside is not None:
                texts, kept = pc.struct_field(texts, inside), kept + 1
            for at, end, data, offsets in text_slices(texts):
                for first, last, row, bin_ in presence(data, offsets):
                    n = last - first
                    sizes = np.bincount(row, minlength=n)
                    heads = np.searchsorted(row, np.arange(n))
                    total = np.add.reduceat(weights[bin_], heads, axis=0) if languages else np.zeros((n, 0), np.float32)
                    f = total / np.sqrt(sizes)[:, None] + weights[-1]
                    known = has_letter[at + first : at + last] & bool(languages)
                    best = np.where(known, f.argmax(axis=1) if languages else 0, len(languages))
                    top = f.max(axis=1) if languages else np.zeros(n)
                    score = np.where(known, np.clip(top, 0, 1), 0.0).astype(np.float64)
                    yield pa.RecordBatch.from_arrays(
                        [*[c.slice(at + first, n) for c in batch.columns[:kept]],
                         pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                        names=[*batch.schema.names[:kept], "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, train_on: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", carry: list[str] = [], per_language: int = PER_LANGUAGE) -> DataFrame:
    """``id_col``, the columns ``carry``, ``lang_pred`` and ``score`` (0 to 1), a row per input row.

    Learned are the texts and non-null languages of the rows where ``train_on`` holds (all unless
    given); id, language and other columns are no inputs of a prediction. ``und`` with score 0 is
    given to null texts, texts without a letter, and all texts when nothing could be learned.
    """
    rows = docs if train_on is None else docs.where(train_on)
    languages, weights = fit(training_sample(rows, id_col, text_col, lang_col, per_language))
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    kept = docs.select(id_col, *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    # Letters are looked for in the JVM; the weights (a quarter megabyte a language) go with the tasks.
    return docs.select(id_col, *carry, F.col(text_col).alias("_text"), letters.alias("_letters")).mapInArrow(
        score_batches(languages, weights), f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drop_unidentified(docs: DataFrame, least_score: float = 0.2) -> DataFrame:
    """The rows of ``docs`` with a language: not ``und``, and scored at least ``least_score``."""
    languages, weights = fit(training_sample(docs, "doc_id", "text", "lang", PER_LANGUAGE))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    # The row goes as one column, so no name of its own columns can clash.
    whole = docs.select(F.struct(*docs.columns).alias("row"), letters.alias("_letters"))
    schema = T.StructType([whole.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = whole.mapInArrow(score_batches(languages, weights, docs.columns.index("text")), schema)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
