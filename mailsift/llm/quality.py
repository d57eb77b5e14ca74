"""Quality rules: counted base rules and a hashed n-gram logistic regression with calibrated output.

Features of the model are the presence of byte n-grams (one to four bytes) and of words and word
pairs, each kind hashed to 65,536 bins and scaled to unit length. It is trained on a bounded sample
of labelled rows; a fifth of the sample is held back to calibrate the output (Platt scaling), and
the calibrated probability is held against a fixed threshold. Scoring runs on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mailsift.llm.common import U64, mix, span_hashes, text_slices, word_spans
from mailsift.llm.langid import BINS, presence

SAMPLE_ROWS = 2000  # bound of the training sample
LEAST_PROBABILITY = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50  # words, per cent
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_text(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many of ``mask`` are set between consecutive ``edges``."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[edges])


def base_counts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first_word: np.ndarray,
                words: np.ndarray) -> list[np.ndarray]:
    """The base measures of the texts of a slice, in the order of ``BASE``."""
    n = len(offsets) - 1
    in_word = np.zeros(len(data) + 1, np.int8)
    np.add.at(in_word, starts, 1)
    np.add.at(in_word, ends, -1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    word_chars = _per_text(in_word & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_text(_IS_SYMBOL[data], offsets)

    # Lines: cut at \n and at the ends of texts.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate([offsets[:-1], breaks + 1])
    line_ends = np.concatenate([offsets[1:], breaks])
    line_starts, line_ends = np.sort(line_starts, kind="stable"), np.sort(line_ends, kind="stable")
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(in_word, out=solid[1:])
    has_word = solid[line_ends] > solid[line_starts]
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    text_of_line = np.searchsorted(offsets, line_starts, "right") - 1
    repeated = _seen_before(text_of_line, span_hashes(data, line_starts, line_ends))
    dup_lines = np.bincount(text_of_line[repeated], minlength=n)

    n_words = np.diff(first_word)
    text_of_word = np.repeat(np.arange(n), n_words)
    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        whole = text_of_word[2:] == text_of_word[:-2]
        window = mix(words[:-2] * U64(0x9E3779B97F4A7C15) + mix(words[1:-1] * U64(0xC2B2AE3D27D4EB4F) + words[2:]))
        at = np.flatnonzero(whole)
        key = mix(window[at] + mix(text_of_word[at].astype(np.uint64) + U64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        for shift in range(3):
            covered[hit + shift] = True
    repeat_words = np.bincount(text_of_word[covered], minlength=n)
    return [n_words, word_chars, symbols, dup_lines, repeat_words]


def _seen_before(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    key = mix(value + mix(group.astype(np.uint64) + U64(1)))
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order][1:] == key[order][:-1]
    return out


def word_bins(words: np.ndarray, first_word: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bin)``: the distinct word and word-pair bins of texts ``first`` to ``last``."""
    own = words[first_word[first] : first_word[last]]
    row = np.repeat(np.arange(last - first, dtype=np.int64), np.diff(first_word[first : last + 1]))
    seen = np.zeros((last - first) * BINS, bool)
    seen[row * BINS + (own >> U64(48)).astype(np.int64)] = True
    if len(own) > 1:
        inside = row[1:] == row[:-1]
        pair = mix(own[:-1] * U64(0x9E3779B97F4A7C15) + own[1:]) >> U64(48)
        seen[(row[1:] * BINS + pair.astype(np.int64))[inside]] = True
    at = np.flatnonzero(seen)
    return at // BINS, at % BINS


def _walk(batch_text: pa.Array):
    """For each slice and group of texts: bounds, base measures and both kinds of bins."""
    for at, _, data, offsets in text_slices(batch_text):
        starts, ends, first_word = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        base = base_counts(data, offsets, starts, ends, first_word, words)
        for first, last, row, bin_ in presence(data, offsets, lower=False):
            yield at + first, at + last, [b[first:last] for b in base], (row, bin_), word_bins(words, first_word, first, last)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, _, chars, words in _walk(batch.column(1)):
            packed = []
            for row, bin_ in (chars, words):
                cuts = np.searchsorted(row, np.arange(last - first + 1))
                packed.append([bin_[cuts[i] : cuts[i + 1]].astype(np.uint16).tobytes() for i in range(last - first)])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).slice(first, last - first) for i in (0, 2)], *[pa.array(p, pa.binary()) for p in packed]],
                names=["label", "doc_id", "chars", "words"])


def fit(sample: list[tuple[int, bytes, bytes]], rounds: int = 60, penalty: float = 1e-4) -> tuple[np.ndarray, float, float, float]:
    """Weights of both kinds of bins, bias, and the slope and offset of the calibration."""
    weights = np.zeros(2 * BINS)
    if len({y for y, _, _ in sample}) < 2:
        # One kind of label or none teaches nothing: every text gets the probability of that kind.
        return weights, 0.0, 0.0, 10.0 if not sample or sample[0][0] else -10.0
    sample = sorted(sample)
    held = np.arange(len(sample)) % 5 == 0
    y = np.array([s[0] for s in sample], float)
    columns, values, counts = [], [], []
    for _, chars, words in sample:
        parts = [np.frombuffer(chars, np.uint16).astype(np.int32), np.frombuffer(words, np.uint16).astype(np.int32) + BINS]
        columns += parts
        values += [np.full(len(p), 1 / np.sqrt(max(len(p), 1)), np.float32) for p in parts]
        counts.append(sum(len(p) for p in parts))
    column, value, heads = np.concatenate(columns), np.concatenate(values), np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(sample)), counts)
    # Both labels weigh the same in all.
    share = np.where(y == 1, 0.5 / y[~held].mean(), 0.5 / (1 - y[~held].mean())) * ~held
    bias, m, v = 0.0, np.zeros(2 * BINS + 1), np.zeros(2 * BINS + 1)
    for t in range(1, rounds + 1):
        margin = np.add.reduceat(weights[column] * value, heads) + bias
        slope = share * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / (~held).sum()
        gradient = np.append(np.bincount(column, slope[row] * value, 2 * BINS) + penalty * weights, slope.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    margin = np.add.reduceat(weights[column] * value, heads) + bias
    a, b = 1.0, 0.0
    x, z = margin[held], y[held] * 0.98 + 0.01
    for _ in range(200):  # Newton steps on two parameters
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - z) * x).sum() + 1e-3 * (a - 1), (p - z).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return weights, float(bias), float(a), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[int, bytes, bytes]]:
    """Features of at most ``rows`` labelled texts, drawn by a hash of the id.

    One text is kept of each drawn id, however many rows repeat it: the one of the smallest features.
    """
    drawn = (
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
        .withColumn("draw", F.xxhash64("doc_id", F.lit(7))).orderBy("draw", "doc_id").limit(rows)
    )
    texts = docs.join(F.broadcast(drawn.select("doc_id", F.col("label").cast("int").alias("label"))), "doc_id")
    found = texts.where("text is not null").select("label", "text", F.col("doc_id").cast("long")).mapInArrow(
        _feature_batches, "label int, doc_id long, chars binary, words binary")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct("chars", "words")).alias("x"))
    return [(r["label"], bytes(r["x"]["chars"]), bytes(r["x"]["words"])) for r in one.collect()]


def score_batches(model: tuple[np.ndarray, float, float, float], least: float):
    weights, bias, a, b = model
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, base, chars, words in _walk(batch.column(1)):
                n, margin = last - first, np.full(last - first, bias)
                for shift, (row, bin_) in enumerate((chars, words)):
                    size = np.maximum(np.bincount(row, minlength=n), 1)
                    margin += np.bincount(row, weights[bin_ + shift * BINS], n) / np.sqrt(size)
                p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
                n_words, repeat = base[0], base[4]
                failed = (n_words < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * n_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), *[pa.array(x.astype(np.int64)) for x in base],
                     pa.array(failed), pa.array(~failed & (p >= least)), pa.array(p)],
                    names=["doc_id", *BASE, "base_failed", "kept", "probability"])

    return run


def quality_verdicts(docs: DataFrame, labels: DataFrame, least: float = LEAST_PROBABILITY) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, ``kept`` and ``probability``, a row per row of ``docs``.

    A text of under 50 words, or with over half its words in repeated three-word windows, fails the
    base rules (null text has no words). Of the others those are kept whose calibrated probability
    of good quality is at least ``least``. Without labels, or with only one kind, the model agrees
    with the only kind seen, or keeps. Several labels of one document count as the best of them.
    """
    model = fit(labelled_sample(docs, labels))
    schema = "doc_id long, " + "".join(f"{c} long, " for c in BASE) + "base_failed boolean, kept boolean, probability double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score_batches(model, least), schema)
