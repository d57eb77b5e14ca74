"""The pipeline: stages keep the columns of documents, and each does its work on what it is given."""

import itertools
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from mailsift.llm import langid, ngram_join, packing
from mailsift.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert sorted(docs.columns) == sorted(columns)
        if name in ("language", "exact_dedup", "near_dedup"):
            assert 0 < docs.count() <= before.count()
        if name == "near_dedup":
            again = ngram_join.near_duplicates(docs, 5, 80)
            assert again.where("doc_id <> component_id").count() == 0
    assert docs.where(F.col("n_words") > packing.CAPACITY).count() == 0
    assert docs.agg(F.sum("n_words")).first()[0] > 0


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_shingles(text, k=5):
    found = plain_words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))} if found else set()


def test_decisions_equal_plain_ones(spark):
    """Each dropping stage against a plain version on the rows it was given, on awkward rows too."""
    docs = table(spark, SF, "documents")
    text = docs.where("length(text) > 400").orderBy("doc_id").first().text
    odd = [(None, text), (None, "le la les une de que pour dans"), (9001, text), (9001, text), (9002, text + " more"), (9003, None),
           (9004, ""), (9005, "12 34"), (9006, text.replace(" ", "\n")), (9007, text.upper())]
    more = spark.createDataFrame([(i, t, None, None, 0) for i, t in odd], docs.schema)
    docs = stored(docs.unionByName(more), "test-awkward")
    known = docs
    for name, stage in corpus_pipeline.STAGES:
        before, known = known, stored(stage(spark, known, SF), f"test-plain-{name}")
        given = before.collect()
        if name == "language":
            told = langid.identify_languages(before).collect()
            want = sorted(str(r.doc_id) for r in told if r.lang_pred != "und" and r.score >= 0.2)
            assert sorted(str(r.doc_id) for r in known.collect()) == want
            assert not {"9003", "9004", "9005"} & set(want)
        elif name == "exact_dedup":
            first = {}
            for r in sorted(given, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
            assert sorted(map(str, (r.doc_id for r in known.collect()))) == sorted(map(str, first.values()))
        elif name == "near_dedup":
            sets = {r.doc_id: plain_shingles(r.text) for r in given if r.doc_id is not None}
            low = {i: i for i in sets}

            def root(i):
                while low[i] != i:
                    i = low[i]
                return i

            for a, b in itertools.combinations(sorted(sets), 2):
                x, y = sets[a], sets[b]
                if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y) > 0:
                    p, q = sorted((root(a), root(b)))
                    low[q] = p
            want = sorted(i for i in sets if root(i) == i)
            assert sorted(r.doc_id for r in known.collect() if r.doc_id is not None) == want
        elif name == "mixing":
            texts = {(r.doc_id, r.text) for r in given}
            taken = Counter((r.doc_id, r.text) for r in known.collect())
            assert set(taken) <= texts and max(taken.values()) <= 2
        else:
            bins = known.collect()
            assert Counter(w for r in bins for w in r.text.split()) == Counter(w for r in given for w in plain_words(r.text))
            assert all(len(r.text.split()) == r.n_words <= packing.CAPACITY for r in bins)


def test_stages_take_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-empty-{name}")
        assert docs.count() == 0


def test_memory_of_a_language_batch_is_bounded():
    """A batch is scored in little more memory than one small slice of it needs."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 3_000))) for _ in range(1_200)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array(texts), pa.array([True] * len(texts))], names=["doc_id", "text", "letters"])
    weights = rng.random((langid.BINS + 1, 4)).astype(np.float32)
    score = langid.score_batches(["a", "b", "c", "d"], weights)
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in score(iter([batch]))) == len(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 << 20


def test_stages_ask_for_small_arrow_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = table(spark, SF, "documents").limit(0)
    before = spark.conf.get(name)
    try:
        for _, stage in corpus_pipeline.STAGES[:2]:
            spark.conf.set(name, "64m")
            stage(spark, docs, SF)
            assert int(spark.conf.get(name).rstrip("b")) <= 1 << 20
    finally:
        spark.conf.set(name, before)
