"""The corpus operators against brute force, round trips, held-out accuracy and awkward rows."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.llm import (
    chat, exact_dedup, html_extract, langid, licenses, mixing, ngram_join, packing, pii, quality, queries,
)
from mailsift.llm.common import split_by_bitmap

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, row long, at string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, sources=None):
    """Documents with extra columns whose names clash with internal ones."""
    sources = sources or [None] * len(texts)
    return spark.createDataFrame(
        [(i, t, "en", s, None, 5, 6, "x") for i, (t, s) in enumerate(zip(texts, sources))], DOCS)


def words(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def awkward(spark):
    long_text = " ".join(words(9, 60_000, 5000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "one two three"),
            (7, long_text), (8, long_text), (9, "été <x> 1.2.3.4 a@b.co"), (None, None)]
    return spark.createDataFrame([(i, t, None, None, None, 5, 6, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ---- n-gram join ----------------------------------------------------------------------------


def shingles(text, k):
    found = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(found) < k:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)}


def brute_groups(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    low = list(range(len(texts)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            low[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_join_equals_all_pairs(spark, k, percent):
    draw, texts = random.Random(k), [None, "", " \t", "A b", "a B", "one"]
    passage = words(77, 40)
    for seed in range(25):
        base = words(seed, draw.choice([5, 12, 40, 150, 600]))
        texts.append(" ".join(base))
        for _ in range(4):
            other = list(base)
            for _ in range(draw.randrange(1, 2 + len(base) // 25)):
                other[draw.randrange(len(other))] = f"x{draw.randrange(50)}"
            texts.append("  ".join(other).upper())
        texts.append(" ".join(passage + words(seed + 100, 60)))
    found = ngram_join.near_duplicates(docs_of(spark, texts), k, percent).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == brute_groups(texts, k, percent)


def test_join_awkward_rows(spark, awkward, nothing):
    found = sorted(map(tuple, ngram_join.near_duplicates(awkward).collect()), key=str)
    assert len(found) == 11
    assert {(r[0], r[2]) for r in found} == {
        (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (7, 7), (8, 7), (9, 9), (None, None)}
    assert ngram_join.near_duplicates(nothing).count() == 0
    kept = ngram_join.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 7, 9]


# ---- exact duplicates -----------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_groups(spark, bits):
    """Four-bit chunk hashes collide all the time; identifiers stay verified."""
    texts = [None, "", "a  b", "a\n\tb", "a b ", "c", "C"] + [" ".join(words(i % 7, 3000)) for i in range(20)]
    found = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs_of(spark, texts), bits=bits).collect()}
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, text in enumerate(plain):
        r = found[i]
        assert r.keep_id == plain.index(text) and r.kept == (r.keep_id == i)
        assert r.group_size == plain.count(text)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_awkward_rows(awkward, nothing):
    found = exact_dedup.exact_duplicates(awkward).collect()
    assert len(found) == 11 and exact_dedup.exact_duplicates(nothing).count() == 0
    assert sum(r.kept for r in found if r.doc_id in (4, 5)) == 1
    kept = exact_dedup.drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 7, 9]


def test_rows_are_split_by_a_bitmap(spark):
    """What passes for sure is in no id; every id's row is left to the join, repeated and null keys too."""
    rows = spark.range(0, 5000, 1, 7).select(F.when(F.col("id") % 11 > 0, F.col("id") % 700).alias("doc_id"), F.lit("x").alias("row"), F.lit("y").alias("p"))
    for ids in ([], [None, 5, 5, 9], list(range(0, 700, 3)), list(range(700))):
        sure, perhaps = split_by_bitmap(rows, F.col("doc_id"), spark.createDataFrame([(i,) for i in ids], "n long"), F.col("n"))
        assert sure.columns == perhaps.columns == rows.columns and sure.count() + perhaps.count() == 5000
        assert not {r.doc_id for r in sure.collect()} & set(ids)
        assert perhaps.count() <= sum(5000 / 700 * 2 for _ in ids) + 600 and (ids or perhaps.count() == 0)


# ---- mixing ---------------------------------------------------------------------------------


def test_mix_meets_targets_and_reruns_agree(spark):
    found = queries.op5_mixing(spark, SF)
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(map(tuple, queries.op5_mixing(spark, SF).collect()))
    assert all(0 <= r[4] <= 2 * r[1] for r in rows)
    by_source = {}
    for _, size, source_size, target, taken in rows:
        held = by_source.setdefault((source_size, target), [0, 0])
        held[0], held[1] = held[0] + taken, max(held[1], size)
    for (source_size, target), (taken, largest) in by_source.items():
        assert target <= 2 * source_size + 1e-6
        assert abs(taken - target) <= max(2 * largest, 0.02 * target)


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, top=2.0):
    """Excess shared again and again until no source is above its stop."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > top * sizes[s]}
        for s in over or open_:
            target[s] = top * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return target


def test_targets_equal_shared_excess(spark):
    draw = random.Random(6)
    for n in (1, 2, 5, 9):
        sizes = {f"s{i}" if i else None: draw.choice([0, 3, 50, 4000]) + 1 for i in range(n)}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        found = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        want = plain_targets(sizes)
        assert found.keys() == want.keys() and all(abs(found[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_balance_of_both_totals(spark):
    """Words and documents of each source come near their expectation."""
    draw = random.Random(7)
    texts = [" ".join(["w"] * draw.randrange(1, 90)) for _ in range(3000)]
    docs = docs_of(spark, texts, [draw.choice("aaaaab") for _ in texts])
    found = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("_copies").alias("n"), F.sum(F.col("_copies") * F.col("_size")).alias("words"), F.count("*").alias("docs"),
        F.first("_target").alias("target"), F.first("_source_size").alias("size")).collect()
    for r in found:
        assert abs(r.words - r.target) <= 180 and abs(r.n - r.docs * r.target / r.size) <= 3


def test_equal_rows_are_dealt_out_and_numbered(spark):
    docs = spark.range(0, 20_000, 1, 6).select(F.lit(4).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = mixing.numbered(docs.withColumn("at", F.monotonically_increasing_id()).withColumn("draw", F.lit(1)), "draw", "at")
    assert sorted(r.number for r in rows.collect()) == list(range(20_000))
    draws = rows.select(F.xxhash64("draw", "number").alias("draw"))
    blocks = draws.groupBy(F.pmod(F.xxhash64("draw", F.lit(0)), F.lit(5))).count().collect()
    assert len(blocks) == 5 and max(r["count"] for r in blocks) < 4500
    assert abs(mixing.mix_sources(docs).agg(F.sum("_copies")).first()[0] - 30_000) <= 2


def test_mix_awkward_rows(awkward, nothing):
    found = mixing.mix_sources(awkward).collect()
    assert len(found) == 11 and all(r["_copies"] == 0 for r in found if r["_size"] == 0)
    assert all(0 <= r["_copies"] <= 2 for r in found)
    assert mixing.take_mix(awkward).columns == awkward.columns
    assert mixing.mix_sources(nothing).count() == 0 and mixing.take_mix(nothing).count() == 0


# ---- packing --------------------------------------------------------------------------------


def test_best_fit_is_the_tightest_compatible_bin():
    draw = random.Random(3)
    items = sorted(((draw.randrange(1, 60), draw.randrange(3), draw.randrange(20)) for _ in range(400)), reverse=True)
    found = packing.best_fit(*map(list, zip(*items)), 100, 2)
    bins = []
    for (size, source, cluster), got in zip(items, found):
        fits = [i for i, b in enumerate(bins) if 100 - sum(x[0] for x in b) >= size
                and all(x[2] != cluster for x in b) and sum(x[1] == source for x in b) < 2]
        room = {i: 100 - sum(x[0] for x in bins[i]) for i in fits}
        if fits:
            assert got in fits and room[got] == min(room.values())
        else:
            assert got == len(bins)
            bins.append([])
        bins[got].append((size, source, cluster))


def check_bins(docs, bins, capacity=packing.CAPACITY, per_source=packing.PER_SOURCE):
    """Every word once and in order, no two pieces of equal texts and no crowd of a source in a bin."""
    bins = bins.collect()
    rows = docs.collect()
    source_of, text_of = {r.doc_id: r.source for r in rows}, {r.doc_id: (r.text or "").split() for r in rows}
    assert len({r.bin_id for r in bins}) == len(bins)
    for r in bins:
        pieces = r.text.split("\n")
        assert len(pieces) == len(r.doc_ids) and r.n_words == len(r.text.split()) <= capacity
        counts = {}
        for i in r.doc_ids:
            counts[source_of[i]] = counts.get(source_of[i], 0) + 1
        assert max(counts.values()) <= per_source
        whole = [tuple(text_of[i]) for i in r.doc_ids]
        assert len(set(whole)) == len(whole)
    assert sorted(w for r in bins for w in r.text.split()) == sorted(w for r in rows for w in (r.text or "").split())


def test_texts_are_packed_in_one_move(spark, nothing):
    texts = [" ".join(words(i, n)) for i, n in enumerate([3, 5000, 2048, 2049, 700, 0, 1300, 1] + [90] * 60)] + [None] + ["same text"] * 40
    docs = docs_of(spark, texts, [None if i % 5 == 0 else "abc"[i % 3] for i in range(len(texts))])
    check_bins(docs, packing.pack_texts(docs))
    check_bins(docs, packing.pack_texts(docs, capacity=50, block_pieces=16), 50)
    repeated = docs.unionByName(docs)
    bins = packing.pack_texts(repeated).agg(F.sum("n_words")).first()[0]
    assert bins == 2 * sum(len((t or "").split()) for t in texts)
    assert packing.pack_texts(nothing).count() == 0
    assert packing.pack_texts(docs)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_packing_takes_very_many_partitions(spark):
    docs = docs_of(spark, [" ".join(words(i, 3000 if i % 7 == 0 else 5)) for i in range(30)]).repartition(2000, "doc_id")
    placed = packing.pack_documents(docs)
    assert placed.agg(F.sum("n_words")).first()[0] == sum(3000 if i % 7 == 0 else 5 for i in range(30))
    whole = placed.where("n_words = 2048")
    assert whole.count() == whole.select("bin_id").distinct().count() == 5 and whole.where("bin_id >= 0").count() == 0


def test_packed_bins_hold_every_word_once(spark, awkward, nothing):
    texts = [" ".join(words(i, n)) for i, n in enumerate([3, 5000, 2048, 2049, 700, 0, 1300, 1])] + [None]
    docs = docs_of(spark, texts, ["a", "a", "b", None, "b", "a", None, "c", "c"])
    placed = packing.pack_documents(docs)
    got = placed.groupBy("doc_id").agg(F.sum("n_words")).collect()
    assert {r[0]: r[1] for r in got} == {i: len((t or "").split()) for i, t in enumerate(texts)}
    bins = packing.assemble(docs, placed).collect()
    assert all(len(r.text.split()) == r.n_words <= packing.CAPACITY for r in bins)
    assert sorted(w for r in bins for w in r.text.split()) == sorted(w for t in texts for w in (t or "").split())
    placed = packing.pack_documents(awkward).where("bin_id is not null")
    assert placed.groupBy("bin_id", "cluster").count().where("count > 1").count() == 0
    assert packing.pack_documents(nothing).count() == 0


# ---- personal data --------------------------------------------------------------------------


def test_base_spans():
    text = "é a.b@c.org, 10.0.0.256 10.0.0.255 , 4111 1111 1111 1111, 4111111111111112, +49 (30) 1234-567"
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.base_spans(text)] == [
        ("email", "a.b@c.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234-567")]
    assert pii.base_spans("") == []


PATTERNS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(re.sub("[^0-9]", "", t)) <= 19 and plain_luhn(re.sub("[^0-9]", "", t))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
)


def plain_luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def test_base_spans_equal_the_patterns():
    draw = random.Random(9)
    pieces = ["1", "23", "255", "256", ".", "..", "@", "a", "b.c", "-", " ", "+", "+4", "(", ")", "4111 1111 1111 1111", "x@y.z", "1.2.3.4", "é", "\n", "0", "000"]
    for _ in range(20_000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 14)))
        want = [(k, m.start(), m.end()) for k, (pattern, fits) in enumerate(PATTERNS) for m in re.finditer(pattern, text) if fits(m[0])]
        assert pii.base_spans(text) == want, repr(text)


def test_long_runs_take_linear_time():
    for text in ("7" * 1_000_000, "a" * 1_000_000, "1." * 500_000, "a@" * 300_000, "+1" * 300_000, "+1" + "(" * 500_000, "a1" * 500_000, "1.2.3.x" * 100_000):
        began = time.perf_counter()
        graph = pii.Graph()
        graph.add(0, text, pii.base_spans(text))
        assert time.perf_counter() - began < 5, text[:10]


def enumerated(graph, weights):
    n, k = len(graph.place), len(pii.LABELS)
    total = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        score = 0.0
        for i, y in enumerate(labels):
            score += weights.token[y, graph.features[i]].sum() + weights.token[y, pii.BINS]
            fixed = graph.label[i]
            score += pii.CLAMP * (fixed != 0 and y == max(fixed, 0))
        score += sum(weights.move[labels[a], labels[b]] for a, b in graph.chain)
        score += sum(weights.same[labels[a]] * (labels[a] == labels[b]) for a, b in graph.skip)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_marginals_equal_enumeration(monkeypatch):
    draw = np.random.default_rng(4)
    monkeypatch.setattr(pii, "ROUNDS", 60)
    for edges, loose in (([(0, 1), (1, 2), (2, 3)], 1e-6), ([(0, 1), (0, 2), (0, 3)], 1e-6), ([(0, 1), (1, 2), (2, 0)], 0.08)):
        for _ in range(5):
            graph = pii.Graph()
            graph.place, graph.label = [(0, i, i + 1) for i in range(4)], [0, int(draw.integers(-1, 5)), 0, 0]
            graph.features = draw.integers(0, pii.BINS, (4, pii.FEATURES)).tolist()
            split = int(draw.integers(0, len(edges) + 1))
            graph.chain, graph.skip = edges[:split], edges[split:]
            weights = pii.Weights(draw.normal(size=(5, pii.BINS + 1)) * 0.3, draw.normal(size=(5, 5)) * 0.5, draw.normal(size=5) * 0.5)
            assert np.abs(pii.marginals(graph, weights) - enumerated(graph, weights)).max() < loose


def test_the_field_is_trained(monkeypatch):
    """Skip weights are learned: tokens without telling features take the label of what they repeat."""
    draw = np.random.default_rng(2)
    n = 400
    labels = np.repeat(draw.integers(0, 5, n // 2), 2)
    features = np.where(np.arange(n)[:, None] % 2 == 0, labels[:, None] + 10, 99) * np.ones((1, pii.FEATURES), int)
    skip = np.arange(n).reshape(-1, 2)
    chain = np.zeros((0, 2), np.int64)
    weights = pii.fit_weights(features, labels, chain, skip)
    assert (weights.same > 0.5).all()
    graph = pii.Graph()
    graph.place, graph.label = [(0, i, i + 1) for i in range(n)], [0] * n
    graph.features, graph.skip = features.tolist(), skip.tolist()
    assert (pii.marginals(graph, weights).argmax(axis=1) == labels).mean() > 0.95


def test_similar_tokens_are_linked():
    graph = pii.Graph()
    graph.add(0, "call 555-0199-77 or 555.0199.77 or 555-0198-77, not 12 and not word9x word8x", [])
    linked = {tuple(graph.place[i][1] for i in e) for e in graph.skip}
    text = "call 555-0199-77 or 555.0199.77 or 555-0198-77, not 12 and not word9x word8x"
    assert (text.index("555-0199"), text.index("555.")) in linked and (text.index("555-0199"), text.index("555-0198")) in linked
    assert (text.index("word9x"), text.index("word8x")) in linked


def test_planted_repeats_are_found(spark):
    """Card and phone numbers that come again in a form no pattern matches; texts without any stay so."""
    draw = random.Random(3)
    texts, want = [], {}
    for i in range(400):
        words = [f"word{draw.randrange(300)}x" if draw.random() < 0.03 else draw.choice(["la", "de", "the", "und"]) for _ in range(60)]
        if i % 2:
            number = "+49" + "".join(str(draw.randrange(10)) for _ in range(9))
            words[5], again = number, f"{number[1:3]}/{number[3:6]}/{number[6:]}"
            if i % 8 == 1:  # some come again as they are
                words[20] = number
            words[40] = again
            want[i] = again
        texts.append(" ".join(words))
    docs = docs_of(spark, texts)
    found = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    caught = 0
    for i, text in enumerate(texts):
        added = [x for x in found[i].spans.split(",") if x]
        if i in want:
            a = text.index(want[i])
            caught += f"phone:{a}:{a + len(want[i])}" in added
        else:
            assert not added
    assert caught >= 0.9 * len(want)


def test_added_spans_keep_the_base(spark, awkward, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = pii.find_personal_data(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        spans = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) | {""}
    rows = pii.find_personal_data(awkward).collect()
    assert len(rows) == 11 and {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows}[9] == (1, 1, 0, 0)
    assert all(r.spans == "" and r.n_email == r.n_ip == r.n_card == r.n_phone == 0 for r in rows if r.doc_id in (1, 2, 3, 4, 5))
    assert pii.find_personal_data(nothing).count() == 0


# ---- language, quality ----------------------------------------------------------------------


def test_language_on_held_out_rows(spark, awkward, nothing):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op6_language(spark, SF).join(lang, "doc_id").collect()
    held = [r for r in found if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    found = langid.identify_languages(awkward).collect()
    assert len(found) == 11 and {r.lang_pred for r in found} == {"und"}
    assert langid.identify_languages(nothing).count() == 0
    assert langid.drop_unidentified(awkward).count() == 0


def test_quality_counts_and_verdicts(spark, awkward, nothing):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = {r.doc_id: r for r in quality.quality_verdicts(docs, labels).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        r, tokens = found[i], WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = [tuple(tokens[j : j + 3]) for j in range(len(tokens) - 2)]
        often = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
        repeated = {j + o for j, g in enumerate(grams) if g in often for o in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(tokens), sum(map(len, tokens)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(tokens) < 50 or 100 * len(repeated) > 50 * len(tokens))
        assert not (r.base_failed and r.kept)
    assert quality.quality_verdicts(awkward, labels.limit(0)).count() == 11
    assert quality.quality_verdicts(nothing, labels).count() == 0


def test_quality_sample_has_one_text_of_an_id(spark):
    docs = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    docs = docs.union(spark.range(100, 400).select("id", F.concat(F.lit("good text "), F.col("id"))))
    labels = spark.range(0, 400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")).union(
        spark.range(7, 8).select("id", F.lit(0)))
    sample = quality.labelled_sample(docs, labels, rows=400)
    assert len(sample) == 301 and len(quality.labelled_sample(docs, labels, rows=50)) <= 50


def test_every_language_is_learned(spark):
    """300 languages of which some have a handful of texts, and one id that very many rows repeat."""
    draw = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèñçøåßабвгдежзиклмнопрст"
    rows = []
    for k in range(300):
        own = ["".join(draw.choice(letters) for _ in range(4)) for _ in range(12)]
        rows += [(k * 100 + i, " ".join(draw.choice(own) for _ in range(40)), f"l{k}") for i in range(3 + k % 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify_languages(docs, carry=["lang"]).collect()
    assert len({r.lang_pred for r in found}) == 300
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    twins = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    more = spark.range(1000, 3000).select("id", F.concat(F.lit("mot "), F.col("id")), F.lit("fr"))
    sample = langid.training_sample(twins.union(more), "doc_id", "text", "lang", 50)
    assert sorted(l for l, _ in sample) == ["en"] + ["fr"] * 50


def test_stages_keep_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns(
        {c: F.lit("mine") for c in ("score", "lang_pred", "_copies", "_copy", "row", "sha", "twin", "p", "page", "bitmap", "_size", "_text", "k", "c", "d")})
    for stage in (langid.drop_unidentified, exact_dedup.drop_exact_duplicates, ngram_join.keep_one_of_each, mixing.take_mix):
        kept = stage(docs)
        assert kept.columns == docs.columns and kept.where("score = 'mine' and _copies = 'mine' and row = 'mine'").count() == kept.count() > 0


# ---- pages, licences, chat ------------------------------------------------------------------


def test_main_text_of_pages(spark):
    long = "A sentence, with commas, that goes on for a while, so that it counts as running text here. " * 3
    page = (f"<html><head><title>T</title><script>var x</script></head><body><nav><a href=x>Menu</a></nav>"
            f"<article><h1>Head &amp; more</h1><p>{long}</p><p>{long}</p></article>"
            f"<div class='comments'><p>First comment here</p></div><footer>Imprint</footer></body></html>")
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (3, "v", ""), (None, "w", "<p>Only <b>this"), (6, "x", "<" * 5000)]
    found = html_extract.extract_pages(
        spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    by_id = {r.page_id: r for r in found}
    assert len(found) == 6 and all(r.n_chars == len(r.text) for r in found)
    assert by_id[1].text == "\n".join(["Head & more", long.strip(), long.strip()])
    assert by_id[2].text == by_id[3].text == ""
    assert html_extract.extract_pages(
        spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "A sentence, with commas, that goes on for a while, so that it counts as running text here."


@pytest.mark.parametrize("page, want", [
    (f"<div class='content has-sidebar'><p>{LONG}</p></div>", [LONG]),
    (f"<body><div class='page no-comments'><h2>Title</h2><p>{LONG}</p><p>Short.</p></div></body>", ["Title", LONG, "Short."]),
    (f"<div class='post'><p>{LONG}</p></div><div class='site-footer'><p>{LONG} Imprint.</p></div>", [LONG]),
    (f"<div class='widget'><p>{LONG}</p></div><div class='ad'>Buy</div>", [LONG]),
    (f"<div class='promo'><div class='ads'>x</div><p>{LONG}</p></div>", [LONG]),
    (f"<form id='aspnetForm'><div><p>{LONG}</p><input value=x></div></form>", [LONG]),
    (f"<div><p>{LONG}</p></div><form><p>Your name please, so that we can write to you</p></form>", [LONG]),
    (f"<script>İ</script><p>{LONG}</p><SCRIPT>x</ScRiPt><p>{LONG}İ</p>", [LONG, LONG + "İ"]),
    (f"<body><h1>Head</h1><div><p>{LONG}</p><p>{LONG}</p></div><p>End of it.</p></body>", ["Head", LONG, LONG, "End of it."]),
    (f"<body><h1>Head</h1><div><div><p>{LONG}</p><p>{LONG}</p></div></div></body>", ["Head", LONG, LONG]),
    (f"<article><p>{LONG}</p><h2>References</h2><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></article>",
     [LONG, "References", "One", "Two", "Three"]),
    (f"<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul><div><p>{LONG}</p></div>", [LONG]),
    (f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p><p>{LONG}</p></div></article>", [LONG]),
    (f"<article><p>{LONG}&nbsp;&amp;<br>x</p>text <b>bold</b>\n beside<aside>no</aside>after</article>", [LONG + " & x", "text bold beside", "after"]),
])
def test_main_text_of_odd_pages(page, want):
    assert html_extract.main_text(page) == "\n".join(want)


def plain_page(draw):
    """A page and its main text, written together."""
    words = lambda n: " ".join(draw.choice(["alpha", "beta,", "gamma", "delta.", "épsilon"]) for _ in range(n))
    blocks, html = [], []
    for _ in range(draw.randrange(2, 9)):
        tag = draw.choice(["p", "p", "p", "h2", "li", "blockquote"])
        text = words(draw.randrange(3, 60) if tag != "p" else draw.randrange(12, 60))
        blocks.append(text)
        body = text.replace(" ", draw.choice([" ", "  ", "\n ", "<b> </b>", "&#32;"]), 1)
        html.append(f"<ul><li>{body}</ul>" if tag == "li" else f"<{tag}>{body}</{tag}>")
        if draw.random() < 0.3:
            html.append(draw.choice(["<div class=ad>Buy this now, please</div>", "<script>if (a<b) x='<p>'</script>", "<!-- <p>no</p> -->",
                                     "<form><input><button>Go</button></form>", "<aside>See also this</aside>"]))
    wrap = draw.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div id=wrap><article class='post has-comments'>{}</article></div>"])
    noise = ["<nav><a href=1>Home</a><a href=2>News</a></nav>", "<div class='cookie-notice'><p>We use cookies, and more of them, on all of our pages.</p></div>",
             "<header><h1>Site</h1></header>", f"<footer><p>{words(30)}</p></footer>", f"<div class='sidebar'><p>{words(25)}</p></div>"]
    draw.shuffle(noise)
    k = draw.randrange(len(noise))
    return "<html><body>" + "".join(noise[:k]) + wrap.format("".join(html)) + "".join(noise[k:]) + "</body></html>", "\n".join(blocks)


def test_main_text_of_made_pages():
    draw = random.Random(12)
    for _ in range(300):
        page, want = plain_page(draw)
        assert html_extract.main_text(page) == want, page


def test_pages_of_any_shape_take_linear_time():
    for page in ("<script>x</script>" * 100_000, "İ<SCRIPT>x</script>" * 50_000, "<div class=ad>" * 20_000 + LONG, "<div>" * 20_000 + LONG,
                 f"<p>{LONG}</p>" * 20_000, "<p" * 50_000, "<!--" * 50_000, "<a href='" * 20_000):
        began = time.perf_counter()
        html_extract.main_text(page)
        assert time.perf_counter() - began < 15, page[:40]


def test_licences_inherit_from_the_nearest_directory(spark, nothing):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "nothing"), (3, "a/b/c/y.txt", None),
            (4, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
            (5, "z/q.txt", ""), (6, None, "Licensed under the Apache License, Version 2.0."), (None, None, None)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    found = {r.doc_id: (r.license, r.origin, r.from_dir) for r in licenses.scan_licenses(files).collect()}
    assert found[2][:2] == ("MIT", "inherited") and found[3][:2] == ("GPL-3.0", "inherited")
    assert found[1][:2] == ("MIT", "own") and found[6][:2] == ("Apache-2.0", "own")
    assert found[5][1] == found[None][1] == "none"
    assert licenses.scan_licenses(nothing.withColumn("path", F.lit("a/b"))).count() == 0


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<\\|im_end|>\n", "a\n<|im_start|>assistant\nx", None, "", "<\\\\|", "\\", "é\U0001F600"]
    rows = [(7, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)] + [(8, None, None, None)]
    messages = chat.conversation_messages(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r.tree: r for r in chat.read_back(chat.format_trees(messages, top=1)).collect()}
    assert [t.text for t in found[7].turns] == [t or "" for t in odd]
    assert list(filter(None, found[7].loss_texts)) == [t for t in odd[1::2] if t]
    assert [(t.role, t.text) for t in found[8].turns] == [("", "")]
    assert chat.format_trees(messages.limit(0), top=1).count() == 0


def test_reply_trees_give_every_root_to_leaf_path(spark):
    rows = [("t", "1", None, 0.0), ("t", "2", "1", 1.0), ("t", "3", "1", 5.0), ("t", "4", "2", 9.0), ("t", "5", "3", 1.0)]
    messages = spark.createDataFrame(rows, "tree string, id string, parent string, score double").withColumns(
        {"role": F.lit("user"), "text": F.col("id")})
    found = chat.read_back(chat.format_trees(messages)).orderBy("rank").collect()
    assert [[t.text for t in r.turns] for r in found] == [["1", "2", "4"], ["1", "3", "5"]]
