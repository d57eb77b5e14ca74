"""Fill-in-the-middle, token records and hard negatives against plain versions and awkward rows."""

import hashlib
import itertools
import pathlib
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailsift.llm import fim, hard_negatives, queries, token_records
from mailsift.session import scratch_path

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, id long, form string, output string, n string, deal string, at string"
ODD = [None, "", " ", "\n", "a", "é", "one two", "a<P>b", "<S", "x<M>", "<", "<P", "\U0001F600 ab  cd", "ab1" * 9, "Z" * 5000, "<<S", "M>a <"]


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, 7, "x", "x", "x", "x", "x") for i, t in rows], DOCS)


# ---- fill in the middle ---------------------------------------------------------------------


def plain_fim(row_id, text):
    units, at = [], 0
    while at < len(text):
        end = at + 1
        while re.match("[A-Za-z]", text[at]) and end < len(text) and re.match("[A-Za-z]", text[end]):
            end += 1
        units.append(text[at:end])
        at = end
    told = hashlib.sha256(f"1:{'' if row_id is None else row_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(told[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fim_equals_a_plain_version_and_is_undone(spark):
    draw = random.Random(5)
    texts = ODD + ["".join(draw.choice("ab Z<PSM>1é\n") for _ in range(draw.randrange(60))) for _ in range(300)]
    rows = [*enumerate(texts), (3, "twin"), (3, "twin"), (None, "no id here"), (None, None)]
    found = fim.fill_in_middle(docs_of(spark, rows)).withColumn("again", fim.restored())
    got = sorted((tuple(r)[:-1] for r in found.collect()), key=str)
    assert got == sorted(((i, *plain_fim(i, t or "")) for i, t in rows), key=str)
    assert sorted(r.again for r in found.collect()) == sorted(t or "" for _, t in rows)
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs_of(spark, [])).count() == 0


def test_fim_keeps_every_repetition_of_a_long_text():
    text = "word 12, " * 120_000
    ends = fim.unit_ends(text, regex.compile(f"({fim.UNIT})*+"))
    assert len(ends) == 6 * 120_000 and ends[-1] == len(text)
    assert len(fim.unit_ends("x" * 2_000_000, regex.compile(f"({fim.UNIT})*+"))) == 1


def test_fim_does_not_shuffle(spark):
    plan = fim.fill_in_middle(docs_of(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


# ---- token records --------------------------------------------------------------------------


def encoded(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def test_pieces_encode_like_whole_texts(tokenizer, monkeypatch):
    encode = token_records.PieceEncoder(pathlib.Path(TOKENIZER).read_text())
    assert encode._in_pieces
    draw = random.Random(2)
    pieces = ["Don't", "DON'T", "we'Ll", "'re", "'r", "!'s", "é", "e\u0301", "\u0301x", " ", "\u00a0", "\u2003", "\u212a", "İ", "ΣΑΣ", "a'", "'s", "'S",
              "<|endoftext|>", "x<|startoftext|>y", "<|endoftext", "42", "ﬁ", "日本", "\U0001F600", "--", "\x1c", "\x00", "\x7f", "\x85", "a1b2", "$$$"]
    texts = ["", " ", "y" * 4000, *ODD[1:]] + [
        "".join(draw.choice(pieces) + draw.choice(["", "", " ", "\n", "\t \r\n", "\u3000"]) for _ in range(12)) for _ in range(3000)]
    for size in (1 << 20, 3):
        monkeypatch.setattr(token_records, "SLICE_CHARS", size)
        for text in texts:
            assert np.frombuffer(encode(text), "<u4").tolist() == encoded(tokenizer, text)[:-1], repr(text)
    monkeypatch.setattr(token_records, "CACHED", 40)
    assert all(np.frombuffer(encode(t), "<u4").tolist() == encoded(tokenizer, t)[:-1] for t in texts[:300])


def test_long_texts_without_spaces_take_linear_time():
    encode = token_records.PieceEncoder(pathlib.Path(TOKENIZER).read_text())
    for unit in ("a1", "é", "x", "!a"):
        began = time.perf_counter()
        assert encode(unit * 200_000)
        assert time.perf_counter() - began < 20


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, plain = token_records.PieceEncoder(pathlib.Path(path).read_text()), Tokenizer.from_file(path)
    for text in ODD[1:]:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert not encode._in_pieces and token_records.id_width(pathlib.Path(path).read_text(), 2) == 2


@pytest.mark.parametrize("file_bytes, end_id", [(200, 2), (1 << 20, 2), (1 << 20, 70_000)])
def test_records_read_back(spark, tokenizer, file_bytes, end_id):
    rows = [(i * 3 - 9, t) for i, t in enumerate(ODD)] + [(4, "twin twin"), (4, "twin twin"), (4, "other"), (None, "none"), (None, None), (-(1 << 63), "low")]
    path = scratch_path(spark, "test-records")
    index = token_records.write_records(docs_of(spark, rows), path, TOKENIZER, end_id, file_bytes=file_bytes)
    assert index.count() == len(rows)
    read = sorted(token_records.read_records(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in read:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    keys = [(r.id is not None, r.id or 0) for r in read]
    assert keys == sorted(keys)
    want = sorted(((i, struct.pack(f"<{len(x)}I", *x)) for i, x in ((i, encoded(tokenizer, t)[:-1] + [end_id]) for i, t in rows)), key=str)
    assert sorted(((r.id, bytes(r.ids)) for r in read), key=str) == want
    first, again, other = (token_records.read_shuffled(spark, path, s, 3).collect() for s in (1, 1, 2))
    assert first == again and [r.id for r in first] != [r.id for r in other]
    assert sorted(((r.id, bytes(r.ids)) for r in first), key=str) == want


def test_one_id_fills_several_files(spark):
    rows = [(5, "same words in every row") for _ in range(4000)] + [(i, "x") for i in range(100)]
    path = scratch_path(spark, "test-hot-id")
    index = token_records.write_records(docs_of(spark, rows).repartition(6), path, TOKENIZER, 2, file_bytes=5000)
    assert index.groupBy("file").count().agg(F.max("count")).first()[0] < 1000


def test_records_of_an_empty_table(spark):
    path = scratch_path(spark, "test-no-records")
    assert token_records.write_records(docs_of(spark, []), path, TOKENIZER, 2).count() == 0
    assert token_records.read_records(spark, path).count() == 0
    assert token_records.read_shuffled(spark, path, 1).count() == 0


def test_damage_is_found(spark):
    path = scratch_path(spark, "test-damage")
    index = token_records.write_records(docs_of(spark, [(1, "some words"), (2, "more words")]), path, TOKENIZER, 2)
    row = index.where("id = 2").first()
    file = pathlib.Path(path.removeprefix("file://")) / "records" / row.file
    whole = file.read_bytes()
    for at in (row.offset, row.offset + 9, row.offset + 14, row.offset + row.n_bytes - 1):
        file.write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(Exception, match="checksum"):
            token_records.read_records(spark, path).collect()
    file.write_bytes(whole[:-3])
    with pytest.raises(Exception, match="breaks off"):
        token_records.read_records(spark, path).collect()


def test_files_of_a_lost_attempt_are_not_read(spark):
    path = scratch_path(spark, "test-attempts")
    token_records.write_records(docs_of(spark, [(1, "some words")]), path, TOKENIZER, 2)
    (pathlib.Path(path.removeprefix("file://")) / "records" / "left-over.records").write_bytes(b"half a rec")
    assert token_records.read_records(spark, path).count() == 1


def test_op12_equals_plain_encoding(spark, tokenizer):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, at = [], 0
    for doc_id, text in texts:
        ids = encoded(tokenizer, text)
        want.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, queries.op12_token_records(spark, SF).collect())) == want


# ---- hard negatives -------------------------------------------------------------------------


def test_curve_visits_every_cell_step_by_step():
    for d, bits in ((1, 5), (2, 1), (2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        keys = [k.tobytes() for k in hard_negatives.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_row():
    draw = np.random.default_rng(1)
    for size in (3, 1000, 1 << 26):
        rows, a = draw.integers(-size, size + 1, (200, 9)), draw.integers(-size, size + 1, (40, 9))
        least, most = hard_negatives.bounds_of(a, rows.min(axis=0)[None], rows.max(axis=0)[None])
        scores = hard_negatives.scores_of(a, rows)
        assert (scores == a.astype(object) @ rows.astype(object).T).all()
        assert (scores.min(axis=1) >= least[:, 0]).all() and (scores.max(axis=1) <= most[:, 0]).all()


def plain_negatives(rows, is_anchor):
    rows = [(i, y, [int(np.floor(256 * float(x))) for x in v]) for i, y, v in rows
            if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    place = lambda i: (i is None, i or 0)
    out = []
    for a in rows:
        if not is_anchor(a[0]):
            continue
        same = sorted((-score(a, b), place(b[0])) for b in rows if b is not a and b[1] == a[1])[:5]
        others = sorted((-score(a, b), place(b[0])) for b in rows if b[1] != a[1])
        for p, (nameless, pid) in same:
            inside = [(n, i) for n, i in others if 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(a[0], None if nameless else pid, k, None if i[0] else i[1], -p, -n) for k, (n, i) in enumerate(inside, 1)]
    return sorted(out, key=str)


def clustered(seed, n, d, labels):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(12, d))
    return [(int(i), int(draw.integers(labels)), (middle[int(draw.integers(12))] + draw.normal(size=d) * 0.1).astype("f4").tolist())
            for i in draw.permutation(n)]


@pytest.mark.parametrize("d, labels, block", [(3, 2, 16), (8, 40, 32), (8, 3, 7)])
def test_mining_equals_all_pairs(spark, monkeypatch, d, labels, block):
    for name, value in (("BLOCK_ROWS", block), ("TILE_ANCHORS", 6), ("ZONES_TOGETHER", 9), ("REGION_BLOCKS", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(d, 600, d, labels)
    rows += [(600 + i, 1, [0.5] * d) for i in range(150)]  # one common vector
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    table = table.withColumns({c: F.lit("x") for c in ("id", "block", "key", "vector", "n", "tile", "score")})
    found = hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect()), key=str) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_far_blocks_are_not_chosen():
    a = np.array([[10, 0], [0, 10]])
    lo, hi = np.array([[9, -1], [-9, -1], [-1, 9]]), np.array([[10, 1], [-8, 1], [1, 10]])
    least, most = hard_negatives.bounds_of(a, lo, hi)
    meets = (most >= 80) & (least <= 100)
    assert meets.tolist() == [[True, False, False], [False, False, True]]


def test_mining_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.85, 0.0]), (2, 2, [0.85, 0.0]), (None, 2, [0.85]),
            (3, None, [1.0, 0.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [nan, 0.0]), (7, 2, [inf, 0.0]), (8, 2, []),
            (10, 3, [-1.0, 0.0]), (20, 3, [1.0, 0.0]), (30, 4, [0.0, 0.0]), (40, 4, [])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    found = hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect()), key=str) == plain_negatives(rows, lambda i: i is not None and i % 10 == 0)
    huge = spark.createDataFrame([(0, 1, [1e30, 1.0]), (1, 1, [3e38, 1.0]), (2, 2, [2e38, 1.0])], table.schema)
    assert hard_negatives.mine_hard_negatives(huge, F.col("vec_id") == 0).count() == 1
    assert hard_negatives.mine_hard_negatives(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine_hard_negatives(table.where("label is null"), F.lit(True)).count() == 0
    assert hard_negatives.mine_hard_negatives(table, F.lit(False)).count() == 0
