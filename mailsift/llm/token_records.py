"""Token ids as length-delimited binary records, with an offset index beside them.

A file is a run of records and nothing else:

    uint64  n         bytes of the payload
    uint32            masked CRC-32 of the eight bytes before
    n bytes           payload
    uint32            masked CRC-32 of the payload

All numbers are little-endian. A payload is one document: a byte of flags, the id as int64, and its
token ids as uint16 (flag 2) where all ids of the tokenizer fit, else as uint32. Flag 1 marks a
null id. The mask rotates a checksum and adds a constant, so that
a checksum stored inside a payload does not check itself. Documents are in ascending order of their
id within a file and from file to file.

The index is a Parquet table ``(file_no, file, record, offset, n_bytes, id, n_tokens)``. It is
also the manifest: each task attempt writes a file of its own name, and Spark commits the index rows
of one attempt per task. A lost or repeated attempt leaves at most a file that nothing names.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import math
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec, functions as F
from tokenizers import Tokenizer

FILE_BYTES = 128 << 20  # of text in a file, on average
CACHED = 600_000  # words, and pieces
SLICE_CHARS = 1 << 20
BUFFER_BYTES = 4 << 20
OPEN_FILES = 64
INDEX = "file string, record long, offset long, n_bytes long, id long, n_tokens long"
HEAD, TAIL, ID = "<QI", "<I", "<Bq"  # layouts for struct
HEAD_BYTES, TAIL_BYTES, ID_BYTES = 12, 4, 9
NAMELESS, NARROW = 1, 2
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_SEPARATORS = re.compile(r"[\x1C-\x1F]")


# ---- records --------------------------------------------------------------------------------


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack(TAIL, masked(size)), payload, struct.pack(TAIL, masked(payload))))


def read_frame(source, where: str) -> bytes | None:
    """The payload of the record that begins here, or None at the end. Damage is an error."""
    head = source.read(HEAD_BYTES)
    if not head:
        return None
    if len(head) < HEAD_BYTES:
        raise ValueError(f"{where}: a record breaks off in its head")
    size, told = struct.unpack(HEAD, head)
    if masked(head[:8]) != told:
        raise ValueError(f"{where}: the length of a record does not match its checksum")
    payload, tail = source.read(size), source.read(TAIL_BYTES)
    if len(payload) < size or len(tail) < TAIL_BYTES:
        raise ValueError(f"{where}: a record breaks off")
    if masked(payload) != struct.unpack(TAIL, tail)[0]:
        raise ValueError(f"{where}: a payload does not match its checksum")
    return payload


def document_payload(row_id: int | None, ids: bytes, width: int) -> bytes:
    """``ids`` are little-endian integers of ``width`` bytes."""
    return struct.pack(ID, (NAMELESS if row_id is None else 0) | (NARROW if width == 2 else 0), row_id or 0) + ids


def document_of(payload: bytes) -> tuple[int | None, bytes]:
    """The id and the token ids as uint32."""
    flags, row_id = struct.unpack_from(ID, payload)
    ids = payload[ID_BYTES:]
    if flags & NARROW:
        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    return None if flags & NAMELESS else row_id, ids


# ---- tokens ---------------------------------------------------------------------------------


# The normalisation and the split that PieceEncoder knows how to take apart.
LOWER_CASE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
LETTER_RUNS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# Letters whose lower case and normal form do not depend on what stands beside them.
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
UNSAFE = re.compile(rf"[^\x00-\x7F{LETTERS}]")
# What LETTER_RUNS splits a word without unsafe characters into, in lower case.
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\x20\x09-\x0D0-9{LETTERS}]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Byte-level models show a byte as the letter of its code, or, where that cannot be seen, as one from 256 on.
BYTE_LETTERS = dict(zip([*range(33), *range(127, 161), 173], range(256, 324)))


class PieceEncoder:
    """Token ids of whole texts, as integers of ``width`` bytes.

    Where a tokenizer lowers the case, drops white space and splits texts into runs of letters and
    the like, a text's ids are those of its pieces in order. Pieces are encoded once by the
    tokenizer and remembered, as are words; a memory that is full is emptied, which changes no
    result. A word with other characters than ASCII and some letters is one piece. Long texts
    are taken in slices between words. A text with the string of a special token is taken word by
    word, and other kinds of tokenizers encode each text as a whole.
    """

    def __init__(self, tokenizer_json: str, width: int = 4):
        self._tokenizer, self._kind = Tokenizer.from_str(tokenizer_json), f"<u{width}"
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        told = json.loads(tokenizer_json)
        split = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self._in_pieces = (
            (told.get("normalizer") or {}).get("normalizers") == LOWER_CASE
            and split[0].get("pattern") == {"Regex": LETTER_RUNS} and split[0].get("behavior") == "Removed"
            and [s.get("type") for s in split[1:]] == ["ByteLevel"] and not split[1]["add_prefix_space"]
            and not split[1]["use_regex"] and not told.get("post_processor"))
        self._special = [t["content"] for t in told["added_tokens"]]

    def _bytes(self, encoding) -> bytes:
        return np.array(encoding.ids, self._kind).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self._in_pieces:
            return self._bytes(self._tokenizer.encode(text, add_special_tokens=False))
        special = any(s in text for s in self._special)
        out, at = [], 0
        while at < len(text):
            gap = _SPACES.search(text, at + SLICE_CHARS)
            end = gap.start() if gap else len(text)
            part = text[at:end]
            out.append(self._of_whole_words(WORD.findall(part)) if special else self._of_words(part))
            at = end
        return b"".join(out)

    def _of_words(self, text: str) -> bytes:
        """Words are remembered too: most of a text is words that were there before."""
        # split() takes these four for white space; the tokenizer does not.
        words = WORD.findall(text) if _SEPARATORS.search(text) else text.split()
        known, single = self._words, self._pieces
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > CACHED:
                known.clear()
                new = set(words)
            in_pieces = [(w, [w] if UNSAFE.search(w) else PIECE.findall(w.lower())) for w in new]
            self._learn({p for _, pieces in in_pieces for p in pieces})
            known.update((w, b"".join([single[p] for p in pieces])) for w, pieces in in_pieces)
        return b"".join([known[w] for w in words])

    def _learn(self, pieces: set[str], split: bool = True) -> None:
        known = self._pieces
        new = pieces.difference(known)
        if len(known) + len(new) > CACHED:
            known.clear()
            new = pieces
        model, odd = self._tokenizer.model.tokenize, []
        for piece in new:  # past the normaliser and the split, which leave a safe piece as it is
            if not split or UNSAFE.search(piece) or not piece.islower():
                odd.append(piece)
            else:
                shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
                known[piece] = np.array([t.id for t in model(shown)], self._kind).tobytes()
        for part in itertools.batched(odd, 1000):
            found = self._tokenizer.encode_batch_fast(list(part), add_special_tokens=False)
            known.update(zip(part, map(self._bytes, found)))

    def _of_whole_words(self, words: list[str]) -> bytes:
        self._pieces.clear()  # what is remembered there are pieces
        self._learn(set(words), split=False)
        found = b"".join([self._pieces[w] for w in words])
        self._pieces.clear()
        return found


# ---- writing --------------------------------------------------------------------------------


def id_width(tokenizer_json: str, end_id: int) -> int:
    """Bytes that every id of a tokenizer fits in: 2 or 4."""
    largest = max(Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True).values())
    return 2 if max(largest, end_id) < 1 << 16 else 4


def _writer(folder: str, tokenizer_json, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encode, end = PieceEncoder(tokenizer_json.value, width), end_id.to_bytes(width, "little")
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{uuid.uuid4().hex}.records"
        out, offset, record = None, 0, 0
        for batch in batches:
            told: list[tuple] = []
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = frame(document_payload(row_id, ids := encode(text.as_py()) + end, width))
                out = out or store.open_output_stream(f"{root}/{name}", buffer_size=BUFFER_BYTES)
                out.write(data)
                told.append((name, record, offset, len(data), row_id, len(ids) // width))
                offset, record = offset + len(data), record + 1
            if told:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.string() if i == 0 else pa.int64()) for i, v in enumerate(zip(*told))],
                    names=[part.split()[0] for part in INDEX.split(", ")])
        if out:  # closed before the attempt ends: a committed index names whole files only
            out.close()

    return run


def write_records(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id",
                  text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every row's token ids and ``end_id`` below ``path``; returns the index as a table.

    Records lie in ``path/records``, the index in ``path/index``. Null ids come first; rows of one
    id follow a hash of their texts; null texts count as empty; other columns are ignored. Rows are
    dealt to files in ranges that go on inside one id, so an id with very many rows, copies of one
    row included, fills several files of about ``file_bytes`` of text. Texts are shuffled once and
    one is held at a time. The driver reads the tokenizer file, whose size is fixed, and sends it
    to the tasks. ``path`` is in a folder that all executors share and that Arrow can open.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(math.ceil(size / file_bytes), spark.sparkContext.defaultParallelism)
    with open(tokenizer_file, encoding="utf-8") as source:
        tokenizer_json = source.read()
    width, sent = id_width(tokenizer_json, end_id), spark.sparkContext.broadcast(tokenizer_json)
    store, root = fs.FileSystem.from_uri(f"{path}/records")
    store.create_dir(root, recursive=True)
    order = ("id", "deal", "at")
    index = (
        own.withColumns({"deal": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
        .repartitionByRange(files, *order).sortWithinPartitions(*order).select("id", "text")
        .mapInArrow(_writer(f"{path}/records", sent, end_id, width), INDEX)
        .withColumn("file_no", F.spark_partition_id().cast("long"))
    )
    index.write.parquet(f"{path}/index")
    return read_index(spark, path)


# ---- reading --------------------------------------------------------------------------------


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{INDEX}, file_no long").parquet(f"{path}/index")


def _file_bases(index: DataFrame, run: int = 1000) -> DataFrame:
    """``(file_no, file, base)``: the tokens in all files before. Sums go up in runs of files."""
    files = index.groupBy("file_no", "file").agg(F.sum("n_tokens").alias("tokens")).withColumn("run", F.floor(F.col("file_no") / run))

    def before(order: WindowSpec):
        return F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    runs = files.groupBy("run").agg(F.sum("tokens").alias("tokens"))
    runs = runs.select("run", before(Window.orderBy("run")).alias("run_base"))
    return files.withColumn("within", before(Window.partitionBy("run").orderBy("file_no"))).join(runs, "run").select(
        "file_no", "file", (F.col("run_base") + F.col("within")).alias("base"))


def _told(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, counts, tokens = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(tokens, pa.binary())],
        names=["id", "start", "n_tokens", "ids"])


RECORD = "id long, start long, n_tokens long, ids binary"


def _scan(folder: str):
    """Rows (file, base) to the records of each file, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", buffer_size=BUFFER_BYTES) as source:
                    while (payload := read_frame(source, name)) is not None:
                        row_id, ids = document_of(payload)
                        rows.append((row_id, at, len(ids) // 4, ids))
                        at, held = at + len(ids) // 4, held + len(ids)
                        if held > BUFFER_BYTES:
                            yield _told(rows)
                            rows, held = [], 0
                if rows:
                    yield _told(rows)

    return run


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of every record, from the files that the index names.

    ``start`` counts the tokens of all records before, ``ids`` are uint32. Each file is streamed by
    one task, and both checksums of each record are verified.
    """
    files = _file_bases(read_index(spark, path))
    n = files.count()
    return files.select("file", "base").repartition(max(n, 1)).mapInArrow(_scan(f"{path}/records"), RECORD)


def _fetch(folder: str):
    """Rows (file, offset, start) to their records, by seeking; a few files stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        with contextlib.ExitStack() as stack:
            opened: dict = {}
            for batch in batches:
                rows, held = [], 0
                for name, offset, start in zip(*(c.to_pylist() for c in batch.columns)):
                    if name not in opened:
                        if len(opened) >= OPEN_FILES:
                            opened.pop(next(iter(opened))).close()
                        opened[name] = stack.enter_context(store.open_input_file(f"{root}/{name}"))
                    opened[name].seek(offset)
                    row_id, ids = document_of(read_frame(opened[name], name))
                    rows.append((row_id, start, len(ids) // 4, ids))
                    held += len(ids)
                    if held > BUFFER_BYTES:
                        yield _told(rows)
                        rows, held = [], 0
                if rows:
                    yield _told(rows)

    return run


def read_shuffled(spark: SparkSession, path: str, seed: int, partitions: int | None = None) -> DataFrame:
    """Every record once, in an order drawn from ``seed``: ``(id, start, n_tokens, ids)``.

    Only index rows are shuffled and sorted; each record is then read at its offset. ``start`` counts
    tokens inside the record's file. Reruns with one seed and number of partitions agree.
    """
    inside = Window.partitionBy("file_no").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    rows = read_index(spark, path).select(
        "file", "offset", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("start"),
        F.xxhash64(F.lit(seed), "file_no", "record").alias("draw"))
    n = partitions or spark.sparkContext.defaultParallelism
    rows = rows.repartitionByRange(n, "draw").sortWithinPartitions("draw", "file", "offset")
    return rows.select("file", "offset", "start").mapInArrow(_fetch(f"{path}/records"), RECORD)
