"""Message archives: many messages in one file, found by offset, read in even partitions.

A folder with a file per message costs a listing and an open for each of them. An archive keeps
messages in blocks of some megabytes:

    uint64            size of the head, little-endian
    head              the block's messages as an Arrow stream: mailbox, folder, name, received_us, size
    contents          one after the other

and a catalog, a :class:`BatchTable` with a row per block ``(file, offset, n_bytes, n_messages,
first_us, last_us)``. Each task attempt writes files of its own name, and the catalog's commit says
which of them count, so readers see a batch of messages as a whole or not at all.

``spark.read.format("mail_archive")`` plans ranges of whole blocks into partitions of about equal
bytes. ``spark.readStream.format("mail_archive")`` does the same with the blocks committed since
the offset before, which is the number of the last batch. Options: ``path``, ``partitionBytes``,
``modifiedAfterUs`` (blocks that end before are not read) and ``content`` (``false`` reads the heads
only). Both need a folder that Arrow can open.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from mailsift.functions.timing import micros
from mailsift.sources.batches import BatchTable, live_commits

BLOCK_BYTES = 8 << 20
PARTITION_BYTES = 64 << 20
CATALOG = "file string, offset bigint, n_bytes bigint, n_messages bigint, first_us bigint, last_us bigint"
MESSAGES = (
    "path string, mailbox string, folder string, name string, received_at timestamp, "
    "size bigint, content binary"
)
HEAD = ["mailbox", "folder", "name", "received_us", "size"]
HEAD_BYTES = 8


# ---- writing --------------------------------------------------------------------------------


def _block(rows: pa.Table) -> bytes:
    head = pa.BufferOutputStream()
    table = rows.select(HEAD)
    with pa.ipc.new_stream(head, table.schema) as out:
        out.write_table(table)
    head = head.getvalue().to_pybytes()
    contents = [value.as_buffer() for chunk in rows.column("content").chunks for value in chunk]
    return b"".join([struct.pack("<Q", len(head)), head, *contents])


def _writer(folder: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, out, offset, told = f"{uuid.uuid4().hex}.mails", None, 0, []
        held, size = [], 0

        def put(out, offset):
            rows = pa.Table.from_batches(held)
            block = _block(rows)
            out = out or store.open_output_stream(f"{root}/{name}")
            out.write(block)
            times = pc.min_max(rows.column("received_us")).as_py()
            told.append((name, offset, len(block), rows.num_rows, times["min"], times["max"]))
            return out, offset + len(block)

        for batch in batches:
            sizes, first = batch.column("size").to_pylist(), 0
            for i, n in enumerate(sizes):
                size += n
                if size >= block_bytes:
                    held.append(batch.slice(first, i + 1 - first))
                    out, offset = put(out, offset)
                    held, size, first = [], 0, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            out, offset = put(out, offset)
        if out:  # closed before the attempt ends: a committed catalog names whole files only
            out.close()
        if told:
            kinds = (pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*told), kinds)],
                                             names=[c.split()[0] for c in CATALOG.split(", ")])

    return run


def catalog_of(spark: SparkSession, path: str) -> BatchTable:
    return BatchTable(spark, f"{path.rstrip('/')}/catalog", CATALOG)


def write_archive(df: DataFrame, path: str, batch_id: int, block_bytes: int = BLOCK_BYTES) -> None:
    """Add messages (mailbox, folder, name, received_at, content) as batch ``batch_id``.

    A batch that is written again replaces what it was. Null contents count as empty, and rows
    that repeat are messages of their own. Nothing is shuffled: files follow the partitions of ``df``.
    """
    base = path.rstrip("/")
    store, root = fs.FileSystem.from_uri(f"{base}/files")
    store.create_dir(root, recursive=True)
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    rows = df.select(
        F.col("mailbox").cast("string"), F.col("folder").cast("string"), F.col("name").cast("string"),
        micros(F.col("received_at")).alias("received_us"), F.octet_length(content).cast("bigint").alias("size"), content.alias("content"))
    catalog_of(df.sparkSession, base).write(rows.mapInArrow(_writer(f"{base}/files", block_bytes), CATALOG), batch_id)


# ---- reading --------------------------------------------------------------------------------


class Blocks(InputPartition):
    """Ranges ``(file, offset, bytes)`` of an archive."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)


class _Archive:
    """What both readers need. It runs without a session, so it lists with Arrow."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.after = int(options["modifiedAfterUs"]) if "modifiedAfterUs" in options else None
        self.with_content = options.get("content", "true").lower() == "true"

    def commits(self) -> list:
        store, root = fs.FileSystem.from_uri(f"{self.path}/catalog/_commits")
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return live_commits(f.base_name for f in found if not f.base_name.startswith((".", "_")))

    def blocks(self, above: int, to: int) -> list[tuple[str, int, int]]:
        """The blocks of the batches after ``above``, up to ``to``."""
        out = []
        for c in self.commits():
            if not above < c.last <= to:
                continue
            store, root = fs.FileSystem.from_uri(f"{self.path}/catalog/{c.folder}")
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.base_name.endswith(".parquet"):
                    rows = pq.read_table(f.path, filesystem=store, columns=["file", "offset", "n_bytes", "last_us"], partitioning=None)
                    out += [(r["file"], r["offset"], r["n_bytes"]) for r in rows.to_pylist()
                            if self.after is None or r["last_us"] is not None and r["last_us"] >= self.after]
        return sorted(out)

    def planned(self, above: int, to: int) -> list[Blocks]:
        """Partitions of about equal bytes; neighbouring blocks of a file are one range."""
        parts, size = [], 0
        for file, offset, n in self.blocks(above, to):
            if not parts or size + n > self.partition_bytes:
                parts.append([])
                size = 0
            last = parts[-1][-1] if parts[-1] else None
            if last and last[0] == file and last[1] + last[2] == offset:
                parts[-1][-1] = (file, last[1], last[2] + n)
            else:
                parts[-1].append((file, offset, n))
            size += n
        return [Blocks(p) for p in parts] or [Blocks([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(f"{self.path}/files")
        for file, offset, n in partition.value:
            with store.open_input_file(f"{root}/{file}") as source:
                at = offset
                while at < offset + n:
                    source.seek(at)
                    size = struct.unpack("<Q", source.read(HEAD_BYTES))[0]
                    rows = pa.ipc.open_stream(source.read(size)).read_all().combine_chunks()
                    at += HEAD_BYTES + size
                    total = pc.sum(rows.column("size")).as_py() or 0
                    yield from self._messages(file, rows, source.read(total) if self.with_content else None)
                    at += total

    def _messages(self, file: str, rows: pa.Table, contents: bytes | None) -> Iterator[pa.RecordBatch]:
        sizes = rows.column("size").combine_chunks()
        if contents is None:
            content = pa.nulls(len(rows), pa.binary())
        else:
            ends = pa.array([0, *pc.cumulative_sum(sizes).to_pylist()], pa.int32())
            content = pa.Array.from_buffers(pa.binary(), len(rows), [None, ends.buffers()[1], pa.py_buffer(contents)])
        times = rows.column("received_us").combine_chunks().cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
        columns = [pa.array([f"{self.path}/files/{file}"] * len(rows)), *[rows.column(c).combine_chunks() for c in HEAD[:3]],
                   times, sizes, content]
        after = self.after
        batch = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MESSAGES.split(", ")])
        if after is not None:
            batch = batch.filter(pc.fill_null(pc.greater_equal(rows.column("received_us").combine_chunks(), after), False))
        yield batch


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.archive = _Archive(options)

    def partitions(self) -> list[Blocks]:
        return self.archive.planned(-1, 1 << 62)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.archive.read(partition)


class ArchiveStream(DataSourceStreamReader):
    """An offset is the last batch that was read. A batch below it that is replaced is not read again."""

    def __init__(self, options: dict):
        self.archive = _Archive(options)

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max((c.last for c in self.archive.commits()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        return self.archive.planned(start["batch"], end["batch"])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.archive.read(partition)


class MailArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mail_archive"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ArchiveStream(self.options)


def read_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    """All messages of an archive, with the columns of ``read_mail_folders``."""
    spark.dataSource.register(MailArchive)
    return spark.read.format("mail_archive").options(path=path, **options).load()


def read_archive_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The messages of an archive as a stream: what is there first, then each new batch.

    A micro-batch takes every batch committed since the last one.
    """
    spark.dataSource.register(MailArchive)
    return spark.readStream.format("mail_archive").options(path=path, **options).load()
