"""Message folders, staging streams and disposition tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from mailsift.session import many_small_files
from mailsift.sources.batches import BatchTable

# Folders of a mailbox that a digest covers.
DIGEST_FOLDERS = ("cur", "new", ".Sent/cur", ".Quarantine/cur")
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
MESSAGE_FILES = (
    "path string, mailbox string, folder string, name string, received_at timestamp, "
    "size bigint, content binary"
)
# Staged files that are kept in mind between batches, and those that a stream's log takes up
# before it is written anew.
CACHED_FILES = 100_000
LOGGED_FILES = 50_000
LOG_INTERVAL = "spark.sql.streaming.fileSource.log.compactInterval"


def _file_columns(files: DataFrame, folder: Column, mailbox_depth: int) -> DataFrame:
    parts = F.split("path", "/")
    return files.select(
        "path",
        F.element_at(parts, F.lit(mailbox_depth)).alias("mailbox"),
        folder.alias("folder"),
        F.element_at(parts, F.lit(-1)).alias("name"),
        F.col("modificationTime").alias("received_at"),
        F.col("length").alias("size"),
        "content",
    )


def read_mail_folders(
    spark: SparkSession,
    root: str,
    folders: Sequence[str] = DIGEST_FOLDERS,
    modified_after: dt.datetime | Column | None = None,
) -> DataFrame:
    """All messages in ``<root>/<mailbox>/<folder>``; absent folders and unreadable files are skipped.

    So are files without a single byte, which Spark does not scan.

    ``modified_after`` is inclusive and is checked before a file is opened; ``content`` is only
    read when it is used.
    """
    root = root.rstrip("/")
    many_small_files(spark)
    reader = spark.read.format("binaryFile").options(
        ignoreCorruptFiles="true", ignoreMissingFiles="true"
    )
    parts = []
    for folder in folders:
        try:
            # Folders, not files: each is listed once by a task, and no path of a file is looked up.
            files = reader.load(f"{root}/*/{folder}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if modified_after is not None:
            files = files.where(F.col("modificationTime") >= modified_after)
        # A file in the place of a folder matches, too.
        files = files.where(F.substring_index(F.substring_index("path", "/", -2), "/", 1).eqNullSafe(folder.rpartition("/")[2]))
        depth = -(len(folder.split("/")) + 2)
        parts.append(_file_columns(files, F.lit(folder), depth))
    if not parts:
        return spark.createDataFrame([], MESSAGE_FILES)
    messages = parts[0]
    for part in parts[1:]:
        messages = messages.unionByName(part)
    return messages


def read_staging_stream(
    spark: SparkSession, staging: str, max_files: int = 10_000, max_bytes: str | None = None
) -> DataFrame:
    """Stream of staged ``<staging>/<mailbox>/*.mail`` files: the backlog first, then new ones.

    A batch takes at most ``max_files``, or about ``max_bytes`` where that is given.

    Small batches of a long backlog do not pay for all of it: Spark lists the files of a batch in a
    few tasks, and writes the log of all files so far anew after ``LOGGED_FILES`` more, or 100 batches.
    """
    many_small_files(spark)
    batches = min(100, LOGGED_FILES // max_files)
    if int(spark.conf.get(LOG_INTERVAL)) < batches:
        spark.conf.set(LOG_INTERVAL, str(batches))
    limit = {"maxBytesPerTrigger": max_bytes} if max_bytes else {"maxFilesPerTrigger": max_files}
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .options(pathGlobFilter="*.mail", maxCachedFiles=CACHED_FILES, **limit)
        .load(f"{staging.rstrip('/')}/*")
    )
    return _file_columns(files, F.lit(".staging"), -2)


def land_messages(
    df: DataFrame, root: str, content: str = "content", name: str = "name"
) -> DataFrame:
    """Write each message to ``<root>/<mailbox>/<folder>/<name>`` and report what arrived.

    Needs columns mailbox and folder too (``folder`` may be empty). Names must be
    deterministic: a repeated task then overwrites its own files. The result has one row per
    file with its size on storage, the input of the landing audit. Lazy: files are written
    when the result is used.
    """
    base = root.rstrip("/")
    target = F.concat_ws(
        "/", F.lit(base), F.col("mailbox").cast("string"),
        F.nullif(F.col("folder"), F.lit("")), F.col(name),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(base if "://" in base else f"file://{base}")
        made = set()  # folders that this task has seen to
        for batch in batches:
            sizes = []
            for path, data in zip(batch["path"], batch["content"]):
                path = path.removeprefix("file://")
                folder = path.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                with store.open_output_stream(path) as out:
                    out.write(data)
                sizes.append(store.get_file_info(path).size)
            yield pd.DataFrame({"path": batch["path"], "size": sizes})

    rows = df.select(target.alias("path"), F.col(content).cast("binary").alias("content"))
    return rows.mapInPandas(write, "path string, size bigint")


def write_dispositions(df: DataFrame, path: str) -> None:
    """Append messages to a table partitioned by ``disposition``; nothing is ever deleted."""
    df.write.mode("append").partitionBy("disposition").parquet(path)


def write_disposition_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """Write one micro-batch as a version of its own, then let it count as ``batch_id``.

    A replay replaces the whole batch, also where it decides otherwise than the first run did.
    Readers see the old version whole until the new one is complete.
    """
    schema = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
    BatchTable(df.sparkSession, path, schema, ("disposition",)).write(df, batch_id)


def read_disposition_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches as they now count, with ``batch_id``; empty before the first."""
    return BatchTable(spark, path, schema, ("disposition",)).read()


def disposition_stream(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Stream form of :func:`write_dispositions`."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: write_disposition_batch(batch, batch_id, path)
    )
