"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app_name: str = "mailsift", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; extra ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def few_listing_tasks(spark: SparkSession) -> None:
    """Let Spark list many paths in a few tasks per core, unless the session has set fewer.

    By default it takes a task per path, which costs more than the look at the path.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    most = max(32, 4 * spark.sparkContext.defaultParallelism)
    if int(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


def many_small_files(spark: SparkSession) -> None:
    """Read hundreds of small files in a task and list them in few, unless the session has seen to it.

    Spark takes a file for as costly as 4 MB, so a task has 32; starting its Python worker then takes
    longer than reading them, as it does with 64 files where a session has tasks of 16 MB. A session
    that takes a file for 256 KB or less keeps its cost.
    """
    few_listing_tasks(spark)
    name, most, cost = "spark.sql.files.openCostInBytes", 256 << 10, 16 << 10
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, str(cost))


@contextmanager
def few_state_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state in a partition per core, unless the session asks for fewer.

    Every batch of a stream opens, writes and commits all partitions of its state, with a Python worker
    each, however little is in them. A checkpoint holds on to the number it began with.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), max(8, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a folder of the
    driver's machine is used, in local mode only: executors elsewhere could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    made = tempfile.mkdtemp(prefix="mailsift-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
