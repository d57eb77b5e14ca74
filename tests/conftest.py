import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__  # noqa: E402,F401  (ships the package to the tasks)
from mailsift.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "mailsift-tests",
        **{
            "spark.master": "local[8]",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Run a Column function over Python values and return the results in order."""
    from pyspark.sql import functions as F

    def run(fn, values, kind="string"):
        rows = list(enumerate(values))
        df = spark.createDataFrame(rows, f"i bigint, v {kind}")
        out = df.select("i", fn(F.col("v")).alias("o")).collect()
        found = {r["i"]: r["o"] for r in out}
        return [found[i] for i in range(len(rows))]

    return run
