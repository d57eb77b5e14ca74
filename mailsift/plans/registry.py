"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailsift.plans.fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Inputs:
    """The views of one scale factor, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # The tables hold times without a zone; as instants they are read as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return view(self.spark, self.sf_dir, name)


def query(*views: str, sql: str | None = None):
    """Register a function of :class:`Inputs` under its name; ``views`` are those ``sql`` reads."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            SQL[fn.__name__] = with_views(sql, *views)
        return fn

    return register
