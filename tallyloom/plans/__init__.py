"""Named queries over the driver's tables, and their oracle SQL.

Operators take column names; a query binds one to a table. Shares and statistics are rounded to six digits on both
sides, as the engines sum doubles in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of (read), where read(name) is a table, under its own name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(lambda name: table(spark, sf_dir, name)))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt evenly to two tasks a core: a table of few row groups would give all costly work on its rows to few tasks.

    Not to as many as a shuffle has: a task takes a second or more to load the largest expressions, whatever its rows.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *key)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`").cast("long").alias(c) if t == "int" else F.col(f"`{c}`") for c, t in df.dtypes))


from tallyloom.plans import analyses, converters, evidence, experiments, formats, leaderboards, papers, prose, scalars, statistics, validation  # noqa: E402, F401
