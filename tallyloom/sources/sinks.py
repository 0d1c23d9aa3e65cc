"""Writers (S25-S31). Every writer takes a frame and a path; only wide CSV for people is one file."""

from __future__ import annotations

import json
import os
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.normalize import path_safe


def wide_csv(rows: DataFrame, path: str) -> None:
    """One CSV with a header (a report's table, so a single file)."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def coverage_json(coverage: DataFrame, path: str) -> None:
    """A coverage table as JSON beside the CSV; one row a source or in all, so one file."""
    coverage.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def record_tree(records: DataFrame, path: str) -> None:
    """JSON records in folders by developer and model."""
    names = {"developer_dir": path_safe(F.coalesce("model_info.developer", F.lit("unknown"))), "model_dir": path_safe(F.coalesce("model_info.name", F.lit("unknown")))}
    records.withColumns(names).write.mode("overwrite").partitionBy(*names).json(path)


def valid_only(records: DataFrame, valid: Column, path: str, rejected: str) -> dict[str, int]:
    """Valid records to one folder, the others to another; how many went to each."""
    ok, counts = F.coalesce(valid, F.lit(False)), {}
    for name, rows, to in (("written", records.where(ok), path), ("rejected", records.where(~ok), rejected)):
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(to)
        counts[name] = seen.get["n"]
    return counts


def append_new(rows: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose key the table does not have yet; a second run adds nothing."""
    from pyspark.errors import AnalysisException

    try:
        rows = rows.join(rows.sparkSession.read.parquet(path).select(*key).distinct(), key, "left_anti")
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.dropDuplicates(key).write.mode("append").parquet(path)


class Appends:
    """A table that several writers append to, each key once: Parquet in folders, one a commit, and commits numbered from 1.

    A commit is a small file named by its number that gives the folder of its rows, and exists as a whole or not at all: it is written aside and
    then linked (on one machine) or renamed to its number, which fails if another writer has that number. The loser takes
    out of its rows the keys of the commits since and tries the next number. Rows of writers that fail are in no commit and so never read.
    Rename must not replace a file, as in HDFS; object stores whose rename does need a lock beside it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self.store = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[str]:
        """The folders of the commits, in order."""
        top = self.at(f"{self.path}/_commits")
        if not self.store.exists(top):
            return []
        names = sorted(n for f in self.store.listStatus(top) if (n := f.getPath().getName()).isdigit())
        if [int(n) for n in names] != list(range(1, len(names) + 1)):
            raise ValueError(f"{self.path}: commits are missing")
        told = {r.file: json.loads(r.value)["folder"] for r in self.spark.read.text([f"{top}/{n}" for n in names], wholetext=True).selectExpr("_metadata.file_name AS file", "value").collect()} if names else {}
        return [told[n] for n in names]

    def rows(self, schema, commits: list[str] | None = None) -> DataFrame:
        """The rows of all commits, or of some; none before the first."""
        folders = self.commits() if commits is None else commits
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def append(self, rows: DataFrame, key: list[str], tries: int = 20) -> int:
        """Commit the rows whose key no commit has, one a key (keys may hold null); the commit's number, or 0 if there is nothing to add."""
        seen, staged = 0, rows.dropDuplicates(key)
        for _ in range(tries):
            commits = self.commits()
            if commits[seen:]:
                known = self.rows(rows.schema, commits[seen:]).select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(key)))
                staged = staged.join(known, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(key)], "left_anti")
            if not seen or commits[seen:]:
                folder, count = f"data-{uuid.uuid4().hex}", Observation()
                staged.observe(count, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{folder}")
                if not count.get["n"]:
                    return 0
                staged = self.rows(rows.schema, [folder])
            seen = len(commits)
            if self._claim(seen + 1, folder):
                return seen + 1
        raise TimeoutError(f"{self.path}: other writers were first {tries} times")

    def _claim(self, number: int, folder: str) -> bool:
        """Whether the commit of this number is now the folder's."""
        aside, mine = self.at(f"{self.path}/_commits/_{uuid.uuid4().hex}"), self.at(f"{self.path}/_commits/{number:012d}")
        out = self.store.create(aside, False)
        out.write(bytearray(json.dumps({"folder": folder}).encode()))
        out.close()
        if self.store.getScheme() != "file":
            return not self.store.exists(mine) and self.store.rename(aside, mine)
        local = [p.toUri().getPath() for p in (aside, mine)]
        try:
            os.link(*local)
        except FileExistsError:
            return False
        finally:
            os.remove(local[0])
        return True


def manifest(spark, path: str) -> DataFrame:
    """Bytes, SHA-256 and lines of the files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), (F.size(F.split(F.decode("content", F.lit("UTF-8")), "\n")) - 1).alias("rows"))


def stable_number(value: Column) -> Column:
    """Twelve significant digits as JSON text, the same bytes on every run."""

    @F.pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda x: format(x, ".12g"), na_action="ignore")

    return text(value.cast("double"))
