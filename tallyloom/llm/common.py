"""What the operators of this package share: reading, staging, row identity, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow slice that Python code handles at a time; bounds the memory of a worker.
SLICE_BYTES = 6 << 20

#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; only where it is unset (tests) one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='stage-')}"
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors.

    The shuffle files behind the table are removed once it is written, as nothing reads them again.
    """
    spark = df.sparkSession
    path, before = f"{stage_dir(spark)}/{what}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(memory: dict, most: int) -> None:
    """Empty a worker's memory of words when it is full, but for short words: these are the frequent ones of any language."""
    if len(memory) > most:
        short = {k: v for k, v in memory.items() if len(k) <= 7}
        memory.clear()
        if len(short) < most // 2:
            memory.update(short)


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """Two columns that tell rows apart: rows alike in both are alike in id and text, so they share every result.

    A null id, or one that is no whole number, gets the least long; what an operator returns for a row by this key depends on
    its text, so a clash with a row of that id and the same text is harmless. Where ids themselves count, see numbered().
    """
    return [
        F.coalesce(F.col(id_column).try_cast("long"), F.lit(-(2**63))).alias("_id"),
        F.xxhash64(text_of(text_column)).alias("_th"),
    ]


def numbered(docs: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with whole-number ids, in the order of the old ones, and the table from id to name; docs as it is and None if ids are such already."""
    if docs.schema[id_column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return docs, None
    own = F.col(id_column)
    names = staged(docs.where(own.isNotNull()).select(own.alias("name")).distinct().orderBy("name").select(F.monotonically_increasing_id().alias("number"), "name"), "names")
    told = docs.withColumnRenamed(id_column, "name") if id_column != "name" else docs
    return told.join(names, "name", "left").drop("name").withColumnRenamed("number", id_column), names


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator, text_index: int = 1) -> Iterator:
    """Cut Arrow batches so that no slice holds much more than SLICE_BYTES of text (a single text may)."""
    for batch in batches:
        rows, size = batch.num_rows, max(1, batch.column(text_index).nbytes)
        step = max(1, min(rows, int(rows * SLICE_BYTES / size))) if rows else 1
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def map_arrow(df: DataFrame, make: Callable[[], Callable], schema: str, text_index: int = 1) -> DataFrame:
    """mapInArrow with one state a task: make() returns a function from an Arrow slice to columns in schema order (or None)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        step = make()
        for piece in slices(batches, text_index):
            if (out := step(piece)) is not None:
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=t.type) for v, t in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
