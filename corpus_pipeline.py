"""A corpus from raw documents to packed training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import lines, neardup, packing, pii, toxicity
from tallyloom.llm.common import read_table, staged

#: Documents with this score or more are rejected.
TOXIC = 0.7


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from all labels of the documents given, so it also scores rows it learned from.

    A null or empty text has no evidence and stays; repeated rows stay or go together; an empty table stays empty.
    """
    kept = [c for c in docs.columns]
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model, kept, threshold=TOXIC).where("predicted = 0").select(*kept)


def deduped_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more have; n_chars follows the text. A null text becomes empty; repeated rows count each."""
    return _sized(lines.dedup_lines(docs, in_documents=10, shortest=1).select(*docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies, one of repeated rows; documents without words all stay."""
    return neardup.keep_first(docs).select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; null becomes empty, repeated rows are redacted alike."""
    return _sized(pii.redact(docs).select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the sequences that they fill; a null or empty text is the end token alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("toxicity", toxic), ("line dedup", deduped_lines), ("n-gram join", one_of_each), ("pii", redacted), ("packing", packed)]

#: Learned classifiers and similarity joins have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
