"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import read_table


def _is(kind: str):
    return lambda x: F.when(x["kind"] == kind, F.lit(True))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import pii

    found = pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.array_compact(F.transform(base, _is(k)))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.described(base), 256).alias("base_sha256"), pii.described(F.col("spans")).alias("spans"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import substrings

    return substrings.dedup_substrings(read_table(spark, sf_dir, "documents"), length=200, digests=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import lines

    done = lines.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), in_documents=10, shortest=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import neardup
    from tallyloom.llm.common import row_key

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = neardup.near_duplicates(docs).drop("first")
    return docs.select("doc_id", *row_key()).join(found, ["_id", "_th"]).drop("_id", "_th")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import toxicity

    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.train(docs, labels, ~held_out)
    return toxicity.score(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyloom.llm import bpe

    return bpe.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import quality

    return quality.cascade(read_table(spark, sf_dir, "documents")).drop("rejected_by")  # it follows the timings of the run


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import lm

    docs = read_table(spark, sf_dir, "documents")
    return lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import vectors

    found = vectors.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", "rank", "vec_id", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyloom.llm import packing

    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import prefix_trie

    c = F.col("conv_id")
    nodes = prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"), borrowed=(c - c % 100, F.crc32(c.cast("string")) % 6, 5))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import interactions

    return interactions.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import langid

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = langid.train(docs, ~held_out)
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_pii, op2_substrings, op3_line_dedup, op4_near_copies, op5_toxicity, op6_bpe, op7_quality, op8_lm, op9_topk, op10_packing, op11_trie, op12_interactions, op13_langid)}
