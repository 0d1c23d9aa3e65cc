"""Queries of the registered formats: tables written to the shared folder as logs, objects and stable JSON, and read by spark.read.format."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans import query, spread
from tallyloom.sources import formats
from tallyloom.sources.shared import fresh_path


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 3 < 2")
def s06_result_lines(read):
    """Of three events one is written after the prefix, one alone, and one as a line of a log that is no result."""
    events, one = read("events"), F.to_json(F.struct("event_id", "event_type", "value"))
    spark, kind = events.sparkSession, F.col("event_id") % 3
    path = fresh_path(spark, "lines")
    events.select(F.when(kind == 0, F.concat(F.lit("RESULT_JSON: "), one)).when(kind == 1, one).otherwise(F.concat(F.lit("event "), one))).write.text(path)
    formats.register(spark)
    rows = spark.read.format("result_lines").option("pieceBytes", 1 << 20).load(path)
    return rows.select(F.from_json("value", "event_id long, event_type string, value double").alias("r")).select("r.*")


@query("SELECT conv_id, turn, role, length(text) AS chars, 3 * count(*) AS objects FROM conversations GROUP BY ALL")
def s07_json_objects(read):
    """Each turn is written three times, alone and in an array, with nothing between."""
    turns, one = read("conversations"), F.to_json(F.struct("conv_id", "turn", "role", "text"))
    spark = turns.sparkSession
    path = fresh_path(spark, "objects")
    turns.select(F.concat(one, F.lit("["), one, F.lit(","), one, F.lit("]"))).write.option("lineSep", " ").text(path)
    formats.register(spark)
    rows = spark.read.format("json_objects").load(path).select(F.from_json("value", "conv_id long, turn long, role string, text string").alias("r")).select("r.*")
    return rows.groupBy("conv_id", "turn", "role", F.length("text").cast("long").alias("chars")).agg(F.count("*").alias("objects"))


@query("SELECT s_name AS task, 'acc' AS metric, 'none' AS filter, round(s_acctbal, 6) AS score FROM supplier WHERE s_acctbal IS NOT NULL")
def s27_harness_logs(read):
    """Each supplier is a run with a log of its own; the registered converter of its framework reads them."""
    runs = read("supplier")
    spark = runs.sparkSession
    path = fresh_path(spark, "logs")
    task = F.struct(F.col("s_acctbal").alias("acc,none"), F.lit(0.1).alias("acc_stderr,none"), F.lit("a").alias("alias"))
    log = F.to_json(F.struct(F.create_map("s_name", task).alias("results"), F.struct(F.col("s_suppkey").alias("id")).alias("configs")))
    formats.write_logs(spread(runs, "s_suppkey").select(log.alias("log")), path, "log")
    formats.register(spark)
    return formats.converted(formats.FETCHERS["harness_logs"](spark, path)).drop("log")


def _orders(read) -> str:
    orders = read("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = fresh_path(orders.sparkSession, "stable")
    formats.register(orders.sparkSession)
    formats.write_stable(orders, path, ["o_orderkey"])
    return path


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def s30_stable_json(read):
    """Orders as byte-stable JSON, read back under the manifest's digests."""
    spark = read("orders").sparkSession
    rows = spark.read.format("stable_json").load(_orders(read))
    return rows.select(F.from_json("value", "o_orderkey long, o_totalprice double, o_orderstatus string").alias("r")).select("r.*")


@query("SELECT count(*) AS rows, true AS sound FROM orders")
def s31_manifest(read):
    """Whether all files of the manifest, and no others, are there as listed, and their rows."""
    audit = formats.audited(read("orders").sparkSession, _orders(read))
    return audit.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.bool_and(F.col("listed") & F.col("sound")), F.lit(True)).alias("sound"))
