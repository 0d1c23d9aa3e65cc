"""Query of the answers read out of prose: orders stand for answers, their lines for benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import prose
from tallyloom.plans import query

BENCHMARK = """'{"benchmark_name": "' || CASE WHEN l_linenumber = 3 THEN 'Not Found' ELSE 'b' || l_linenumber END || '", "score": "' || CASE WHEN l_linenumber = 2 THEN 'high' ELSE l_quantity || '' END || '", "n_shot": ' || l_linenumber || ', "temperature": ' ||
CASE WHEN l_returnflag = 'R' THEN '"warm"' ELSE l_discount || '' END || ', "eval_harness": "h"}'"""
ANSWER = """CASE l_orderkey % 2 WHEN 0 THEN '{"models": [{"model_name": "m' || l_orderkey || '", "benchmarks": [' || listed || ']}, {"model_name": "n/a", "benchmarks": [' || listed || ']}]}' ELSE '{"models": [], "benchmarks": [' || listed || ']}' END"""


@query("""SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'm' || l_orderkey ELSE 'unknown' END AS model, 'b' || l_linenumber AS benchmark, CASE WHEN l_linenumber <> 2 THEN round(l_quantity, 6) END AS score, l_linenumber::BIGINT AS n_shot,
CASE WHEN l_returnflag <> 'R' THEN round(l_discount, 6) END AS temperature, CASE WHEN l_orderkey % 2 = 0 THEN 'h' END AS harness, CASE WHEN l_returnflag = 'R' THEN 'temperature' ELSE '' END AS faults FROM lineitem WHERE l_linenumber <> 3""")
def v18_prose(read):
    answers = read("lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.expr(BENCHMARK)), ", ").alias("listed"))  # an order's lines
    rows = prose.rows(answers, F.parse_json(F.expr(ANSWER)), "l_orderkey")
    return rows.select("l_orderkey", F.col("model_name").alias("model"), F.col("benchmark_name").alias("benchmark"), "score", "n_shot", "temperature", F.col("eval_harness").alias("harness"), F.array_join("faults", ",").alias("faults"))
