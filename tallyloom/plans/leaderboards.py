"""Queries of the leaderboards: parts, customers, suppliers, orders, events and line items stand for boards' documents of every layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import leaderboards
from tallyloom.plans import query


def rows(table: DataFrame, board: str, document: str, name: str = "NULL", position: str = "0") -> DataFrame:
    """Documents of a board: document is SQL of JSON text."""
    return table.select(F.lit(board).alias("board"), F.parse_json(F.expr(document)).alias("doc"), F.expr(name).cast("string").alias("name"), F.expr(position).cast("long").alias("at"))


PASS = "'{\"humaneval+\": ' || p_size || ', \"mbpp+\": ' || CASE WHEN p_size % 4 = 0 THEN 'null' ELSE p_size / 100 || '' END || '}'"
DOCUMENTS = {
    "evalplus": f"""CASE p_partkey % 3 WHEN 0 THEN '{{"org/p' || p_partkey || '": {{"pass@1": ' || {PASS} || '}}}}' WHEN 1 THEN '[{{"model": "p' || p_partkey || '", "humaneval+": ' || p_size || ', "MBPP+": 3}}]'
ELSE '{{"models": [{{"name": "x/p' || p_partkey || '", "pass@1": ' || {PASS} || '}}]}}' END""",
    "wildbench": """CASE c_custkey % 3 WHEN 0 THEN '{"org/c' || c_custkey || '": {"score": ' || c_nationkey || ', "adjusted_score": ' || c_acctbal || '}}' WHEN 1 THEN '[{"model_id": "c' || c_custkey || '", "wb_score": ' || c_nationkey || ', "score": -1}]'
ELSE '{"rows": [{"row": {"model": "c' || c_custkey || '", "score": "' || c_nationkey || '"}}]}' END""",
    "swe_bench": """CASE WHEN s_suppkey % 4 = 0 THEN '{}' ELSE '{"resolved": [0' || repeat(',1', CAST(s_nationkey AS INT)) || ']}' END""",
    "alpacaeval2": """'{"model": "k' || o_custkey || '", "win_rate": "' || o_orderkey % 90 || '"' || CASE WHEN o_orderkey % 3 = 0 THEN ', "length_controlled_winrate": "' || o_orderkey % 80 || '"' ELSE '' END || ', "mode": "' || CASE WHEN o_orderkey % 2 = 0 THEN 'weighted' ELSE 'plain' END || '"}'""",
    "chatbot_arena": """'{"Model": "l' || l_orderkey || '-' || l_linenumber || '", "Arena Score": "' || (1000 + CAST(l_quantity AS INT)) || '", "Organization": "' || l_returnflag || '", "95% CI": "+' || l_linenumber || '/2", "Votes": "1,0' || l_linenumber || '0"}'""",
}


@query("""WITH ep AS (SELECT p_partkey k, p_partkey % 3 AS layout, p_size::DOUBLE AS he, CASE WHEN p_partkey % 3 = 1 THEN 3.0 WHEN p_size % 4 <> 0 THEN p_size / 100.0 END AS mb FROM part),
ep2 AS (SELECT 'p' || k AS model, CASE layout WHEN 0 THEN 'org' WHEN 2 THEN 'x' ELSE '' END AS organization, b.benchmark, CASE b.benchmark WHEN 'HumanEval+' THEN he ELSE mb END AS v, 100.0 AS most FROM ep, (VALUES ('HumanEval+'), ('MBPP+')) b(benchmark)),
wb AS (SELECT 'c' || c_custkey AS model, CASE WHEN c_custkey % 3 = 0 THEN 'org' ELSE '' END AS organization, 'WildBench v2' AS benchmark, CASE WHEN c_custkey % 3 = 1 AND c_nationkey = 0 THEN -1 ELSE c_nationkey END::DOUBLE AS v, CASE WHEN c_custkey % 3 = 0 THEN 10.0 ELSE 100.0 END AS most FROM customer
UNION ALL SELECT 'c' || c_custkey, 'org', 'WildBench v2 (adj)', c_acctbal, 100.0 FROM customer WHERE c_custkey % 3 = 0),
al AS (SELECT 'k' || o_custkey AS model, o_orderkey AS pos, (o_orderkey % 90)::DOUBLE AS wr, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 80)::DOUBLE END AS lc, o_orderkey % 2 = 0 AS weighted FROM orders),
al2 AS (SELECT model, arg_max(wr, pos) AS wr, coalesce(arg_max(lc, pos) FILTER (WHERE lc IS NOT NULL), arg_min(wr, pos) FILTER (WHERE lc IS NULL AND weighted)) AS lc FROM al GROUP BY model),
al3 AS (SELECT model, 'AlpacaEval 2.0' AS benchmark, wr AS v FROM al2 UNION ALL SELECT model, 'AlpacaEval 2.0 LC', lc FROM al2 WHERE lc IS NOT NULL),
mt AS (SELECT 'e' || user_id AS model, round(avg(value), 2) AS v, count(DISTINCT event_type) FILTER (WHERE event_type IN ('writing', 'math')) AS n FROM (SELECT user_id, CASE event_type WHEN 'click' THEN 'writing' WHEN 'view' THEN 'math' ELSE event_type END AS event_type, value / 7.0 AS value FROM events) GROUP BY user_id)
SELECT * REPLACE (most::DOUBLE AS most) FROM (SELECT 'evalplus' AS board, organization, model, benchmark, round(CASE WHEN v <= 1 THEN v * 100 ELSE v END, 6) AS score, most, false AS missing, 0::BIGINT AS details FROM ep2 WHERE v IS NOT NULL
UNION ALL SELECT 'wildbench', organization, model, benchmark, v, most, false, 0 FROM wb
UNION ALL SELECT 'swe_bench', '', 's' || s_suppkey, 'SWE-Bench-Verified', CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE (s_nationkey + 1) / 5.0 END, 100.0, s_suppkey % 4 = 0, 3 FROM supplier
UNION ALL SELECT 'alpacaeval2', '', model, benchmark, v, 100.0, false, 0 FROM al3
UNION ALL SELECT 'mt_bench', '', model, 'MT-Bench', round(v, 6), 10.0, false, n FROM mt
UNION ALL SELECT 'chatbot_arena', l_returnflag, 'l' || l_orderkey || '-' || l_linenumber, 'Arena Elo', 1000.0 + floor(l_quantity), 3000.0, false, 3 FROM lineitem)""")
def c12_leaderboards(read):
    judged = F.to_variant_object(F.struct(F.concat(F.lit("e"), "user_id").alias("model_id"), F.expr("CASE event_type WHEN 'click' THEN 'writing' WHEN 'view' THEN 'math' ELSE event_type END").alias("category"), (F.col("value") / 7.0).alias("score")))
    documents = {
        "evalplus": rows(read("part"), "evalplus", DOCUMENTS["evalplus"]), "wildbench": rows(read("customer"), "wildbench", DOCUMENTS["wildbench"]), "swe_bench": rows(read("supplier"), "swe_bench", DOCUMENTS["swe_bench"], "'20240131_s' || s_suppkey"),
        "alpacaeval2": rows(read("orders"), "alpacaeval2", DOCUMENTS["alpacaeval2"], position="o_orderkey"), "chatbot_arena": rows(read("lineitem"), "chatbot_arena", DOCUMENTS["chatbot_arena"]),
        "mt_bench": read("events").select(F.lit("mt_bench").alias("board"), judged.alias("doc"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("at")),
    }
    found = reduce(DataFrame.unionByName, (leaderboards.results(d, "board", "doc", "name", "at", {b: leaderboards.BOARDS[b]}) for b, d in documents.items()))  # a table holds one board
    return found.select("board", "organization", "model", "benchmark", "score", "most", "missing", F.coalesce(F.size(F.map_keys("details")), F.lit(0)).cast("long").alias("details"))


@query("""SELECT 'org/p' || p_partkey AS model_id, 'org' AS developer, 'Own' AS benchmark, CASE WHEN p_size % 2 = 0 THEN 0.0 ELSE CASE WHEN p_size > 1 THEN p_size / 100.0 ELSE p_size END END::DOUBLE AS score, p_size % 2 = 0 AS missing FROM part
UNION ALL SELECT 'maker/s' || s_suppkey, 'maker', 'Chatbot Arena Elo', CASE WHEN s_suppkey % 2 = 0 THEN 1000.0 + s_nationkey ELSE 0.0 END, s_suppkey % 2 = 1 FROM supplier""")
def c13_scraped(read):
    documents = """'{"model": {"name": "org/p' || p_partkey || '"}, "evaluations": {"own": {"name": "Own", "value": ' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE '' || p_size END || '}}}'"""
    battles = """'{"model": "s' || s_suppkey || '", "organization": "maker"' || CASE WHEN s_suppkey % 2 = 0 THEN ', "elo": "1,0' || lpad(s_nationkey, 2, '0') || '"' ELSE '' END || '}'"""
    made = leaderboards.scraped(rows(read("part"), "hfopenllm_v2", documents).unionByName(rows(read("supplier"), "chatbot_arena", battles)), "board", "doc")
    return made.select("model_id", "developer", "benchmark", "score", "missing")
