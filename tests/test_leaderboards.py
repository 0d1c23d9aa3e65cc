"""Leaderboards of every layout against hand-made documents."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import leaderboards as lb
from tallyloom.operators.stats import py_round


@pytest.fixture(scope="module")
def read(spark):
    def made(*documents):
        rows = [(b, json.dumps(d), n, i) for i, (b, d, n) in enumerate(documents)]
        df = spark.createDataFrame(rows, "board string, doc string, name string, at int").withColumn("doc", F.parse_json("doc")).withColumn("extra", F.lit(1))
        return lb.results(df, "board", "doc", "name", "at").collect()

    return made


def scores(rows):
    return sorted((r.board, r.organization, r.model, r.benchmark, r.score) for r in rows)


def test_py_round_is_pythons(spark):
    rng = random.Random(3)
    xs = [rng.uniform(-100, 100) for _ in range(500)] + [rng.randint(-(10**6), 10**6) / 1000 for _ in range(2000)] + [k + 0.125 for k in range(40)] + [k + 0.5 for k in range(40)] + [0.0, 1e-9, 1e15, 2.675]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", py_round(F.col("x"), 2).alias("two"), py_round(F.col("x"), 0).alias("none")).collect()
    assert all(r.two == round(r.x, 2) and r.none == round(r.x, 0) for r in got)


def test_evalplus_has_three_layouts(read):
    keyed = {"org/a": {"pass@1": {"humaneval+": 0.0, "mbpp+": 71.5}}, "b": {"pass@1": {"humaneval+": "0.884"}}, "c": {"pass@1": {}}}
    flat = [{"model": "x/d", "humaneval+": 0.5, "MBPP+": 60}, {"name": "e", "humaneval+": 0}, {"mbpp+": 3}, {"model": "f", "humaneval+": True}]
    nested = {"models": [{"name": "g", "pass@1": {"humaneval+": 0, "mbpp+": 40}, "humaneval+": 12.345}]}
    got = scores(read(("evalplus", keyed, None), ("evalplus", flat, None), ("evalplus", nested, None), ("evalplus", {}, None), ("evalplus", [], None)))
    assert got == sorted([
        ("evalplus", "org", "a", "HumanEval+", 0.0), ("evalplus", "org", "a", "MBPP+", 71.5), ("evalplus", "", "b", "HumanEval+", 88.4), ("evalplus", "x", "d", "HumanEval+", 50.0), ("evalplus", "x", "d", "MBPP+", 60.0),
        ("evalplus", "", "g", "HumanEval+", round(12.345, 2)), ("evalplus", "", "g", "MBPP+", 40.0),
    ])


def test_wildbench_has_three_layouts(read):
    keyed, flat, rows = {"o/a": {"score": 7.126, "adjusted_score": -3}}, [{"model_id": "b", "wb_score": 0, "score": 5}, {"model": "c", "wb_score": -12.5}, {"model": "d"}], {"rows": [{"row": {"model_id": "e", "wb_score": 56.4}}]}
    got = read(("wildbench", keyed, None), ("wildbench", flat, None), ("wildbench", rows, None))
    assert scores(got) == sorted([("wildbench", "o", "a", "WildBench v2", 7.13), ("wildbench", "o", "a", "WildBench v2 (adj)", -3.0), ("wildbench", "", "b", "WildBench v2", 5.0), ("wildbench", "", "c", "WildBench v2", -12.5), ("wildbench", "", "e", "WildBench v2", 56.4)])
    assert {(r.model, r.benchmark): (r.least, r.most) for r in got}[("c", "WildBench v2")] == (-100.0, 100.0)


def test_submissions_without_a_list_score_zero(read):
    got = {r.model: r for r in read(("swe_bench", {"resolved": ["x"] * 12}, "20240131_some_agent"), ("swe_bench", {}, "plain"), ("swe_bench", {"resolved": 3}, "2024_bad"))}
    assert set(got) == {"some_agent", "plain"} and got["some_agent"].score == 2.4 and got["some_agent"].eval_date == "2024-01-31"
    assert got["plain"].score == 0.0 and got["plain"].missing and not got["some_agent"].missing
    assert got["some_agent"].details == {"resolved": "12", "total": "500", "submission": "20240131_some_agent"}


def test_alpaca_rows_of_a_model_come_together(read):
    rows = [
        {"model": "a", "win_rate": "10", "mode": "weighted_x"}, {"model": "a", "win_rate": "20", "mode": "weighted_y"}, {"": "b", "win_rate": "1.005", "length_controlled_winrate": "30"},
        {"model": "b", "win_rate": "5", "mode": "lc"}, {"model": "c", "win_rate": "n/a"}, {"win_rate": "3"},
    ]
    got = scores(read(*(("alpacaeval2", r, None) for r in rows)))
    assert [x[2:] for x in got] == [("a", "AlpacaEval 2.0", 20.0), ("a", "AlpacaEval 2.0 LC", 10.0), ("b", "AlpacaEval 2.0", 5.0), ("b", "AlpacaEval 2.0 LC", 30.0)]


def test_judgements_are_averaged(read):
    rows = [("a", "math", "4"), ("a", "math", "7"), ("a", "stem", 9), ("a", "other", 1), ("a", "math", "none"), ("b", "math", None), (None, "math", 3)]
    (got,) = read(*(("mt_bench", {"model_id": m, "category": c, "score": s}, None) for m, c, s in rows))
    assert (got.model, got.score, got.details) == ("a", 5.25, {"math": "5.5", "stem": "9.0"})


def test_tables_of_single_rows(read):
    got = read(
        ("chatbot_arena", {"Model": "m ", "Arena Score": "1200.5", "Organization": "Org", "95% CI": "+5/4", "Votes": "1,234"}, None), ("chatbot_arena", {"Model": "n", "Arena Score": "?"}, None),
        ("bfcl", {"Model": "m", "Overall Acc": "70.126%", "Non-Live AST Acc": "x", "Live Overall Acc": "60", "Latency Mean (s)": "2"}, None), ("bfcl", {"Model": "n", "Overall Acc": "", "Live Overall Acc": "60"}, None),
        ("bigcodebench", {"model": "o/m", "complete": 0.5, "instruct": None, "date": "2024/05/06"}, None), ("open_llm_leaderboard_v2", {"fullname": "o/m", "IFEval": 12.345, "BBH": "nan", "GPQA": 0}, None),
        ("unknown", {"model": "m"}, None), ("bfcl", None, None),
    )
    assert scores(got) == sorted([
        ("chatbot_arena", "Org", "m", "Arena Elo", 1200.5), ("bfcl", "", "m", "BFCL-v3", 70.13), ("bfcl", "", "m", "BFCL-v3 Live", 60.0), ("bigcodebench", "o", "m", "BigCodeBench-Complete", 50.0),
        ("open_llm_leaderboard_v2", "o", "m", "IFEval (strict-prompt)", round(12.345, 2)), ("open_llm_leaderboard_v2", "o", "m", "GPQA-Diamond", 0.0),
    ])
    by = {(r.board, r.benchmark): r for r in got}
    assert by["chatbot_arena", "Arena Elo"].details == {"ci_upper": "1205.5", "ci_lower": "1196.5", "num_battles": "1234"}
    assert by["bfcl", "BFCL-v3"].details == {"Latency Mean (s)": "2"} and by["bigcodebench", "BigCodeBench-Complete"].eval_date == "2024-05-06"


def test_live_rows_join_by_model(spark):
    frame = lambda rows: spark.createDataFrame([(json.dumps(r), i) for i, r in enumerate(rows)], "j string, at int").select(F.parse_json("j").alias("row"), "at", F.lit("bfcl").alias("board"), F.lit(None).cast("string").alias("n"))
    both = lb.live_rows(frame([{"Model": "a", "Overall Acc": "1"}, {"Model": "b", "Overall Acc": "2"}]), frame([{"Model": " a", "Live Overall Acc": "3"}, {"Model": "a", "Live Overall Acc": "4%"}, {"Model": "c", "Live Overall Acc": "5"}]), "row", "at")
    assert [x[2:] for x in scores(lb.results(both, "board", "row", "n", "at").collect())] == [("a", "BFCL-v3", 1.0), ("a", "BFCL-v3 Live", 4.0), ("b", "BFCL-v3", 2.0)]


def test_scraped_rows_keep_zero_for_missing(spark):
    rows = [
        ("alpacaeval2", {"name": "gpt-4", "lc_win_rate": "50.2%", "win_rate": 0}), ("alpacaeval2", {"name": "x/y", "win_rate": "12"}), ("chatbot_arena", {"Model": "llama-3", "elo": "1,100"}), ("chatbot_arena", {"Model": "q", "developer": "D"}),
        ("mt_bench", {"model": "claude", "score": 0, "average": 8.1}), ("bigcodebench", {"model": "q", "pass@1": "1,0", "backend": " HF "}), ("bigcodebench", {"model": "none"}), ("wildbench", {"model": "w", "score": "x", "reward": 3}),
        ("hfopenllm_v2", {"model": {"name": "o/m"}, "evaluations": {"ifeval": {"value": 55.5}, "own": {"name": "Own", "value": None}}}), ("hfopenllm_v2", {"model": {"name": "m"}, "evaluations": {"ifeval": {"value": 1}}}),
    ]
    df = spark.createDataFrame([(b, json.dumps(r)) for b, r in rows], "board string, j string").select("board", F.parse_json("j").alias("row"))
    got = sorted((r.board, r.model_id, r.developer, r.platform or "", r.benchmark, r.score, r.missing) for r in lb.scraped(df, "board", "row", {"q": "known/q"}).collect())
    assert got == sorted([
        ("alpacaeval2", "openai/gpt-4", "openai", "", "AlpacaEval LC Win Rate", 0.502, False), ("alpacaeval2", "x/y", "x", "", "AlpacaEval LC Win Rate", 0.0, True), ("alpacaeval2", "x/y", "x", "", "AlpacaEval Win Rate", 0.12, False),
        ("chatbot_arena", "meta-llama/llama-3", "meta-llama", "", "Chatbot Arena Elo", 1100.0, False), ("chatbot_arena", "known/q", "known", "", "Chatbot Arena Elo", 0.0, True), ("mt_bench", "anthropic/claude", "anthropic", "", "MT-Bench", 8.1, False),
        ("bigcodebench", "known/q", "known", "hf", "BigCodeBench", 10.0, False), ("wildbench", "unknown/w", "unknown", "", "WildBench-v2 WB-Score", 3.0, False),
        ("hfopenllm_v2", "o/m", "o", "huggingface", "IFEval", 0.555, False), ("hfopenllm_v2", "o/m", "o", "huggingface", "Own", 0.0, True),
    ])


def test_py_round_next_to_halves(spark):
    rng = random.Random(11)
    halves = [(rng.randint(-(10**rng.randint(1, 9)), 10**9) + 0.5) / 10**d for d in range(7) for _ in range(60)]
    xs = [y for x in halves for y in (x, math.nextafter(x, math.inf), math.nextafter(x, -math.inf))] + [2.0**52 + 0.5, 2.0**46 / 100 + 0.005, -0.0, 0.29, 1.005, 4.35]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(py_round(F.col("x"), d).alias(f"d{d}") for d in range(7))).collect()
    assert all(r[f"d{d}"] == round(r.x, d) for r in got for d in range(7) if abs(r.x) < 2.0**53 / 10**d)


def test_one_board_alone(spark):
    """A registry of a board whose rows are put together, and one of a board with single rows."""
    frame = lambda board, rows: spark.createDataFrame([(board, json.dumps(r), i) for i, r in enumerate(rows)], "b string, j string, at int").select("b", "at", F.parse_json("j").alias("d"), F.lit(None).cast("string").alias("n"))
    alone = lambda board, rows: lb.results(frame(board, rows), "b", "d", "n", "at", {board: lb.BOARDS[board]})
    assert [x[2:] for x in scores(alone("alpacaeval2", [{"model": "a", "win_rate": "10"}, {"model": "a", "win_rate": "20"}]).collect())] == [("a", "AlpacaEval 2.0", 20.0)]
    arena = alone("chatbot_arena", [{"Model": "m", "Arena Score": "1200.25", "95% CI": "±3"}, {"Model": "n", "Arena Score": 7, "95% CI": "-"}, {"Model": "o"}])
    assert {r.model: (r.score, r.details) for r in arena.collect()} == {"m": (1200.25, {"ci_upper": str(round(1203.25, 1)), "ci_lower": str(round(1197.25, 1)), "num_battles": "0"}), "n": (7.0, {"num_battles": "0"})}
