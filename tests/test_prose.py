"""Answers read out of prose, of every layout."""

import json

from pyspark.sql import functions as F

from tallyloom.operators import prose


def test_answers_of_every_layout(spark):
    answers = [
        {"global_config": {"eval_harness": "N/A", "seed": 7, "eval_harness_applies_to_all": False}, "models": [
            {"model_name": " Unknown ", "benchmarks": [{"benchmark_name": "X"}]}, {"model_name": "m", "developer": "null", "is_baseline": True, "benchmarks": [
                {"benchmark_name": "MMLU", "score": "71.5", "n_shot": 5.0, "temperature": "hot", "lower_is_better": False}, {"benchmark_name": "", "score": 1}, 3, {"benchmark_name": "GSM8K", "score": "n.a.", "n_shot": "few"}]},
            {"model_name": "none", "benchmarks": []}, "text"]},
        {"benchmarks": [{"benchmark_name": "BBH", "score": 3, "score_range": "0-1"}]}, {"n_shot": 3, "prompt_template": "not found"}, {"n_shot": 3, "global_config": {"seed": 1}}, {"models": "no"}, [], None,
    ]
    df = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(answers)], "i int, j string").select("i", F.parse_json("j").alias("a"))
    got = [(r.m, r.c) for r in df.orderBy("i").select(prose.models(F.col("a")).alias("m"), prose.configuration(F.col("a")).alias("c")).collect()]
    ((m,), c), rest = got[0], got[1:]
    assert c == {"seed": "7", "eval_harness_applies_to_all": "false"} and (m.model_name, m.developer, m.is_baseline) == ("m", None, True)
    assert [(b.benchmark_name, b.score, b.n_shot, b.temperature, b.lower_is_better, b.faults) for b in m.benchmarks] == [("MMLU", 71.5, 5, None, False, ["temperature"]), ("GSM8K", None, None, None, None, ["n_shot"])]
    assert [(x.model_name, b.benchmark_name, b.score, b.score_range, b.n_shot, b.prompt_template) for ms, _ in rest for x in ms for b in x.benchmarks] == [("unknown", "BBH", 3.0, None, None, None), ("unknown", "unknown", None, None, 3, None)]
    assert [len(ms) for ms, _ in rest] == [1, 1, 0, 0, 0, 0]


def test_rows_equal_models_and_an_answer_is_computed_once(spark):
    odd = {"benchmark_name": "B", "n_shot": {"a": 1}, "temperature": [1], "score": True, "lower_is_better": "yes", "eval_harness": 4}
    answers = [
        {"models": [{"model_name": "m", "developer": 3, "is_baseline": "true", "benchmarks": [odd, None, {"benchmark_name": 7, "n_shot": "7.5", "lower_is_better": "true"}, {"benchmark_name": "C", "n_shot": 1e300}]}, {"model_name": "n/a", "benchmarks": [odd]}, None]},
        {"models": [{"model_name": "m", "benchmarks": [{"benchmark_name": "null"}]}], "benchmarks": [odd | {"metric_name": "acc"}, [odd]]}, {"seed": 3, "benchmark_name": "lost", "temperature": "0.5", "score": 9}, {"models": {}, "benchmarks": 3}, "x", None,
    ]
    df = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(answers)], "i int, j string")
    parsed = F.parse_json("j")
    got = sorted(map(repr, prose.rows(df, parsed, "i").collect()))
    inside = df.select("i", F.explode(prose.models(parsed)).alias("m")).select("i", *(f"m.{k}" for k in prose.MODEL_FIELDS), F.explode("m.benchmarks").alias("b")).select("i", *prose.MODEL_FIELDS, "b.*")
    assert got == sorted(map(repr, inside.collect())) and len(got) == 5
    assert {(r.i, r.benchmark_name): (r.score, r.n_shot, r.temperature, r.lower_is_better, r.eval_harness, tuple(r.faults)) for r in inside.collect()} == {
        (0, "B"): (None, None, None, True, "4", ("n_shot", "temperature")), (0, "7"): (None, None, None, True, None, ("n_shot",)), (0, "C"): (None, None, None, None, None, ("n_shot",)),
        (1, "B"): (None, None, None, None, None, ("n_shot", "temperature")), (2, "unknown"): (None, None, 0.5, None, None, ()),
    }
    assert str(prose.models(parsed)).count("parse_json") == 1
