"""Converters against Python's own json and hand-made logs."""

import hashlib
import json

from pyspark.sql import functions as F

from tallyloom.functions.normalize import scoring_mode
from tallyloom.functions.textmeta import json_text, prompt_hash
from tallyloom.operators import converters as c

TEXTS = ["", "plain", 'quote " and \\ slash', "line\nfeed\ttab\r\b\f", "del \x7f nul \x00 bell \x07", "naïve – 中文", "beyond 😀 pair", None]


def test_json_text_is_pythons(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", json_text(F.col("t")).alias("j")).collect()
    for r in rows:
        assert r.j == (None if r.t is None else json.dumps(r.t))


def test_prompt_hash_drops_blanks_at_line_ends(spark):
    got = spark.createDataFrame([("a \t\r\nb",)], "t string").select(prompt_hash(F.col("t")).alias("h")).first().h
    assert got == hashlib.sha256(b"a\nb").hexdigest()


def test_scoring_mode_of_a_task(spark):
    got = spark.createDataFrame([("multiple_choice",), ("generate_until",), (None,)], "t string").select(scoring_mode(F.col("t")).alias("m")).collect()
    assert [r.m for r in got] == ["log-likelihood", "generation", "unknown"]


def test_leaf_tasks_without_results_go(spark):
    log = '{"group": {"alias": "g", " ": " "}, "err": {"acc_stderr,none": 0.1, "alias": "e"}, "text": {"acc,none": "0.5"}, "ok": {"acc,none": 1}, "flag": {"pass": true}, "none": {}}'
    row = spark.createDataFrame([(log,)], "j string").select(F.map_keys(c.leaf_tasks(F.from_json("j", "map<string,map<string,variant>>"))).alias("k")).first()
    assert sorted(row.k) == ["flag", "ok"]


def test_sample_without_a_numeric_metric_scores_zero(spark):
    logs = [
        {"metrics": ["acc"], "acc": "1.0", "target": 7, "doc_id": 3}, {"metrics": ["f1", "acc"], "acc": 1, "f1": 0.25}, {"metrics": ["acc"], "acc": True, "filter": "strict", "target": "é"}, {},
    ]
    s = c.harness_sample(F.from_json("j", "map<string,variant>"), F.lit("t"), F.lit("q"), F.lit("a"))
    got = [r.s for r in spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(logs)], "i int, j string").orderBy("i").select(s.alias("s")).collect()]
    assert [(r.evaluation.score, r.evaluation.is_correct) for r in got] == [(0.0, False), (0.25, False), (1.0, True), (0.0, False)]
    assert [r.evaluation_name for r in got] == ["t", "t", "t/strict", "t"]
    assert [r.sample_id for r in got] == ["3", "0", "0", "0"]
    for r, target in zip(got, ["7", "", "é", ""], strict=True):
        assert r.sample_hash == hashlib.sha256(json.dumps({"raw": "q", "reference": target}, sort_keys=True).encode()).hexdigest()
    assert got[0].metadata["lm_eval_metrics"] == '{"acc":"1.0"}'


def test_messages_without_calls(spark):
    part, call = "struct<type:string,text:string,reasoning:string>", "struct<id:string,function:string,arguments:map<string,string>>"
    turn = f"struct<role:string,content:string,parts:array<{part}>,tool_calls:array<{call}>,tool_call_id:string>"
    turns = [("system", "s", None, None, "x"), ("assistant", None, [("text", "one", None), ("text", "two", None)], [("1", "f", {})], "x"), ("assistant", "c", None, None, None), ("tool", "r", None, None, "1")]
    got = spark.createDataFrame([(turns,)], f"t array<{turn}>").select(c.messages(F.col("t")).alias("m")).first().m
    assert [(m.content, m.reasoning_trace) for m in got] == [("s", None), ("two", None), ("c", None), ("r", None)]
    assert [len(m.tool_calls) for m in got] == [0, 1, 0, 0] and got[1].tool_calls[0].arguments is None
    assert [m.tool_call_id for m in got] == [None, None, None, ["1"]]


def test_first_object(spark):
    texts = ['x {"a": {"b": 1}} {"c": 2}', "```json\n{\"a\": 1}\n```", "{ open {", "none", "{bad}", '} {"a": "}"}', None]
    got = [r.o for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(c.first_object(F.col("t")).alias("o")).collect()]
    assert got == ['{"a": {"b": 1}}', '{"a": 1}', None, None, None, None, None]


def test_instances_without_stats_or_completions(spark):
    ref = "struct<text:string,tags:array<string>>"
    states = spark.createDataFrame([("a", "p", [("yes", ["correct"])], ["yes"], 1.5), ("b", "p", [("yes", ["correct"])], None, 0.0), ("c", "p", [], [" yes "], None)], f"instance_id string, prompt string, references array<{ref}>, completions array<string>, request_time double")
    stats = spark.createDataFrame([("b", 1, [("other", 1.0, 1.0)]), ("c", 2, [("exact_match", 0.0, 0.0)]), ("c", 1, [("exact_match", 1.0, 1.0)])], "instance_id string, at int, stats array<struct<name:string,mean:double,sum:double>>")
    got = {r.sample_id: r for r in c.instance_rows(states, stats).collect()}
    assert {k: (r.score, r.is_correct, r.extracted_value) for k, r in got.items()} == {"a": (0.0, False, "yes"), "b": (0.0, False, ""), "c": (1.0, True, "yes")}
    assert got["a"].token_usage is None and got["a"].generation_time_ms == 1500.0 and got["b"].generation_time_ms is None
