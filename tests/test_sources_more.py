"""Readers and writers of files in odd shapes, and the outcome of repairs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import effects, papers
from tallyloom.operators.records import RECORD
from tallyloom.sources import readers, sinks


def test_lines_and_encodings(spark, tmp_path):
    missing = []
    assert readers.json_lines(spark, str(tmp_path / "none"), "a int", missing=missing).collect() == [] and missing == [str(tmp_path / "none")]
    (tmp_path / "x.jsonl").write_text('{"status": "ok", "score": 1}\n{"status": "ok"}\n{"status": "bad", "score": 2}\nbroken\n')
    assert [r.score for r in readers.scored_lines(spark, str(tmp_path / "x.jsonl"), "status string, score double").collect()] == [1.0]
    (tmp_path / "a.csv").write_bytes("﻿name,b\né,1\n".encode())
    (tmp_path / "b.csv").write_bytes("name,b\né“,1\n".encode("cp1252"))
    for file, name in (("a.csv", "é"), ("b.csv", "é“")):
        assert [tuple(r) for r in readers.csv_any(spark, str(tmp_path / file)).select("name", "b").collect()] == [(name, "1")]


def test_pinned_and_newest(spark, tmp_path):
    spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "n string, v int").coalesce(1).write.parquet(str(tmp_path / "t"))
    digest = hashlib.sha256(next((tmp_path / "t").glob("part-*.parquet")).read_bytes()).hexdigest()
    assert [r.v for r in readers.pinned_rows(spark, str(tmp_path / "t"), digest, "n", ["a", "b"], "n").collect()] == [1, 2]
    with pytest.raises(ValueError):
        readers.pinned_rows(spark, str(tmp_path / "t"), "0" * 64, "n", ["a"], "n")
    for day, body in (("20240101", "x\n1\n"), ("20240301", "x\n"), ("20240201", "x\n2\n")):
        (tmp_path / f"board_{day}.csv").write_text(body)
    get = lambda p: readers.csv_text(spark, p)
    assert readers.newest(spark, str(tmp_path), "board_", ".csv", get).first().x == "2"
    assert readers.newest(spark, str(tmp_path), "board_", ".csv", get, tries=1) is None and readers.newest(spark, str(tmp_path / "no"), "b", "c", get) is None


def test_model_card(spark):
    card = """---
library_name: x
model-index:
- name: m
  results:
  - dataset: {name: MMLU, args: 5-shot}
    metrics:
    - {type: acc, value: 61.5, verified: true}
    - {type: f1, name: F1 CoT, value: "0.5"}
    - {type: bad, value: n/a}
  - dataset: plain
    metrics: [{value: 3}]
---
text"""
    rows = spark.createDataFrame([(1, card), (2, "no front"), (3, "---\n: [\n---"), (4, None)], "i int, t string")
    got = {r.i: r.r for r in rows.select("i", readers.card_results(readers.front_matter(F.col("t"))).alias("r")).collect()}
    assert [(x.benchmark, x.metric_name, x.score, x.verified, x.shots, x.chain_of_thought) for x in got[1]] == [("MMLU", "acc", 61.5, True, 5, None), ("MMLU", "F1 CoT", 0.5, False, 5, True), ("plain", "accuracy", 3.0, False, None, None)]
    assert not got[2] and not got[3] and not got[4]


def test_pages_and_detection(spark):
    html = "<html><title>About Foo</title><h1 class=x>Foo <b>Big</b></h1><p>one</p><h2>Set up</h2>two <i>three</i></html>"
    r = spark.range(1).select(readers.sections(F.lit(html)).alias("s"), readers.title_fits(F.lit(html), F.lit("the Foo-Bar model")).alias("a"), readers.title_fits(F.lit(html), F.lit("Qux")).alias("b")).first()
    assert [tuple(x) for x in r.s] == [("foo big", "one"), ("set up", "two three")] and r.a and not r.b
    assert readers.framework("d", set(), {"run_spec.json", "scenario_state.json"}) == "helm" == readers.framework("d", set(), {"sub"}, {"run_spec.json"})
    assert readers.framework("d", set(), {"results_1.json"}) == "lm_eval" and readers.framework("x.json", {"a"}) == "unknown"


def test_record_trees_and_paths(spark, tmp_path):
    (tmp_path / "t/p").mkdir(parents=True)
    for name, doc in (("a", {"id": "1"}), ("b", [1]), ("summary", {"id": "2"})):
        (tmp_path / f"t/p/{name}.json").write_text(json.dumps(doc))
    (tmp_path / "l.jsonl").write_text('{"id": "9"}\n')
    read = lambda *trees: [r.id for r in readers.paper_records(spark, [str(tmp_path / t) for t in trees], str(tmp_path / "l.jsonl"), "id string").collect()]
    assert read("none", "t") == ["1"] and read("none") == ["9"]
    shape = "{} long, title string, model string, benchmark string"
    want = spark.createDataFrame([(1, "Big_Model_Report", "Foo-7B-Chat", "MMLU"), (2, "Other", "Foo-7B-Chat", None), (3, "Big Model Report", "Foo-7B-Chat", "MM"), (4, "Big Model", "Foo-7B-Chat", "MMLU")], shape.format("w"))
    have = spark.createDataFrame([(5, "Big model", "foo chat 7b", "MMLU-Pro"), (6, "Big Model Report", "Foo-Chat-7B", "mmlu"), (7, "Big Model Report", "Bar", "MMLU"), (8, None, None, None)], shape.format("h"))
    assert {r.w: r.h for r in readers.record_at(want, have).collect()} == {1: 6, 2: None, 3: 6, 4: 5}


def test_counted_sink_and_repair(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    assert sinks.valid_only(rows, F.col("a") > 1, str(tmp_path / "ok"), str(tmp_path / "no")) == {"written": 1, "rejected": 2}
    good = {"schema_version": "0.2.1", "evaluation_id": "e", "retrieved_timestamp": "1", "source_metadata": {"source_type": "documentation"}, "eval_library": {"name": "x", "version": "1"}, "model_info": {"name": "m", "id": "m"}}
    good["evaluation_results"] = [{"evaluation_name": "b", "metric_config": {"score_type": "continuous", "min_score": 0.0, "max_score": 1.0}, "score_details": {"score": 0.5}}]
    broken = {k: v for k, v in good.items() if k != "evaluation_id"}
    mended = {**good, "source_metadata": {"source_type": "paper_html"}}
    records = spark.createDataFrame([(json.dumps(x),) for x in (good, mended, broken)], "j string").select(F.from_json("j", RECORD).alias("r")).select("r.*")
    assert sorted(r.status for r in papers.repaired(records).collect()) == ["fixed", "invalid", "valid"]
    assert sorted(r.status for r in papers.repaired(records, repair=False).collect()) == ["fixable", "invalid", "valid"]
    r = papers.pass_rate(papers.repaired(records)).first()
    assert (r.total, r.valid, r.fixed, r.invalid) == (3, 1, 1, 1) and abs(r.pass_rate - 2 / 3) < 1e-9


def test_names_in_both_directions(spark):
    flags = spark.createDataFrame([("Foo-7B-chat",), ("Bar",), ("Qux",), (None,)], "name string")
    deltas = spark.createDataFrame([("foo-7b", 1.0), ("bar-large", 2.0), ("foo", 3.0)], "other string, delta double")
    assert {r["name"]: r.delta for r in effects.named_in(flags, deltas, "name", "other", "delta").collect()} == {"Foo-7B-chat": 1.0, "Bar": 2.0, "Qux": None, None: None}
    assert effects.longest_within(flags, "name", deltas.where("false"), "other", "delta").where("delta IS NOT NULL").count() == 0
