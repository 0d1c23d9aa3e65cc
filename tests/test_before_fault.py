"""Results before a fault, and every family of models."""

import json

from pyspark.sql import functions as F

from tallyloom.functions import normalize
from tallyloom.sources import readers


def test_results_before_fault(spark, tmp_path):
    one = lambda i: {"evaluation_name": f"é{i}", "score_details": {"score": i}}
    whole = json.dumps({"model_info": {"name": "m"}, "evaluation_results": [one(0), one(1)], "after": [1]}, ensure_ascii=False)
    broken = '{"id": 1, "evaluation_results": [' + json.dumps(one(0)) + ", " + json.dumps(one(1)) + ', {"evaluation_name": oops}, ' + json.dumps(one(3)) + "]}"
    files = {
        "a/whole.json": whole, "a/broken.json": broken, "b/text.json": '{"evaluation_results": [{"a": 1}, 7, {"b": 2}]}', "b/none.json": '{"x": 1}', "b/cut.json": broken[:60], "b/empty.json": "", "b/tail.json": '{"evaluation_results": [{"a": 1}] oops',
        "b/no.json": '{"evaluation_results": []}', "samples/x.json": whole, "aggregated/x.json": whole, "b/naive/x.json": whole, "b/x.txt": whole,
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = readers.results_before_fault(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault("/".join(r["file"].split("/")[-2:]), []).append(r)
    sound = {k: [json.loads(r["result"]) for r in sorted(v, key=lambda r: (r["n"] is None, r["n"])) if r["result"]] for k, v in by.items()}
    assert sound == {"a/whole.json": [one(0), one(1)], "a/broken.json": [one(0), one(1)], "b/text.json": [{"a": 1}], "b/none.json": [], "b/cut.json": [], "b/tail.json": [{"a": 1}]}
    faults = {k: next((r["offset"] for r in v if r["fault"]), None) for k, v in by.items()}
    assert faults["a/whole.json"] is None and faults["a/broken.json"] == broken.index("oops") and faults["b/text.json"] == files["b/text.json"].index("7") and all(faults[k] is not None for k in sound if k != "a/whole.json")
    for r in by["a/whole.json"]:
        assert json.loads(r["head"]) == {"model_info": {"name": "m"}} and json.JSONDecoder().raw_decode(whole, r["offset"])[0] == json.loads(r["result"])


def test_families(spark):
    cases = {"Llama-3-8B": "meta-llama", "CodeLlama-7b": "meta-llama", "Qwen2.5-7B": "Qwen", "mixtral-8x7b": "mistralai", "gpt-j-6b": "EleutherAI", "gpt-4": "openai", "my-org/phi-3": "microsoft", "zephyr": "unknown", "tulu-3": "allenai", "x-vicuna": "lmsys"}
    got = spark.createDataFrame([(k,) for k in cases], "n string").select("n", normalize.developer(F.col("n"), F.lit(None).cast("string")).alias("d")).collect()
    assert {r["n"]: r["d"] for r in got} == cases
