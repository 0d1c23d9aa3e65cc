"""The schema compiler keyword by keyword, and every repair, on records of the kind that the library reads."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import repair, schema

GOOD = {
    "schema_version": "0.2.1", "evaluation_id": "e", "retrieved_timestamp": "1", "source_metadata": {"source_type": "documentation", "source_organization_name": "o", "evaluator_relationship": "other"},
    "model_info": {"name": "m", "id": "o/m", "developer": "o"}, "eval_library": {"name": "l", "version": "1"},
    "evaluation_results": [{
        "evaluation_name": "MMLU", "source_data": {"dataset_name": "MMLU", "source_type": "hf_dataset"}, "score_details": {"score": 75.5}, "generation_config": {"generation_args": {"shots": 5, "temperature": 0.0}},
        "metric_config": {"metric_name": "acc", "min_score": 0, "max_score": 100, "lower_is_better": False, "level_names": [], "has_unknown_level": False},
    }],
}


def frame(spark, documents):
    rows = [(i, d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "i int, text string").select("i", F.try_parse_json("text").alias("document"))


def errors(spark, rules, documents):
    rows = frame(spark, documents).select("i", schema.schema_errors("document", rules).alias("e")).orderBy("i").collect()
    return [[(e["path"], e["rule"], e["detail"]) for e in r["e"]] for r in rows]


#: A schema, documents that pass it, documents that fail it at the rule named last.
KEYWORDS = [
    ({"type": "integer"}, [1, 1.0, -5], [1.5, "1", True, None], "type"), ({"type": ["string", "null"]}, ["x", "", None], [1, [], {}], "type"), ({"enum": [1, "a", None, True, [1, {"b": 2, "a": 1}]]}, [1, 1.0, "a", None, True, [1, {"a": 1, "b": 2}]], [2, "b", False, [1]], "enum"),
    ({"const": "it's \\ \"q\""}, ["it's \\ \"q\""], ["its"], "const"), ({"minimum": 1}, [1, 2.5, "0"], [0.99, -1], "minimum"), ({"maximum": 1}, [1, -3, None], [1.01], "maximum"), ({"exclusiveMinimum": 1}, [1.1], [1], "exclusiveMinimum"), ({"exclusiveMaximum": 1}, [0.9], [1], "exclusiveMaximum"),
    ({"multipleOf": 0.5}, [1, 1.5, "x"], [1.2], "multipleOf"), ({"minLength": 2}, ["é日", 1], ["é"], "minLength"), ({"maxLength": 2}, ["é日"], ["abc"], "maxLength"), ({"pattern": "^a\\d"}, ["a1z", 3], ["ba1"], "pattern"),
    ({"minItems": 1}, [[1], "x"], [[]], "minItems"), ({"maxItems": 1}, [[1], {}], [[1, 2]], "maxItems"), ({"minProperties": 1}, [{"a": 1}, []], [{}], "minProperties"), ({"maxProperties": 1}, [{"a": 1}], [{"a": 1, "b": 2}], "maxProperties"),
    ({"required": ["a"]}, [{"a": None}, []], [{}, {"b": 1}], "required"), ({"properties": {"a b": {"type": "string"}}}, [{}, {"a b": "x"}, {"c": 1}, 3], [{"a b": 1}], "type"), ({"properties": {"a": {}}, "additionalProperties": False}, [{"a": 1}, {}, 7], [{"b": 1}], "additionalProperties"),
    ({"additionalProperties": {"type": "string"}}, [{"a": "x"}, []], [{"a": 1}], "type"), ({"patternProperties": {"^n_": {"type": "number"}}, "additionalProperties": False}, [{"n_a": 1}], [{"m": 1}], "additionalProperties"), ({"patternProperties": {"^n_": {"type": "number"}}}, [{"m": ""}], [{"n_a": ""}], "type"),
    ({"propertyNames": {"maxLength": 1}}, [{"a": 1}], [{"ab": 1}], "maxLength"), ({"dependencies": {"a": ["b"]}}, [{"b": 1}, {"a": 1, "b": 1}], [{"a": 1}], "required"), ({"dependencies": {"a": {"minProperties": 2}}}, [{"b": 1}], [{"a": 1}], "minProperties"),
    ({"items": {"type": "integer"}}, [[1, 2], [], {}], [[1, "x"]], "type"), ({"items": [{"type": "integer"}, {"type": "string"}]}, [[1], [1, "x", None]], [[1, 2]], "type"), ({"contains": {"const": 1}}, [[0, 1], "x"], [[0], []], "contains"), ({"uniqueItems": True}, [[1, 2], ["1", 1]], [[1, 1]], "uniqueItems"),
    ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1], [0], "minimum"), ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["x", 5], [4], "anyOf"), ({"oneOf": [{"minimum": 5}, {"type": "integer"}]}, [5.5, 1], [5, 1.5], "oneOf"), ({"not": {"type": "string"}}, [1], ["x"], "not"),
    ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 2}}, ["xx", 2], ["x"], "minLength"), ({"definitions": {"a": {"type": "string"}}, "items": {"$ref": "#/definitions/a"}}, [["x"]], [[1]], "type"), ({"properties": {"a": False}}, [{}], [{"a": 1}], "false"),
]


def test_keywords(spark):
    for rules, good, bad, rule in KEYWORDS:
        got = errors(spark, rules, [json.dumps(d) for d in good + bad])
        assert all(e == [] for e in got[: len(good)]), (rules, got)
        assert all(e and e[0][1] == rule for e in got[len(good) :]), (rules, got)


def test_paths_and_odd_documents(spark):
    rules = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {"type": "string"}}, "required": ["c"]}}}}
    got = errors(spark, rules, ['{"a": [{"b": 1, "c": 0}, {"b": "x"}, 3]}', "no json", "[1]", '{"a": null}'])
    assert got == [[("$.a[0].b", "type", "bigint"), ("$.a[1]", "required", "c"), ("$.a[2]", "type", "bigint")], [("$", "json", None)], [("$", "type", "array")], [("$.a", "type", "void")]]
    with pytest.raises(ValueError, match="contains itself"):
        schema.schema_errors("document", {"properties": {"a": {"$ref": "#"}}})
    with pytest.raises(ValueError, match="not understood"):
        schema.schema_errors("document", {"unevaluatedItems": False})


def changed(change):
    d = copy.deepcopy(GOOD)
    change(d)
    return d


RESULT = lambda d: d["evaluation_results"][0]
FAULTY = [
    ("score as number", lambda d: RESULT(d)["score_details"].update(score="75.5"), lambda d: RESULT(d)["score_details"]["score"] == 75.5), ("schema version", lambda d: d.pop("schema_version"), lambda d: d["schema_version"] == "0.2.1"),
    ("schema version", lambda d: d.update(schema_version=0.1), lambda d: d["schema_version"] == "0.2.1"), ("timestamp as text", lambda d: d.update(retrieved_timestamp=17.5), lambda d: d["retrieved_timestamp"] == "17.5"),
    ("source type", lambda d: d["source_metadata"].update(source_type="paper_html"), lambda d: d["source_metadata"]["source_type"] == "documentation"), ("relationship", lambda d: d["source_metadata"].update(evaluator_relationship="unknown"), lambda d: d["source_metadata"]["evaluator_relationship"] == "other"),
    ("library", lambda d: d.pop("eval_library"), lambda d: d["eval_library"] == {"name": "unknown", "version": "unknown"}), ("library version", lambda d: d["eval_library"].update(version=None), lambda d: d["eval_library"] == {"name": "l", "version": "unknown"}),
    ("model id", lambda d: d["model_info"].pop("id"), lambda d: d["model_info"]["id"] == "m"), ("detail as text", lambda d: d["source_metadata"].update(additional_details={"a": 1, "b": True, "c": None, "d": "x"}), lambda d: d["source_metadata"]["additional_details"] == {"a": "1", "b": "True", "c": "None", "d": "x"}),
    ("legacy member moved", lambda d: d.update(validated=False, incorrect_values=["a", 2]), lambda d: d["source_metadata"]["additional_details"] == {"validated": "False", "incorrect_values": "a; 2"} and "validated" not in d),
    ("argument beside", lambda d: RESULT(d)["generation_config"].update(generation_args={"beam": 4, "shots": 1}, additional_details={"beam": "old", "z": "y"}), lambda d: RESULT(d)["generation_config"] == {"generation_args": {"shots": 1}, "additional_details": {"beam": "4", "z": "y"}}),
    ("n_shot as shots", lambda d: RESULT(d)["generation_config"].update(generation_args={"n_shot": 3}), lambda d: RESULT(d)["generation_config"]["generation_args"] == {"shots": 3}),
    ("score bound", lambda d: RESULT(d)["metric_config"].update(min_score=None, max_score=None), lambda d: (RESULT(d)["metric_config"]["min_score"], RESULT(d)["metric_config"]["max_score"]) == (0, 100)),
]


def test_each_repair_and_status(spark):
    beyond = [changed(lambda d: RESULT(d)["score_details"].update(score="none")), changed(lambda d: d.pop("model_info")), "no json", "[]"]
    rows = repair.validated(frame(spark, [GOOD, *(changed(c) for _, c, _ in FAULTY), *beyond])).select("i", "status", "fixes", "errors", F.to_json("document").alias("d")).orderBy("i").collect()
    assert (rows[0]["status"], rows[0]["fixes"], rows[0]["errors"], json.loads(rows[0]["d"])) == ("valid", [], [], GOOD)
    for row, (fix, change, after) in zip(rows[1:], FAULTY, strict=False):
        new, given = json.loads(row["d"]), changed(change)
        assert row["status"] == "fixed" and {f["fix"] for f in row["fixes"]} == {fix} and after(new), (fix, row)
        changed_members = {k for k in set(new) | set(given) if new.get(k) != given.get(k)}
        assert len(changed_members) <= (3 if fix == "legacy member moved" else 1), fix
    assert [r["status"] for r in rows[1 + len(FAULTY) :]] == ["invalid"] * 4 and all(r["errors"] for r in rows[1 + len(FAULTY) :])
    fixable = repair.validated(frame(spark, [changed(FAULTY[0][1])]), write=False).select("status", F.to_json("document").alias("d")).first()
    assert fixable["status"] == "fixable" and RESULT(json.loads(fixable["d"]))["score_details"]["score"] == "75.5"


def test_older_repairs_know_less(spark):
    got = repair.repair(frame(spark, [changed(c) for _, c, _ in FAULTY]), fixes=repair.OLDER_FIXES).orderBy("i").collect()
    assert [bool(r["fixes"]) for r in got] == [f in ("score as number", "schema version", "timestamp as text", "relationship", "library", "model id") for f, _, _ in FAULTY]


def test_records_are_dealt_to_all_tasks(spark):
    from tallyloom.plans import table, validation

    rows = validation.of_json(lambda name: table(spark, "/root/testdata/sf0.001", name)).select("o_orderkey", F.spark_partition_id().alias("p"))
    assert rows.select("p").distinct().count() == 2 * spark.sparkContext.defaultParallelism  # before: as many as the file has row groups


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_statuses_are_not_an_expression_of_lambdas(spark):
    """Before, every record went through lambdas within lambdas: 11 ms of CPU each."""
    rows = frame(spark, [GOOD])
    assert "lambda" not in plan(repair.validated(rows).groupBy("status").count()) and "lambda" not in plan(repair.repair(rows).select("fixes"))


#: Values of every kind and width, with the text that Spark has for them.
VALUES = [None, True, -1, 127, -32768, 2**31, -(2**63), 2**63, 10**38 - 1, "", "x" * 63, "é" * 40, 'q"\\\n\x01\x7f', {}, [], {"b": [1, {"a": None}], "a": {"é": "1", "😀": 2, "ｚ": 3}}, list(range(300)), {f"k{i}": "y" * i for i in range(300)}]
RAW = ["1.50", "-0.25", "1.00", "1e2", "1.5e-7", "1E22", "123456.789e0", "1e400", "12345678901234567890123456789012345678901", "0.00000000000000000000000001"]


def test_values_are_read_written_and_spelled_like_spark(spark):
    from tallyloom.functions import variants

    def texts(column):
        import pyarrow as pa

        return pa.array([variants.to_json(v) for v in variants.values_of(column, variants.Reader())])

    def copies(column):
        return variants.variants_of([None if v is variants.ABSENT else variants.written(v) for v in variants.values_of(column, variants.Reader())])

    docs = [*(json.dumps({"v": v, "w": [v, v]}) for v in VALUES), *(f'{{"v": {r}, "w": [{r}]}}' for r in RAW), *RAW, *map(json.dumps, VALUES), "no json"]
    kinds = lambda c: F.schema_of_variant(F.try_variant_get(c, "$.v", "variant"))
    rows = frame(spark, docs).withColumn("copy", F.arrow_udf(copies, "variant")("document")).select("i", F.to_json("document"), F.to_json("copy"), F.arrow_udf(texts, "string")("document"), kinds("document"), kinds("copy"), F.schema_of_variant("document").alias("s"), F.schema_of_variant("copy").alias("t"))
    for i, text, copy_text, spelled, kind, copy_kind, s, t in rows.collect():
        assert text == copy_text == spelled and kind == copy_kind and s == t, docs[i][:100]


def test_numbers_in_texts_are_those_of_sparks_cast(spark):
    texts = ["1d", "1f", "1.5D", "0x1p3", "0x.8P-1f", "0x1p9999", "1_0", "١", "1e5", " 1\t", "\n1", ".5", "5.", "+1", "-2.50", "1e", "e1", "", "Infinity", "nan", "1e400", "\xa01", "1L", "- 1", "1\x00", "0x10"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.trim("t").try_cast("double").alias("n")).collect()
    assert [repair._finite(r["t"]) for r in rows] == [r["n"] if r["n"] is not None and abs(r["n"]) < float("inf") else None for r in rows]


def test_deep_documents(spark):
    """A query that asked schema_of_variant of a document this deep was seen to end the JVM; checks no longer ask it."""
    deep = '{"a":' * 900 + "[]" + "}" * 900
    assert errors(spark, {"type": "object", "properties": {"a": {"minProperties": 1}}}, [deep]) == [[]]
    row = repair.repair(frame(spark, [deep])).select("fixes", F.to_json("document").alias("d")).first()
    assert [f["fix"] for f in row["fixes"]] == ["schema version", "library"] and row["d"].startswith(deep[:-1])


def test_checks_in_python_and_in_the_jvm_agree(spark):
    """v01's schema was evaluated as one expression of nested lambdas; those that stay are the schemas with patterns."""
    texts = [*(json.dumps(changed(c)) for _, c, _ in FAULTY), json.dumps(GOOD), "no json", "[]", *(json.dumps(changed(lambda d, v=v: RESULT(d).update(source_data=v, metric_config=v))) for v in (None, 1.5, {"source_type": "url", "url": []}, {"score_type": "levels"}))]
    assert "lambda" not in plan(frame(spark, texts).select(schema.schema_errors("document", schema.RECORD_SCHEMA)))
    for rules, docs in [(schema.RECORD_SCHEMA, texts), *((rules, [json.dumps(d) for d in good + bad]) for rules, good, bad, _ in KEYWORDS if not schema.has_patterns(rules))]:
        rows = frame(spark, docs).select("i", schema.schema_errors("document", rules).alias("new"), schema.compiled_errors("document", rules).alias("old")).collect()
        assert all(r["new"] == r["old"] for r in rows), rules


def test_whole_numbers_beyond_64_bits_are_integers(spark):
    for rules in ({"type": "integer"}, {"type": "integer", "patternProperties": {}}):
        assert errors(spark, rules, ["12345678901234567890", "1e30", "1e400"]) == [[], [], [("$", "type", "double")]], rules


def test_schemas_with_patterns_are_javas(spark):
    rules = {"type": "object", "properties": {"a": {"pattern": "^[a-z&&[^b]]+$"}}}
    rows = repair.validated(frame(spark, ['{"a": "xyz"}', '{"a": "abc"}']), schema=rules).select("i", "status", "errors").orderBy("i").collect()
    assert [r["status"] for r in rows] == ["valid", "invalid"] and [e["rule"] for e in rows[1]["errors"]][0] == "pattern"


def test_records_are_repaired_once(spark):
    """Before, v10 and v11 repaired every record twice, once in as many tasks as the file has row groups."""
    from tallyloom.plans import QUERIES

    assert all(QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 for q in ("v10_fixes", "v11_older_fixes"))
