"""Queries of schema validation and repair: every order becomes a JSON record, with faults that follow from its columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import repair, schema
from tallyloom.plans import query, spread

K = "CAST(o_orderkey AS STRING)"
RESULT = f"""'{{"evaluation_name":"MMLU","source_data":{{"dataset_name":"MMLU","source_type":"' || CASE WHEN o_orderkey % 23 = 0 THEN 'disk' ELSE 'hf_dataset' END || '"}},"metric_config":{{"metric_name":"acc","lower_is_better":false'
|| CASE WHEN o_orderkey % 6 = 0 THEN ',"score_type":"continuous"' ELSE '' END || CASE WHEN o_orderkey % 12 = 0 THEN '' ELSE ',"min_score":0' END || ',"max_score":' || CASE WHEN o_orderkey % 19 = 0 THEN 'null' ELSE '500000' END
|| '}},"score_details":{{"score":' || CASE WHEN o_orderkey % 4 = 0 THEN '"' || CAST(o_custkey AS STRING) || '"' ELSE CAST(o_custkey AS STRING) END || '}},"generation_config":{{"generation_args":{{'
|| CASE WHEN o_orderkey % 8 = 0 THEN '"n_shot":5,' WHEN o_orderkey % 8 = 1 THEN '"warmup":true,' ELSE '' END || '"max_tokens":' || CAST(o_orderkey % 50 AS STRING) || '}}}}}}'"""
#: One record an order, in SQL that both engines read alike.
RECORD = f"""'{{' || CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 = 1 THEN '"schema_version":"0.1.0",' ELSE '"schema_version":"0.2.1",' END || '"evaluation_id":"e' || {K} || '","retrieved_timestamp":'
|| CASE WHEN o_orderkey % 5 = 0 THEN {K} ELSE '"' || {K} || '"' END || ',"source_metadata":{{"source_type":"' || CASE o_orderstatus WHEN 'F' THEN 'evaluation_run' WHEN 'O' THEN 'evaluation_platform' ELSE 'paper_html' END
|| '","source_organization_name":"o","evaluator_relationship":"' || CASE o_orderpriority WHEN '1-URGENT' THEN 'unknown' WHEN '2-HIGH' THEN 'self_reported' WHEN '5-LOW' THEN 'rival' ELSE 'other' END || '"'
|| CASE WHEN o_orderkey % 3 = 0 THEN ',"additional_details":{{"k":' || CAST(o_custkey AS STRING) || ',"t":"x"}}' ELSE '' END || '}},'
|| CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 11 = 1 THEN '"eval_library":{{"name":"l","version":null}},' ELSE '"eval_library":{{"name":"l","version":"1"}},' END
|| '"model_info":{{"name":"m"' || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE ',"id":"o/m"' END || '}},' || CASE WHEN o_orderkey % 17 = 0 THEN '"validated":true,' ELSE '' END || '"evaluation_results":[' || {RESULT} || ']}}'"""

ARGS, CONFIG, SCORE, META = "'$.evaluation_results[0].generation_config.generation_args", "'$.evaluation_results[0].metric_config", "'$.evaluation_results[0].score_details.score'", "'$.source_metadata"
#: Errors in terms of DuckDB's JSON functions: path, rule, the name concerned, and when it holds.
FAULTS = [
    ("$", "required", "schema_version", "NOT json_exists(j, '$.schema_version')"), ("$", "required", "eval_library", "NOT json_exists(j, '$.eval_library')"), ("$", "additionalProperties", "validated", "json_exists(j, '$.validated')"),
    ("$.retrieved_timestamp", "type", None, "json_type(j, '$.retrieved_timestamp') <> 'VARCHAR'"), ("$.model_info", "required", "id", "NOT json_exists(j, '$.model_info.id')"),
    ("$.source_metadata.source_type", "enum", None, f"json_extract_string(j, {META}.source_type') NOT IN ('documentation', 'evaluation_run')"),
    ("$.source_metadata.evaluator_relationship", "enum", None, f"json_extract_string(j, {META}.evaluator_relationship') NOT IN ('first_party', 'third_party', 'collaborative', 'other')"),
    ("$.source_metadata.additional_details.k", "type", None, f"json_type(j, {META}.additional_details.k') <> 'VARCHAR'"), ("$.eval_library.version", "type", None, "json_type(j, '$.eval_library.version') <> 'VARCHAR'"),
    ("$.evaluation_results[].source_data", "oneOf", None, "json_extract_string(j, '$.evaluation_results[0].source_data.source_type') NOT IN ('url', 'hf_dataset', 'other')"),
    ("$.evaluation_results[].metric_config.max_score", "type", None, f"json_type(j, {CONFIG}.max_score') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE')"),
    ("$.evaluation_results[].metric_config", "required", "min_score", f"json_extract_string(j, {CONFIG}.score_type') = 'continuous' AND NOT json_exists(j, {CONFIG}.min_score')"),
    ("$.evaluation_results[].score_details.score", "type", None, f"json_type(j, {SCORE}) = 'VARCHAR'"), ("$.evaluation_results[].generation_config.generation_args.max_tokens", "minimum", None, f"json_extract(j, {ARGS}.max_tokens')::INT < 1"),
    ("$.evaluation_results[].generation_config.generation_args", "additionalProperties", "n_shot", f"json_exists(j, {ARGS}.n_shot')"), ("$.evaluation_results[].generation_config.generation_args", "additionalProperties", "warmup", f"json_exists(j, {ARGS}.warmup')"),
]
#: Repairs likewise; the last column says whether the older set has it (text: under this condition only).
REPAIRS = [
    ("schema version", "coalesce(json_extract_string(j, '$.schema_version') NOT IN ('0.2.0', '0.2.1'), true)", True), ("timestamp as text", "json_type(j, '$.retrieved_timestamp') <> 'VARCHAR'", True),
    ("source type", f"json_extract_string(j, {META}.source_type') IN ('evaluation_platform', 'paper_html')", f"json_extract_string(j, {META}.source_type') = 'evaluation_platform'"),
    ("relationship", f"json_extract_string(j, {META}.evaluator_relationship') IN ('unknown', 'self_reported')", f"json_extract_string(j, {META}.evaluator_relationship') = 'unknown'"),
    ("score as number", f"json_type(j, {SCORE}) = 'VARCHAR'", True), ("library", "NOT json_exists(j, '$.eval_library')", True), ("library version", "json_type(j, '$.eval_library.version') = 'NULL'", False), ("model id", "NOT json_exists(j, '$.model_info.id')", True),
    ("detail as text", f"json_type(j, {META}.additional_details.k') <> 'VARCHAR'", False), ("legacy member moved", "json_exists(j, '$.validated')", False), ("n_shot as shots", f"json_exists(j, {ARGS}.n_shot')", False),
    ("argument beside", f"json_exists(j, {ARGS}.warmup')", False), ("score bound", f"json_type(j, {CONFIG}.max_score') = 'NULL'", False),
]
RECORDS = f"r AS (SELECT ({RECORD})::JSON AS j FROM orders)".replace("AS STRING)", "AS VARCHAR)")


def of_json(read):
    return spread(read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey").select("o_orderkey", F.try_parse_json(F.expr(RECORD)).alias("document"))


def sql_text(name: str | None) -> str:
    return "NULL::VARCHAR" if name is None else f"'{name}'"


def counted_fixes(repaired):
    """By explode_outer: from explode Spark infers a filter that there are fixes, and repairs all records a second time for it, before they are spread."""
    return repaired.select(F.explode_outer("fixes.fix").alias("fix")).where(F.col("fix").isNotNull()).groupBy("fix").agg(F.count("*").alias("n"))


def counted(parts: list[str]) -> str:
    return f"WITH {RECORDS} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


@query(counted([f"SELECT '{path}' AS path, '{rule}' AS rule, {sql_text(name)} AS name, count_if({when}) AS n FROM r" for path, rule, name, when in FAULTS]))
def v01_schema_errors(read):
    e = of_json(read).select(F.explode(schema.schema_errors("document", schema.RECORD_SCHEMA)).alias("e")).select("e.*")
    return e.groupBy(F.regexp_replace("path", r"\[\d+\]", "[]").alias("path"), "rule", F.when(F.col("rule").isin("required", "additionalProperties"), F.col("detail")).alias("name")).agg(F.count("*").alias("n"))


@query(counted([f"SELECT '{fix}' AS fix, count_if({when}) AS n FROM r" for fix, when, _ in REPAIRS]))
def v10_fixes(read):
    return counted_fixes(repair.repair(of_json(read)))


@query(counted([f"SELECT '{fix}' AS fix, count_if({when if older is True else older}) AS n FROM r" for fix, when, older in REPAIRS if older]))
def v11_older_fixes(read):
    return counted_fixes(repair.repair(of_json(read), fixes=repair.OLDER_FIXES))


BEYOND = " OR ".join(f"coalesce({when}, false)" for path, rule, name, when in FAULTS if rule in ("oneOf", "minimum") or name == "min_score") + f" OR json_extract_string(j, {META}.evaluator_relationship') = 'rival'"
ANY = " OR ".join(f"coalesce({when}, false)" for *_, when in FAULTS)


@query(f"WITH {RECORDS} SELECT CASE WHEN {BEYOND} THEN 'invalid' WHEN {ANY} THEN 'fixed' ELSE 'valid' END AS status, count(*) AS n FROM r GROUP BY ALL")
def v12_repaired(read):
    return repair.validated(of_json(read)).groupBy("status").agg(F.count("*").alias("n"))
