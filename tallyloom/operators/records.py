"""Evaluation records: flattening, projection, validation, audit and repair over nested frames (P, V, C)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.normalize import alias

# The shots that a source's protocol prescribes for a benchmark.
KNOWN_SHOTS = {
    ("open_llm_leaderboard_v2", "IFEval (strict-prompt)"): 0, ("open_llm_leaderboard_v2", "BBH"): 3, ("open_llm_leaderboard_v2", "MATH Lvl 5"): 4, ("open_llm_leaderboard_v2", "GPQA-Diamond"): 0,
    ("open_llm_leaderboard_v2", "MuSR"): 0, ("open_llm_leaderboard_v2", "MMLU-Pro"): 5, ("alpacaeval2", "AlpacaEval 2.0"): 0, ("alpacaeval2", "AlpacaEval 2.0 LC"): 0, ("bfcl", "BFCL-v3"): 0,
    ("bfcl", "BFCL-v3 AST"): 0, ("bfcl", "BFCL-v3 Live"): 0, ("bigcodebench", "BigCodeBench-Complete"): 0, ("bigcodebench", "BigCodeBench-Instruct"): 0, ("evalplus", "HumanEval+"): 0,
    ("evalplus", "MBPP+"): 3, ("swe_bench", "SWE-Bench-Verified"): 0,
}
PREFERENCE_BENCHMARKS = ("Arena Elo", "MT-Bench", "WildBench v2", "WildBench v2 (adj)")
# Names of metrics that describe the model rather than a result.
METADATA_METRICS = (r"(?i)param", r"(?i)size", r"(?i)flop", r"(?i)training.*(token|step|hour|cost)", r"(?i)latency", r"(?i)throughput", r"(?i)memory")

#: One evaluation record (the fields that the analyses use).
RECORD = """
schema_version string, evaluation_id string, retrieved_timestamp string,
source_metadata struct<source_name:string, source_type:string, source_organization_name:string, evaluator_relationship:string, additional_details:map<string,string>>,
eval_library struct<name:string, version:string, additional_details:map<string,string>>,
model_info struct<name:string, id:string, developer:string, parameter_count:string, model_alignment:string, quantization:string>,
evaluation_results array<struct<
  evaluation_name:string,
  source_data:struct<dataset_name:string, source_type:string>,
  metric_config:struct<metric_name:string, lower_is_better:boolean, score_type:string, min_score:double, max_score:double, level_names:array<string>, has_unknown_level:boolean, additional_details:map<string,string>>,
  score_details:struct<score:double>,
  generation_config:struct<generation_args:struct<shots:int, temperature:double, top_p:double, reasoning:boolean, chain_of_thought:string, prompt_template:string>, additional_details:map<string,string>>
>>
""".replace("\n", " ")


def flatten(records: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """One row a result, absent values as empty text; harness falls through empty text, source only an absent key."""
    r = records.select("*", F.posexplode("evaluation_results").alias("er_index", "er"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    detail = lambda k: F.coalesce(F.col("er.generation_config.additional_details")[k], F.lit(""))
    from_map = F.col("source_metadata.additional_details")
    return r.select(
        *(text(f"model_info.{c}").alias(n) for c, n in (("name", "model"), ("id", "model_id"), ("developer", "developer"), ("parameter_count", "parameter_count"), ("model_alignment", "model_alignment"), ("quantization", "quantization"))),
        alias(text("er.evaluation_name"), aliases or {}).alias("benchmark"), F.col("er.score_details.score").alias("score"),
        *(text(f"er.metric_config.{c}").alias(c) for c in ("lower_is_better", "min_score", "max_score", "metric_name", "score_type")),
        *(text(f"er.generation_config.generation_args.{c}").alias(c) for c in ("shots", "temperature", "top_p", "reasoning", "chain_of_thought", "prompt_template")),
        F.coalesce(F.nullif(detail("harness"), F.lit("")), text("eval_library.name")).alias("harness"), detail("scoring_method").alias("scoring_method"),
        F.when(F.coalesce(F.map_contains_key(from_map, F.lit("source")), F.lit(False)), from_map["source"]).otherwise(text("source_metadata.source_name")).alias("source"),
        text("source_metadata.source_name").alias("source_name"), text("source_metadata.evaluator_relationship").alias("evaluator_relationship"),
        text("eval_library.name").alias("eval_library"), text("eval_library.version").alias("eval_library_version"), text("evaluation_id").alias("evaluation_id"), text("retrieved_timestamp").alias("retrieved_timestamp"), "er_index",
    )


def of_sources(rows: DataFrame, source: str, keep: list[str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the sources to keep (all if none are named) without those to drop; a row without a source is only in no named set."""
    kept = rows if keep is None else rows.where(F.col(source).isin(*keep))
    return kept.where(~F.coalesce(F.col(source).isin(*drop), F.lit(False))) if drop else kept


def relabel(rows: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """Columns set anew where a condition holds."""
    return rows.withColumns({k: F.when(when, v).otherwise(F.col(k)) for k, v in values.items()})


def long_form(rows: DataFrame, ids: list[str], columns: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """One row a column, absent values left out."""
    return rows.unpivot(ids, columns, name, value).where(F.col(value).isNotNull())


def mean_of(rows: DataFrame, prefix: str, suffix: str = "") -> Column:
    """Mean of the columns of such names that a row has."""
    there = F.filter(F.array(*(F.col(c).cast("double") for c in rows.columns if c.startswith(prefix) and c.endswith(suffix))), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there))


def reasons(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """The first test in order that a row fails, as column reason (null if none)."""
    return rows.withColumn("reason", F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in tests.items())))


def nest(rows: DataFrame, key: list[str], fields: list[str], name: str = "results") -> DataFrame:
    """The rows of a key as an array of structs in field order; a key is one record's results."""
    return rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def metric_of(metrics: Column, wanted: list[str]) -> Column:
    """The first wanted metric of a map, else the first by name that is no standard error."""
    other = F.array_sort(F.filter(F.map_keys(metrics), lambda k: ~k.contains("stderr")))
    return F.coalesce(*(F.try_element_at(metrics, F.lit(k)) for k in wanted), F.try_element_at(metrics, F.try_element_at(other, F.lit(1))))


def _issues(rows: DataFrame, source: Column, row: str, *checks: tuple[str, str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for s, m, c in checks)))
    return rows.select(source.alias("source"), F.col(row).alias("row"), F.explode(found).alias("i")).select("source", "row", "i.*")


def shots_issues(rows: DataFrame, source: Column, bench: Column, shots: Column, row: str, known: dict | None = None, preference: tuple = PREFERENCE_BENCHMARKS) -> DataFrame:
    """Shots against what the protocol prescribes; a null is absent."""
    known = KNOWN_SHOTS if known is None else known
    wanted = F.coalesce(*(F.when((source == s) & (bench == b), F.lit(n)) for (s, b), n in known.items()), F.lit(None).cast("int"))
    return _issues(rows, source, row, ("WARNING", "shots absent", wanted.isNotNull() & shots.isNull()), ("ERROR", "shots wrong", shots != wanted), ("INFO", "zero shots", (shots == 0) & wanted.isNull() & ~bench.isin(*preference)), ("WARNING", "shots on preference", shots.isNotNull() & bench.isin(*preference)))


def library_issues(rows: DataFrame, source: Column, name: Column, version: Column, row: str) -> DataFrame:
    """V03."""
    return _issues(rows, source, row, ("ERROR", "library name missing", name.isNull()), ("INFO", "library version unknown", version == "unknown"), ("ERROR", "library version missing", version.isNull()))


def score_issues(rows: DataFrame, source: Column, score: Column, least: Column, most: Column, row: str) -> DataFrame:
    """A missing score ends the checks of a row; otherwise each that fails is an issue."""
    return _issues(
        rows, source, row, ("ERROR", "score missing", score.isNull()), ("ERROR", "score below bound", score < least), ("ERROR", "score above bound", score > most),
        ("CRITICAL", "likely no score", (most <= 100) & (score > 100)), ("WARNING", "score zero", score == 0), ("ERROR", "score negative", (least >= 0) & (score < 0)),
    )


def required_issues(rows: DataFrame, source: Column, fields: dict[str, Column], row: str) -> DataFrame:
    """Required fields that are null."""
    return _issues(rows, source, row, *(("ERROR", f"{k} missing", c.isNull()) for k, c in fields.items()))


def identity_issues(rows: DataFrame, source: Column, name: Column, model: Column, developer: Column, row: str) -> DataFrame:
    """V06."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return _issues(rows, source, row, ("ERROR", "name empty", blank(name)), ("ERROR", "id empty", blank(model)), ("WARNING", "developer empty", blank(developer)), ("WARNING", "id without developer", ~blank(model) & ~model.contains("/")))


def run_checks(*issues: DataFrame) -> DataFrame:
    """All issues of pluggable checks."""
    return reduce(DataFrame.unionByName, issues)


def verdict(issues: DataFrame) -> DataFrame:
    """1 if any issue is critical or an error."""
    return issues.agg(F.coalesce(F.max(F.when(F.col("severity").isin("CRITICAL", "ERROR"), 1)), F.lit(0)).alias("verdict"))


def metadata_metric(name: Column) -> Column:
    """The metric describes the model."""
    return reduce(lambda a, b: a | b, (name.rlike(p) for p in METADATA_METRICS))


def out_of_range(score: Column, least: Column, most: Column) -> Column:
    """Implausibly outside the declared range."""
    return ((most <= 100) & (score > 100)) | ((most <= 1) & (score > 1.5))


def drop_leaks(records: DataFrame) -> DataFrame:
    """Records without leaked results; records left without results go. Adds removed."""
    bad = lambda x: F.coalesce(metadata_metric(x["metric_config"]["metric_name"]), F.lit(False)) | F.coalesce(out_of_range(x["score_details"]["score"], x["metric_config"]["min_score"], x["metric_config"]["max_score"]), F.lit(False))
    before = F.size("evaluation_results")
    cut = records.withColumn("_n", before).withColumn("evaluation_results", F.filter("evaluation_results", lambda x: ~bad(x)))
    return cut.withColumn("removed", F.col("_n") - F.size("evaluation_results")).drop("_n").where(F.size("evaluation_results") > 0)


def canonical_results(records: DataFrame, names: dict[str, str], fold: bool = False) -> DataFrame:
    """Benchmark names in canonical form, and the dataset's name with it where both were equal."""

    def fixed(x):
        new = alias(x["evaluation_name"], names, fold)
        data = F.when(x["source_data"]["dataset_name"] == x["evaluation_name"], x["source_data"].withField("dataset_name", new)).otherwise(x["source_data"])
        return x.withField("evaluation_name", new).withField("source_data", data)

    return records.withColumn("evaluation_results", F.transform("evaluation_results", fixed))


def autofix(records: DataFrame, version: str = "0.2.1") -> DataFrame:
    """Record repairs in order, with the descriptions of those applied as column fixes."""
    sm, lib, info = F.col("source_metadata"), F.col("eval_library"), F.col("model_info")
    kinds = {"evaluation_platform": "evaluation_run", "paper_html": "documentation"}
    parties = {"unknown": "other", "self_reported": "first_party"}
    scores = F.col("evaluation_results")
    steps = [
        ("inserted schema_version", F.col("schema_version").isNull()), ("updated schema_version", ~F.col("schema_version").isin("0.2.0", "0.2.1")), ("fixed source_type", sm["source_type"].isin(*kinds)),
        ("fixed evaluator_relationship", sm["evaluator_relationship"].isin(*parties)), ("inserted eval_library", lib.isNull()), ("fixed eval_library.version", lib.isNotNull() & lib["version"].isNull()),
        ("derived model id", info["id"].isNull() & info["name"].isNotNull()), ("fixed score bounds", F.exists(scores, lambda x: x["metric_config"].isNotNull() & (x["metric_config"]["max_score"].isNull() | x["metric_config"]["min_score"].isNull()))),
    ]
    bounded = F.transform(scores, lambda x: x.withField("metric_config", F.when(x["metric_config"].isNotNull(), x["metric_config"].withField("max_score", F.coalesce(x["metric_config"]["max_score"], F.lit(100.0))).withField("min_score", F.coalesce(x["metric_config"]["min_score"], F.lit(0.0))))))
    done = records.withColumn("fixes", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in steps))))
    return done.withColumns({
        "schema_version": F.when(F.col("schema_version").isin("0.2.0", "0.2.1"), F.col("schema_version")).otherwise(version),
        "source_metadata": F.when(sm.isNotNull(), sm.withField("source_type", alias(sm["source_type"], kinds)).withField("evaluator_relationship", alias(sm["evaluator_relationship"], parties))),
        "eval_library": F.when(lib.isNull(), F.from_json(F.lit('{"name": "unknown", "version": "unknown"}'), "name string, version string, additional_details map<string,string>")).otherwise(lib.withField("version", F.coalesce(lib["version"], F.lit("unknown")))),
        "model_info": F.when(info.isNotNull(), info.withField("id", F.coalesce(info["id"], info["name"]))), "evaluation_results": bounded,
    })


def record_errors(records: DataFrame) -> DataFrame:
    """Schema errors of a record as an array, and its status."""
    sm = F.col("source_metadata")
    checks = [
        *((f"{c} missing", F.col(c).isNull()) for c in ("schema_version", "evaluation_id", "retrieved_timestamp", "source_metadata", "eval_library", "model_info", "evaluation_results")),
        ("source_type", ~F.coalesce(sm["source_type"].isin("documentation", "evaluation_run"), F.lit(True))), ("evaluator_relationship", ~F.coalesce(sm["evaluator_relationship"].isin("first_party", "third_party", "collaborative", "other"), F.lit(True))),
        ("model id", F.col("model_info").isNotNull() & F.col("model_info.id").isNull()), ("score", F.exists("evaluation_results", lambda x: x["score_details"]["score"].isNull())),
        ("continuous without bounds", F.exists("evaluation_results", lambda x: (x["metric_config"]["score_type"] == "continuous") & (x["metric_config"]["min_score"].isNull() | x["metric_config"]["max_score"].isNull()))),
        ("levels without names", F.exists("evaluation_results", lambda x: (x["metric_config"]["score_type"] == "levels") & (x["metric_config"]["level_names"].isNull() | x["metric_config"]["has_unknown_level"].isNull()))),
    ]
    errors = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks)))
    return records.withColumn("errors", errors).withColumn("status", F.when(F.size("errors") == 0, "valid").otherwise("invalid"))


def split_results(records: DataFrame) -> DataFrame:
    """One record a result."""
    return records.withColumn("evaluation_results", F.explode("evaluation_results")).withColumn("evaluation_results", F.array("evaluation_results"))


def harness_results(tasks: Column) -> Column:
    """Results of a harness log, map<task, map<"metric,filter", value>>: (task, metric, filter, value, stderr), standard errors joined by name."""
    entries = F.flatten(F.transform(F.map_entries(tasks), lambda t: F.transform(F.map_entries(t["value"]), lambda m: F.struct(t["key"].alias("task"), m["key"].alias("name"), m["value"].alias("value"), t["value"].alias("all")))))
    usable = F.filter(entries, lambda x: ~x["name"].contains("stderr") & (F.trim(x["name"]) != "") & x["value"].isNotNull())
    metric, kind = (lambda x: F.substring_index(x["name"], ",", 1)), (lambda x: F.when(x["name"].contains(","), F.substring(x["name"], F.instr(x["name"], F.lit(",")) + 1, F.length(x["name"]))).otherwise("none"))
    return F.transform(usable, lambda x: F.struct(x["task"].alias("task"), metric(x).alias("metric"), kind(x).alias("filter"), x["value"].alias("value"), F.try_element_at(x["all"], F.concat(metric(x), F.lit("_stderr,"), kind(x))).alias("stderr")))
