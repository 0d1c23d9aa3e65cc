"""From the logs of evaluation harnesses to records (C, P19, V16): columns in, columns out, over nested frames.

Values whose type matters (a number or a text) are VARIANT; everything else is typed by the schema a log is read with.
Arrays are transformed in place, so a log of many samples costs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.normalize import model_args, provider_path, scoring_mode
from tallyloom.functions.textmeta import json_text, prompt_hash, value_in_text

# The platform and the engine that a harness's model type stands for.
PLATFORMS = {"openai-completions": "openai", "openai-chat-completions": "openai", "anthropic": "anthropic", "anthropic-chat": "anthropic", "together": "together"}
ENGINES = {"hf": "transformers", "vllm": "vllm", "gguf": "llama.cpp"}
# Least and greatest value of a metric (None: open).
METRIC_BOUNDS = {
    "acc": (0.0, 1.0), "acc_norm": (0.0, 1.0), "exact_match": (0.0, 1.0), "f1": (0.0, 1.0), "em": (0.0, 1.0), "mc1": (0.0, 1.0), "mc2": (0.0, 1.0), "mcc": (-1.0, 1.0), "bleu": (0.0, 100.0),
    "rouge1": (0.0, 1.0), "rouge2": (0.0, 1.0), "rougeL": (0.0, 1.0), "rougeLsum": (0.0, 1.0), "ter": (0.0, None), "brier_score": (0.0, 1.0),
}
# Entries of a task that are no metric, options of a generation that have a field of their own, model details kept.
NO_METRICS = ("alias", "samples", "name", "sample_len", "sample_count")
OPTIONS = {"temperature": "temperature", "top_p": "top_p", "top_k": "top_k", "max_gen_toks": "max_tokens"}
DETAILS = {"model_num_parameters": "num_parameters", "model_dtype": "dtype", "model_revision": "revision", "model_sha": "sha"}


def _pick(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def _full(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def is_number(value: Column) -> Column:
    """Whether a VARIANT is a number; true and false count as 1 and 0."""
    return F.coalesce(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"), F.lit(False))


def as_number(value: Column) -> Column:
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def leaf_tasks(tasks: Column) -> Column:
    """The tasks of map<task, map<name, VARIANT>> with a result: placeholders of groups and tasks without a number go."""
    metric = lambda k, v: ~k.isin(*NO_METRICS) & ~k.contains("_stderr,") & is_number(v)
    placeholder = lambda t: F.map_keys(F.map_filter(t, lambda k, v: k != "alias")) == F.array(F.lit(" "))
    return F.map_filter(tasks, lambda name, t: ~placeholder(t) & (F.size(F.map_filter(t, metric)) > 0))


def bounds(metric: Column) -> Column:
    """(least, most) of a metric's values; null if it is not known."""
    known = {k: v for k, v in METRIC_BOUNDS.items() if v[1] is not None}
    least = F.coalesce(*(F.when(metric == k, F.lit(v[0])) for k, v in METRIC_BOUNDS.items()))
    return F.when(least.isNotNull(), F.struct(least.alias("least"), F.coalesce(*(F.when(metric == k, F.lit(v[1])) for k, v in known.items())).alias("most")))


def harness_model(kind: Column, args: Column, name: Column, config: Column, engine: Column | None = None, engine_version: Column | None = None) -> Column:
    """The model of a run.

    kind: the harness's model type. args: its arguments, text k=v or map<string,string>. name: used if they name none.
    config: map<string,string> of the run, of which some entries are kept. engine: told by the caller, before the one kind stands for.
    """
    return _model(kind, model_args(args), args, name, config, engine, engine_version)


def harness_model_of_map(kind: Column, args: Column, name: Column, config: Column, engine: Column | None = None, engine_version: Column | None = None) -> Column:
    """C03 for arguments that are a map already."""
    return _model(kind, args, F.when(F.size(args) > 0, F.to_json(args)), name, config, engine, engine_version)


def _model(kind: Column, args: Column, shown: Column, name: Column, config: Column, engine: Column | None, engine_version: Column | None) -> Column:
    nothing = F.lit(None).cast("string")
    path = F.coalesce(F.try_element_at(args, F.lit("pretrained")), name, F.lit(""))
    runs_on = F.coalesce(_full(engine) if engine is not None else nothing, _pick(kind, ENGINES))
    kept = [F.struct(F.lit(to).alias("key"), _full(F.try_element_at(config, F.lit(k))).alias("value")) for k, to in DETAILS.items()]
    details = F.filter(F.array(*kept, F.struct(F.lit("model_args").alias("key"), _full(shown).alias("value"))), lambda x: x["value"].isNotNull())
    return F.struct(
        path.alias("name"), path.alias("id"), F.when(path.contains("/"), F.substring_index(path, "/", 1)).alias("developer"), _pick(kind, PLATFORMS).alias("inference_platform"),
        F.when(runs_on.isNotNull(), F.struct(runs_on.alias("name"), (engine_version if engine_version is not None else nothing).alias("version"))).alias("inference_engine"),
        F.when(F.size(details) > 0, F.map_from_entries(details)).alias("additional_details"),
    )


def harness_source(task_config: Column, task: Column) -> Column:
    """Where a task's data come from: a repository if its path has a slash and does not start with one, else other."""
    at = lambda k: F.try_element_at(task_config, F.lit(k))
    hosted = F.coalesce(at("dataset_path").contains("/") & ~at("dataset_path").startswith("/"), F.lit(False))
    return F.struct(
        F.coalesce(at("task"), task).alias("dataset_name"), F.when(hosted, "hf_dataset").otherwise("other").alias("source_type"),
        F.when(hosted, at("dataset_path")).alias("hf_repo"), F.when(hosted, F.coalesce(_full(at("test_split")), _full(at("validation_split")))).alias("hf_split"),
    )


def harness_generation(kwargs: Column, shots: Column) -> Column:
    """Options of a generation, map<string,string> with values in JSON but for texts; null without any. Other options and the shots are details."""
    at = lambda k: F.try_element_at(kwargs, F.lit(k))
    types = {"temperature": "double", "top_p": "double", "top_k": "double", "max_tokens": "long"}
    shown = F.when(shots.isNotNull(), F.create_map(F.lit("num_fewshot"), shots.cast("string"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    more = F.map_concat(F.map_filter(kwargs, lambda k, v: ~k.isin(*OPTIONS) & (k != "num_fewshot")), shown)
    return F.when(F.size(kwargs) > 0, F.struct(
        F.struct(*(at(k).try_cast(types[to]).alias(to) for k, to in OPTIONS.items())).alias("generation_args"), F.when(F.size(more) > 0, more).alias("additional_details"),
    ))


def harness_sample(sample: Column, task: Column, prompt: Column, output: Column) -> Column:
    """One sample, map<string, VARIANT>, as an instance. The score is the first listed metric that is a number (0.0 without one); it is correct iff 1.0."""
    at = lambda k: F.try_element_at(sample, F.lit(k))
    text = lambda k: F.coalesce(F.try_variant_get(at(k), "$", "string"), F.lit(""))
    metrics = F.coalesce(F.try_variant_get(at("metrics"), "$", "array<string>"), F.array().cast("array<string>"))
    score = F.coalesce(_first(F.filter(F.transform(metrics, lambda m: as_number(F.try_element_at(sample, m))), lambda x: x.isNotNull())), F.lit(0.0))
    kind = F.coalesce(F.try_variant_get(at("filter"), "$", "string"), F.lit("none"))
    there = F.filter(metrics, lambda m: F.map_contains_key(sample, m))
    return F.struct(
        F.when(kind == "none", task).otherwise(F.concat_ws("/", task, kind)).alias("evaluation_name"), F.coalesce(F.try_variant_get(at("doc_id"), "$", "string"), F.lit("0")).alias("sample_id"),
        F.sha2(F.concat(F.lit('{"raw": '), json_text(prompt), F.lit(', "reference": '), json_text(text("target")), F.lit("}")), 256).alias("sample_hash"), F.lit("single_turn").alias("interaction_type"),
        F.struct(prompt.alias("raw"), F.array(text("target")).alias("reference")).alias("input"), F.array(output).alias("output"),
        F.array(F.struct(F.lit(0).alias("turn_idx"), F.lit("output.raw").alias("source"), output.alias("extracted_value"), kind.alias("extraction_method"), F.lit(True).alias("is_terminal"))).alias("answer_attribution"),
        F.struct(score.alias("score"), (score == 1.0).alias("is_correct")).alias("evaluation"),
        F.create_map(
            *(x for k in ("doc_hash", "prompt_hash", "target_hash") for x in (F.lit(k), text(k))), F.lit("filter"), kind,
            F.lit("lm_eval_metrics"), F.to_json(F.map_from_arrays(there, F.transform(there, lambda m: F.try_element_at(sample, m)))),
        ).alias("metadata"),
    )


def scorer_results(scorers: Column) -> Column:
    """array<struct<name, scorer, metrics: map<string, struct<name, value>>>> as (scorer, metric, value, stderr, stddev).

    Only stderr is no result of its own: a std or stddev is one, and is every result's stddev as well. The first of each counts.
    """

    def of(s):
        found = F.map_values(s["metrics"])
        spread = lambda *names: _first(F.filter(found, lambda m: m["name"].isin(*names)))["value"]
        return F.transform(F.filter(found, lambda m: m["name"] != "stderr"), lambda m: F.struct(
            F.coalesce(_full(s["name"]), s["scorer"]).alias("scorer"), m["name"].alias("metric"), m["value"].alias("value"), spread("stderr").alias("stderr"), spread("std", "stddev").alias("stddev"),
        ))

    return F.flatten(F.transform(scorers, of))


def content_parts(parts: Column) -> Column:
    """(text, reasoning) of a message in parts, array<struct<type, text, reasoning>>: the last part of each type."""
    last = lambda kind: _last(F.filter(parts, lambda p: p["type"] == kind))
    return F.struct(last("text")["text"].alias("text"), last("reasoning")["reasoning"].alias("reasoning"))


def messages(turns: Column) -> Column:
    """A conversation, array<struct<role, content, parts, tool_calls: array<struct<id, function, arguments: map>>, tool_call_id>>.

    parts, where there are any, stand for content. Only assistants call tools; only users and tools answer a call.
    """

    def one(m, i):
        split = content_parts(m["parts"])
        calls = F.transform(m["tool_calls"], lambda c: F.struct(c["id"].alias("id"), c["function"].alias("name"), F.when(F.size(c["arguments"]) > 0, c["arguments"]).alias("arguments")))
        return F.struct(
            i.alias("turn_idx"), m["role"].alias("role"), F.when(m["parts"].isNull(), m["content"]).otherwise(split["text"]).alias("content"), F.when(m["parts"].isNotNull(), split["reasoning"]).alias("reasoning_trace"),
            F.coalesce(F.when(m["role"] == "assistant", calls), F.array()).alias("tool_calls"),
            F.when(m["role"].isin("user", "tool") & m["tool_call_id"].isNotNull(), F.array(m["tool_call_id"])).alias("tool_call_id"),
        )

    return F.transform(turns, one)


def available_tools(steps: Column) -> Column:
    """Tools of the plan's use_tools steps, array<struct<solver, tools: array<array<struct<name, description, params: map>>>>>; the first list of a step."""
    using = F.filter(steps, lambda s: (s["solver"] == "use_tools") & (F.size(s["tools"]) > 0))
    return F.flatten(F.transform(using, lambda s: F.transform(s["tools"][0], lambda t: F.struct(t["name"].alias("name"), t["description"].alias("description"), F.when(F.size(t["params"]) > 0, t["params"]).alias("parameters")))))


def run_metrics(specs: Column) -> Column:
    """The distinct metric names of array<struct<class_name, names: array<string>>>; a spec without names goes by its class."""
    return F.array_distinct(F.flatten(F.transform(specs, lambda s: F.when(F.size(s["names"]) > 0, s["names"]).otherwise(F.array(F.substring_index(s["class_name"], ".", -1))))))


def stat_results(stats: Column, metrics: Column, dataset: Column) -> Column:
    """array<struct<name, split, perturbation, count, sum, mean, stddev>> as results of the run's metrics, perturbed ones left out.

    A mean that is absent or 0 is sum / count, 0.0 without a count.
    """
    wanted = F.filter(stats, lambda s: F.array_contains(metrics, s["name"]) & _full(s["perturbation"]).isNull())
    mean = lambda s: F.coalesce(F.nullif(s["mean"], F.lit(0.0)), F.try_divide(s["sum"], s["count"]), F.lit(0.0))
    return F.transform(wanted, lambda s: F.struct(
        F.concat(F.concat_ws(" ", s["name"], _full(s["split"])), F.lit(" on "), dataset).alias("evaluation_name"), s["name"].alias("metric"), mean(s).alias("score"),
        s["stddev"].alias("stddev"), s["count"].alias("count"), F.coalesce(s["split"], F.lit("")).alias("split"),
    ))


def instance_rows(states: DataFrame, stats: DataFrame, key: str = "instance_id") -> DataFrame:
    """C11: one row a request state, joined to the first stats of its instance.

    states: key, prompt, references array<struct<text, tags: array<string>>>, completions array<string>, request_time (seconds).
    stats: key, at (order), stats array<struct<name, mean, sum>>. Without stats an instance scores 0.0; with them, by exact_match or
    by the share of completions that are a correct reference (0.0 without completions).
    """
    first = stats.groupBy(key).agg(F.min_by("stats", "at").alias("_stats"))
    of = lambda name: _first(F.filter("_stats", lambda s: s["name"] == name))
    right = F.transform(F.filter("references", lambda r: F.array_contains(r["tags"], "correct")), lambda r: r["text"])
    done = F.coalesce(F.col("completions"), F.array().cast("array<string>"))
    share = F.try_divide(F.size(F.filter(done, lambda c: F.array_contains(right, F.trim(c)))), F.size(done))
    score = F.when(F.col("_stats").isNull(), 0.0).otherwise(F.coalesce(of("exact_match")["mean"], share, F.lit(0.0)))
    tokens = lambda name: F.coalesce(of(name)["sum"], F.lit(0.0)).cast("long")
    thought = tokens("num_completion_tokens") - tokens("num_output_tokens")
    usage = F.struct(
        tokens("num_prompt_tokens").alias("input_tokens"), tokens("num_output_tokens").alias("output_tokens"), F.nullif(thought, F.lit(0)).alias("reasoning_tokens"),
        (tokens("num_prompt_tokens") + tokens("num_completion_tokens")).alias("total_tokens"),
    )
    return states.join(first, key, "left").select(
        F.col(key).cast("string").alias("sample_id"), F.sha2(F.concat(F.col("prompt"), F.coalesce(_first(right), F.lit(""))), 256).alias("sample_hash"), F.struct(F.col("prompt").alias("raw"), right.alias("reference"), F.transform("references", lambda r: r["text"]).alias("choices")).alias("input"),
        done.alias("output"), F.coalesce(F.trim(_first(done)), F.lit("")).alias("extracted_value"), score.alias("score"), (score > 0).alias("is_correct"),
        F.when(F.col("_stats").isNotNull(), usage).alias("token_usage"), (F.nullif("request_time", F.lit(0.0)) * 1000).alias("generation_time_ms"),
    )


def run_time(times: Column) -> Column:
    """the least request time of a run, null without any."""
    return F.array_min(F.filter(times, lambda t: t.isNotNull() & (t != 0)))


def run_dataset(spec: Column, scenario: Column) -> Column:
    """the scenario's name, else the value of the run spec's dataset field, else the spec before its first colon."""
    told = F.substring(spec, F.instr(spec, F.lit(":")) + 1, F.length(spec))
    field = _first(F.filter(F.split(told, ",", -1), lambda f: f.contains("dataset") & f.contains("=")))
    value = F.when(spec.contains(":"), F.substring(field, F.instr(field, F.lit("=")) + 1, F.length(field)))
    return F.coalesce(_full(scenario), value, F.substring_index(spec, ":", 1))


def stamped(time: Column, is_snapshot: Column, published: Column) -> Column:
    """C14: rows of a snapshot bear its date of publication."""
    return F.when(is_snapshot, published).otherwise(time)


def agent_generation(options: Column, steps: Column, sandbox: Column, attempts: Column) -> Column:
    """Options: map<string,string> of those set. steps: array<struct>. sandbox: array<string>, its type and setting. attempts: the task's, else max_retries."""
    at = lambda k: F.try_element_at(options, F.lit(k))
    set_ = F.map_filter(options, lambda _, v: v.isNotNull())
    return F.struct(
        *(at(k).try_cast(t).alias(k) for k, t in {"temperature": "double", "top_p": "double", "top_k": "long", "max_tokens": "long"}.items()),
        F.coalesce(F.lower(_full(at("reasoning_effort"))) != "none", F.lit(False)).alias("reasoning"), F.transform(steps, lambda s: F.to_json(s)).alias("steps"),
        F.struct(_first(sandbox).alias("type"), F.try_element_at(sandbox, F.lit(2)).alias("config")).alias("sandbox"),
        F.coalesce(F.nullif(attempts, F.lit(0)), at("max_retries").try_cast("int")).alias("max_attempts"), F.when(F.size(set_) > 0, set_).alias("additional_details"),
    )


def library_version(packages: Column) -> Column:
    """Name:version of each package with a version, by commas."""
    return F.array_join(F.transform(F.filter(F.map_entries(packages), lambda p: _full(p["value"]).isNotNull()), lambda p: F.concat_ws(":", p["key"], p["value"])), ",")


def sampled_model(path: Column, seen: Column) -> Column:
    """The model's path with the name that the samples report, behind the path's provider; the path itself without samples."""
    return F.when(seen.isNull(), path).when(path.contains("/"), F.concat_ws("/", F.substring_index(path, "/", 1), seen)).otherwise(seen)


def sampled_model_info(path: Column, seen: Column) -> Column:
    """Provider and model of it."""
    return provider_path(sampled_model(path, seen))


def eval_specs(logs: DataFrame, model: Column, run: Column, tasks: str, configs: Column, versions: Column, keep: list[str] = ()) -> DataFrame:
    """One specification a task of a run; what the run does not tell is the text "unknown".

    run: map<string,string>. tasks: column map<task, map<name, double>>. configs: map<task, struct<output_type, num_fewshot, doc_to_text>>.
    keep: columns of the logs that stay. The metric is the first by name with a comma in it, as map order is not defined here.
    """
    told = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    at = lambda k: F.try_element_at(run, F.lit(k))
    rows = logs.select("*", F.explode(tasks).alias("benchmark", "_metrics"))
    config = F.try_element_at(configs, F.col("benchmark"))
    metric = _first(F.array_sort(F.filter(F.map_keys("_metrics"), lambda k: k.contains(","))))
    prompt = F.regexp_replace(config["doc_to_text"], r"(?U)^\s+|\s+$", "")
    return rows.select(
        *keep, F.coalesce(_full(model), _full(at("model")), F.lit("unknown")).alias("model_id"), "benchmark", scoring_mode(config["output_type"]).alias("scoring_mode"), F.lit("lm-evaluation-harness").alias("harness_name"),
        told(at("lm_eval_version")).alias("harness_version"), told(F.coalesce(at("num_fewshot"), config["num_fewshot"].cast("string"))).alias("n_shot"), told(at("random_seed")).alias("random_seed"),
        told(at("start_time")).alias("evaluation_timestamp"), told(F.when(_full(prompt).isNotNull(), F.concat(F.lit("sha256:"), prompt_hash(prompt)))).alias("prompt_template_hash"), told(at("temperature")).alias("temperature"),
        told(F.try_element_at(versions, F.col("benchmark"))).alias("task_version"), told(metric).alias("metric"), F.try_element_at("_metrics", metric).alias("score"), F.lit("source-reported").alias("evidence_source"),
    )


def unsupported(values: dict[str, Column], text: Column) -> Column:
    """V16: "name: value" of each value that the text does not hold, in the order given; absent values need no support."""
    return F.array_compact(F.array(*(F.when(v.isNotNull() & ~F.coalesce(value_in_text(v.cast("string"), text), F.lit(False)), F.concat_ws(": ", F.lit(k), v.cast("string"))) for k, v in values.items())))


def first_object(text: Column) -> Column:
    """the first balanced {...} of a model's answer without code fences; null if it never closes or is no JSON. Braces in quotes count."""
    bare = F.regexp_replace(F.regexp_replace(text, r"```json\s*", ""), r"```\s*", "")
    body = F.substring(bare, F.instr(bare, F.lit("{")), F.length(bare))
    pieces = F.regexp_extract_all(body, F.lit(r"[^{}]*[{}]"), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(state, piece):
        depth = state["depth"] + F.when(F.endswith(piece, F.lit("{")), 1).otherwise(-1)
        at = state["at"] + F.length(piece)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((state["end"] == 0) & (depth == 0), at).otherwise(state["end"]).alias("end"))

    end = F.aggregate(pieces, start, step)["end"]
    found = F.when((F.instr(bare, F.lit("{")) > 0) & (end > 0), F.substring(body, F.lit(1), end))
    return F.when(F.try_parse_json(found).isNotNull(), found)
