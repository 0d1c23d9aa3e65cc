"""What was read out of a paper's prose (V18): answers as VARIANT of three layouts are cleaned of words that say nothing, typed and checked, an array in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.normalize import number
from tallyloom.operators.leaderboards import at, text
from tallyloom.operators.schema import let

# Words that stand for no value, fields of a benchmark's settings.
NOTHING = ("not found", "null", "n/a", "unknown", "not specified", "not mentioned", "not explicitly stated", "")
SETTINGS = ("n_shot", "temperature", "prompt_template", "decoding_strategy")
RESULTS = ("score", "metric_name", "lower_is_better", "score_range", "eval_harness")
TYPES = {
    "benchmark_name": "string", "score": "double", "metric_name": "string", "lower_is_better": "boolean", "score_range": "string", "n_shot": "bigint", "temperature": "double",
    "prompt_template": "string", "decoding_strategy": "string", "eval_harness": "string",
}
BENCHMARK = "struct<" + ",".join(f"{k}:{t}" for k, t in TYPES.items()) + ",faults:array<string>>"
MODEL = f"struct<model_name:string,model_family:string,developer:string,is_baseline:boolean,benchmarks:array<{BENCHMARK}>>"
# As read, all members of a value at once: texts, n_shot a VARIANT because a number and its text are told apart.
RAW = "struct<" + ",".join(f"{k}:{'variant' if t == 'bigint' else 'string'}" for k, t in TYPES.items()) + ">"
MODEL_FIELDS = ("model_name", "model_family", "developer", "is_baseline")
RAW_MODEL = f"struct<model_name:string,model_family:string,developer:string,is_baseline:boolean,benchmarks:array<{RAW}>>"


def says(words: Column) -> Column:
    """A text, null if it says nothing."""
    return F.when(~F.lower(F.trim(words)).isin(*NOTHING), words)


def said(value: Column, key: str) -> Column:
    """Text of a member, null if it says nothing."""
    return let(text(value, key), says)


def typed(raw: Column, words: Column, key: str) -> Column:
    """What a member of a RAW says, in its field's type; null if it does not fit. Numbers may be text; a fractional n_shot loses its fraction, as text it does not fit."""
    kind = TYPES[key]
    if kind == "double":
        return number(words)
    if kind == "bigint":
        return F.when((F.schema_of_variant(raw[key]) != "STRING") | words.rlike(r"^\s*[+-]?\d+\s*$"), number(words).try_cast("bigint"))
    return words.try_cast(kind) if kind == "boolean" else words


def _words(raw: Column) -> dict[str, Column]:
    """What the members of a RAW that has a name say; the name "unknown" may be given to it."""
    return {k: raw[k] if k == "benchmark_name" else says(F.try_variant_get(raw[k], "$", "string") if t == "bigint" else raw[k]) for k, t in TYPES.items()}


def _benchmark(words, values) -> Column:
    """faults: fields that say something which does not fit; a score that is no number is no fault but absent."""
    checked = [k for k, t in TYPES.items() if t != "string" and k != "score"]
    faults = F.array_compact(F.array(*(F.when(words[k].isNotNull() & values[k].isNull(), F.lit(k)) for k in checked)))
    return F.struct(*(values[k].alias(k) for k in TYPES), faults.alias("faults")).cast(BENCHMARK)


def benchmark(raw: Column) -> Column:
    """One benchmark of a RAW, for use inside an array."""
    words = F.struct(*(c.alias(k) for k, c in _words(raw).items()))
    return let(words, lambda w: let(F.struct(*(typed(raw, w[k], k).alias(k) for k in TYPES)), lambda v: _benchmark(w, v)))


def _only(raw: Column, fields: tuple[str, ...], name: Column | None = None) -> Column:
    """A RAW without other fields; its own name or this one."""
    kept = {k: raw[k] if k in fields else F.lit(None) for k in TYPES} | {"benchmark_name": raw["benchmark_name"] if name is None else name}
    return F.struct(*(c.alias(k) for k, c in kept.items())).cast(RAW)


def _listed(value: Column, key: str, kind: str) -> Column:
    """A list's items, or those of a member, each read as this type at once: a member of its own would be a VARIANT built anew."""
    kind = f"array<{kind}>"
    return F.coalesce(F.try_variant_get(value, "$", kind), at(value, key, kind), F.array().cast(kind))


def raw_models(answer: Column) -> Column:
    """The models that `models` gives, as array<RAW_MODEL>: all but the types of their benchmarks' fields. The answer is computed once, and a layout is only read if those before it gave nothing."""
    named = lambda benchmarks: F.filter(benchmarks, lambda b: says(b["benchmark_name"]).isNotNull())
    made = lambda m: F.struct(says(m["model_name"]).alias("model_name"), says(m["model_family"]).alias("model_family"), says(m["developer"]).alias("developer"), F.coalesce(m["is_baseline"], F.lit(False)).alias("is_baseline"), named(m["benchmarks"]).alias("benchmarks")).cast(RAW_MODEL)
    full = lambda listed: F.filter(listed, lambda m: F.size(m["benchmarks"]) > 0)
    unknown = lambda benchmarks: full(F.array(F.struct(F.lit("unknown"), F.lit(None), F.lit(None), F.lit(False), benchmarks).cast(RAW_MODEL)))

    def of(answer: Column) -> Column:
        whole = full(F.transform(F.filter(_listed(answer, "models", RAW_MODEL), lambda m: says(m["model_name"]).isNotNull()), made))
        alone = unknown(F.transform(named(_listed(answer, "benchmarks", RAW)), lambda b: _only(b, ("score", "metric_name", *SETTINGS))))
        settings = F.coalesce(*(said(answer, k) for k in (*SETTINGS, "eval_harness", "seed"))).isNotNull() & (F.size(configuration(answer)) == 0)
        bare = unknown(F.when(settings, F.array(let(F.try_variant_get(answer, "$", RAW), lambda raw: _only(raw, SETTINGS, F.lit("unknown"))))))
        return let(whole, lambda w: F.when(F.size(w) > 0, w).otherwise(let(alone, lambda a: F.when(F.size(a) > 0, a).otherwise(F.coalesce(bare, F.array().cast(f"array<{RAW_MODEL}>"))))))

    return let(answer, of)


def models(answer: Column) -> Column:
    """An answer's models with their benchmarks, as an array; empty without any.

    Layouts, the first that gives a model: models with benchmarks; benchmarks alone, of the model "unknown", without the fields that only models have; settings alone and no global
    configuration, of an unknown benchmark. Models without a name or benchmarks go, as do benchmarks without a name. Null, or an answer that is no object, gives none; lists may be of any length.
    """
    return F.transform(raw_models(answer), lambda m: m.withField("benchmarks", F.transform(m["benchmarks"], benchmark)).cast(MODEL))


def rows(answers: DataFrame, answer: Column, *kept: str) -> DataFrame:
    """The same, a row a benchmark: columns kept, a model's fields and the benchmark's. Fields get their types as columns, which Spark compiles; inside an array it does not."""
    of = F.explode(raw_models(answer))
    found = answers.select(*kept, of.alias("m")).select(*kept, *(f"m.{k}" for k in MODEL_FIELDS), F.explode("m.benchmarks").alias("_b"))
    words, values = ({k: F.col(f"_{x}_{k}") for k in TYPES} for x in "wv")
    found = found.select("*", *(c.alias(f"_w_{k}") for k, c in _words(F.col("_b")).items()))
    found = found.select("*", *(typed(F.col("_b"), words[k], k).alias(f"_v_{k}") for k in TYPES))
    return found.select(*kept, *MODEL_FIELDS, _benchmark(words, values).alias("_b")).select(*kept, *MODEL_FIELDS, "_b.*")


def configuration(answer: Column) -> Column:
    """What an answer says of the whole paper, map<string,string>: harness, version, seed and whether the harness holds for all benchmarks (only if it is true or false)."""
    whole = at(answer, "global_config")
    flag = F.when(F.schema_of_variant(at(whole, "eval_harness_applies_to_all")) == "BOOLEAN", text(whole, "eval_harness_applies_to_all"))
    pairs = {k: said(whole, k) for k in ("eval_harness", "eval_library_version", "seed")} | {"eval_harness_applies_to_all": flag}
    return F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
