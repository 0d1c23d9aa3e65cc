"""Names, numbers, dates and scales brought to one form. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metrics of a 0-100 scale, and metrics where lower is better with their least value.
PERCENT_METRICS = (
    "accuracy", "pass@1", "pass@k", "pass@10", "pass@32", "pass@100", "em", "exactmatch", "exact_match", "f1", "bleu", "rouge", "rougel", "rouge1", "average",
)
LOWER_BETTER = {"perplexity": 1.0, "ppl": 1.0, "loss": 0.0, "bitsperbyte": 0.0}

# Part of an organisation's name -> developer.
ORGANISATIONS = {
    "openai": "openai", "google": "google", "meta": "meta-llama", "anthropic": "anthropic", "mistral": "mistralai", "alibaba": "Qwen", "microsoft": "microsoft",
    "deepseek": "deepseek-ai", "cohere": "CohereForAI", "01.ai": "01-ai", "nvidia": "nvidia", "ai21": "ai21labs", "tii": "tiiuae", "xai": "xai", "lmsys": "lmsys",
    "databricks": "databricks", "bigcode": "bigcode", "eleutherai": "EleutherAI", "mosaicml": "mosaicml", "allenai": "allenai", "together": "togethercomputer",
}
# Start of a model's name -> developer.
FAMILIES = {
    "gpt": "openai", "text-davinci": "openai", "text-curie": "openai", "davinci": "openai", "curie": "openai", "o1": "openai", "o3": "openai", "openai": "openai", "chatgpt": "openai",
    "claude": "anthropic", "gemini": "google", "gemma": "google", "palm": "google", "t5": "google", "ul2": "google", "flan": "google", "chinchilla": "google-deepmind", "gopher": "google-deepmind", "sparrow": "google",
    "codellama": "meta-llama", "llama": "meta-llama", "opt": "meta", "mistral": "mistralai", "mixtral": "mistralai", "open-mistral": "mistralai", "codestral": "mistralai", "mathstral": "mistralai",
    "qwen": "Qwen", "qwq": "Qwen", "phi": "microsoft", "orca": "microsoft", "wizardlm": "microsoft", "falcon": "tiiuae", "bloom": "bigscience", "pythia": "EleutherAI", "gpt-j": "EleutherAI", "gpt-neox": "EleutherAI",
    "mpt": "mosaicml", "dbrx": "databricks", "deepseek": "deepseek-ai", "yi": "01-ai", "olmo": "allenai", "tulu": "allenai", "grok": "xai", "alpaca": "stanford", "vicuna": "lmsys",
    "starcoder": "bigcode", "santacoder": "bigcode", "codegen": "salesforce", "xgen": "salesforce", "command-r": "CohereForAI", "command": "CohereForAI", "aya": "CohereForAI", "jamba": "ai21labs", "jurassic": "ai21labs",
    "nemotron": "nvidia", "megatron": "nvidia", "solar": "upstage", "exaone": "LGAI-RESEARCH", "chatglm": "THUDM", "glm": "THUDM", "codegeex": "THUDM", "internlm": "internlm", "internvl": "OpenGVLab",
    "baichuan": "baichuan-inc", "redpajama": "togethercomputer", "palmyra": "Writer", "openhermes": "teknium", "nous-hermes": "NousResearch", "hermes": "NousResearch",
}
# Output type of a task -> how it is scored.
SCORING_MODES = {"loglikelihood": "log-likelihood", "loglikelihood_rolling": "log-likelihood", "multiple_choice": "log-likelihood", "generate_until": "generation"}

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def norm_bench(name: Column) -> Column:
    """lower case, blanks collapsed, (...) dropped, letters and digits kept."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(key, r"\s*\(.*?\)", ""), "[^a-z0-9]", "")


def norm_model(model_id: Column, name: Column) -> Column:
    """what follows the last slash of the id (else the name), letters and digits kept."""
    tail = F.element_at(F.split(F.trim(F.coalesce(F.nullif(model_id, F.lit("")), name, F.lit(""))), "/", -1), -1)
    return F.regexp_replace(F.lower(tail), "[^a-z0-9]", "")


def path_safe(name: Column) -> Column:
    """a name as part of a path."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def number(text: Column) -> Column:
    """a decimal number, or null; neither type suffixes nor NaN."""
    return F.when(text.cast("string").rlike(_NUMBER), text.cast("string").try_cast("double"))


def percent(text: Column) -> Column:
    """a number with per cent signs and thousands commas removed."""
    return number(F.regexp_replace(F.trim(text), "[%,]", ""))


def arxiv_id(url: Column) -> Column:
    """the id in an address, without its version; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"arxiv\.org/abs/(\d{4}\.\d{4,5})", 1), F.lit(""))


def arxiv_month(paper: Column) -> Column:
    """first day of the month in an id, as text; empty if the month is none."""
    yy, mm = F.regexp_extract(paper, r"^(\d{2})(\d{2})\.", 1), F.regexp_extract(paper, r"^(\d{2})(\d{2})\.", 2)
    return F.when(mm.try_cast("int").between(1, 12), F.concat(F.lit("20"), yy, F.lit("-"), mm, F.lit("-01"))).otherwise(F.lit(""))


def stamp_day(stamp: Column) -> Column:
    """the UTC day of epoch seconds written as text, else the first ten characters."""
    seconds = F.when(stamp.rlike(r"^\d+(\.\d+)?$"), stamp.try_cast("double"))
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"), F.left(stamp, F.lit(10)))


def iso_date(text: Column) -> Column:
    """yyyy-mm-dd of yyyy-mm-dd, yyyy/mm/dd or yyyymmdd; else empty."""
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(text, F.lit(10)))
        .when(text.rlike(r"^\d{4}/\d{2}/\d{2}"), F.replace(F.left(text, F.lit(10)), F.lit("/"), F.lit("-")))
        .when(text.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))
        .otherwise(F.lit(""))
    )


def as_percent(score: Column) -> Column:
    """F16: a score of at most 1 is a fraction. Unrounded; py_round gives the report's two digits."""
    return F.when(score <= 1, score * 100).otherwise(score)


def metric_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s_-]+", ""))


def normalize_score(score: Column, metric: Column) -> Column:
    """a score in (0, 1] of a per cent metric times 100."""
    return F.when(metric_key(metric).isin(*PERCENT_METRICS) & (score > 0) & (score <= 1), score * 100).otherwise(score)


def as_fraction(score: Column) -> Column:
    """a score above 1 divided by 100."""
    return F.when(score > 1, score / 100).otherwise(score)


def guess_scale(score: Column, metric: Column) -> Column:
    """the top of the scale that a score and its metric suggest: 1, 100 or unbounded (null)."""
    key = metric_key(metric)
    return F.when(key.isin(*LOWER_BETTER), F.lit(None).cast("double")).when(score <= 1, F.lit(1.0)).when(score <= 100, F.lit(100.0))


def to_fraction(score: Column, least: Column, most: Column) -> Column:
    """position within the bounds; the score itself if they coincide."""
    return F.when(most == least, score).otherwise(F.try_divide(score - least, most - least))


def severity(gap: Column) -> Column:
    """bins of a relative difference."""
    return F.when(gap == 0, "exact").when(gap < 0.005, "rounding").when(gap < 0.02, "minor").when(gap < 0.10, "significant").otherwise("major")


def metric_bounds(name: Column) -> Column:
    """(lower_is_better, least, most) of a metric; families of pass@k and rouge count as theirs, others are null."""
    key = metric_key(name)
    known = key.isin(*PERCENT_METRICS) | key.startswith("pass@") | key.startswith("rouge")
    low = F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in LOWER_BETTER.items()))
    return F.when(known, F.struct(F.lit(False).alias("lower_is_better"), F.lit(0.0).alias("least"), F.lit(100.0).alias("most"))).when(
        low.isNotNull(), F.struct(F.lit(True).alias("lower_is_better"), low.alias("least"), F.lit(None).cast("double").alias("most"))
    )


def score_range(text: Column) -> Column:
    """(least, most) of text like 0-100; inf and none are open ends."""
    parts = F.filter(F.split(F.trim(text), r"[\-–—to ]+"), lambda p: F.trim(p) != "")
    end = lambda i: F.when(~F.lower(F.element_at(parts, i)).isin("inf", "none"), number(F.element_at(parts, i)))
    return F.when(F.size(parts) == 2, F.struct(end(1).alias("least"), end(2).alias("most")))


def alias(name: Column, table: dict[str, str], fold: bool = False) -> Column:
    """The canonical name, or the name itself; fold looks it up in lower case."""
    if not table:
        return name
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower(name) if fold else name), name)


def developer(name: Column, organisation: Column, families: dict[str, str] | None = None) -> Column:
    """the organisation's developer, else that of the longest family that starts the name or a part of it, else unknown."""
    org, low = F.lower(F.coalesce(organisation, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    families = FAMILIES if families is None else families
    told = [F.when(org.contains(k), F.lit(v)) for k, v in ORGANISATIONS.items()]
    guessed = [F.when(low.startswith(k) | low.contains("-" + k) | low.contains("/" + k), F.lit(v)) for k, v in sorted(families.items(), key=lambda x: -len(x[0]))]
    return F.coalesce(*told, *guessed, F.lit("unknown"))


def model_name(name: Column) -> Column:
    """7b becomes 7B, underscores become hyphens."""
    return F.replace(F.trim(F.regexp_replace(name, r"(\d+)[bB]\b", "$1B")), F.lit("_"), F.lit("-"))


def model_id(name: Column, organisation: Column) -> Column:
    """developer/name, or the name if it has a slash."""
    return F.when(name.contains("/"), name).otherwise(F.concat_ws("/", developer(name, organisation), name))


def provider_path(path: Column) -> Column:
    """(provider, model) of provider/.../model; the last part is the model, the first the provider if there are two or more."""
    parts = F.split(path, "/", -1)
    return F.struct(F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("unknown")).alias("provider"), F.element_at(parts, -1).alias("model"))


def model_args(text: Column) -> Column:
    """a map of k=v pairs; a comma that starts no new key belongs to the value before it."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), r",(?=[^,=]+=)", -1), lambda p: p.contains("="))
    keys = F.transform(pairs, lambda p: F.trim(F.substring_index(p, "=", 1)))
    return F.map_from_entries(F.transform(F.arrays_zip(keys.alias("k"), pairs.alias("p")), lambda x: F.struct(x["k"].alias("key"), F.trim(F.substring(x["p"], F.instr(x["p"], F.lit("=")) + 1, F.length(x["p"]))).alias("value"))))


def scoring_mode(output_type: Column) -> Column:
    """how a task of this output type is scored."""
    return F.coalesce(*(F.when(output_type == k, F.lit(v)) for k, v in SCORING_MODES.items()), F.lit("unknown"))


def first_number(*values: Column) -> Column:
    """The first value that is a number."""
    return F.coalesce(*map(percent, values))
