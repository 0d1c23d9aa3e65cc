"""Evaluation settings, ids and answers read from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Harness -> patterns of a text that names it; the first harness that matches wins.
HARNESSES = (
    ("lm-eval-harness", (r"lm[_-]?eval", r"eleutherai.*harness", r"lm[_-]?harness")),
    ("helm", (r"\bhelm\b", r"stanford.*helm")),
    ("inspect", (r"\binspect\b.*eval", r"uk\s*aisi.*inspect")),
    ("vllm", (r"\bvllm\b",)),
    ("fastchat", (r"\bfastchat\b", r"mt[_-]?bench")),
    ("alpaca_eval", (r"alpaca[_-]?eval",)),
    ("bigcode-evaluation-harness", (r"bigcode.*harness", r"bigcodebench")),
)
# What a lower-case name says of a setting: (pattern, value), or None for the pattern's own group; the first that matches wins.
NAME_SETTINGS = {
    "shots": ((r"(\d+)[- ]shot", None), (r"zero[- ]shot", "0"), (r"(?=.*few[- ]shot).*?k\s*=\s*(\d+)", None), (r"few[- ]shot", "few"), (r"one[- ]shot", "1")),
    "chain_of_thought": ((r"\bcot\b", "yes"), (r"chain[- ]of[- ]thought", "yes"), (r"w/o\s+code", "yes"), (r"without\s+code", "yes")),
    "self_consistency": ((r"self[- ]consist", "yes"), (r"\bsc\b", "yes"), (r"maj(?:1)?@\d+", "yes")),
    "samples": ((r"maj(?:1)?@(\d+)", None), (r"(\d+)\s*samples?", None)),
    "decoding": ((r"greedy", "greedy"), (r"sampl", "sampling")),
    "temperature": ((r"temp(?:erature)?\s*=?\s*([0-9.]+)", None), (r"greedy", "0.0")),
    "tool_use": ((r"\bpal\b", "PAL"), (r"tool[- ]integrated", "TIR"), (r"^(?!.*w/o).*w/\s*code", "code"), (r"^(?!.*w/o).*with\s+code", "code")),
    "fine_tuned": ((r"fine[- ]?tun", "yes"),),
}
# Kinds of prompts, all that match are told.
PROMPT_KINDS = ((r"auto[- ]optimized", "auto-optimized prompting"), (r"mc[ot]\b", "multilingual CoT"), (r"qa prompt", "QA prompt"))
FEW = -1  # some shots, number unknown


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def shots(text: Column, words: bool = True) -> Column:
    """n of n-shot; with words also zero-shot (0), one-shot (1) and few-shot (FEW)."""
    low = F.lower(text)
    told = _group(low, r"(\d+)[- ]shot").try_cast("int")
    if not words:
        return told
    return F.coalesce(told, F.when(low.rlike("zero[- ]?shot"), 0).when(low.rlike("one[- ]?shot"), 1).when(low.rlike("few[- ]?shot"), FEW))


def chain_of_thought(text: Column) -> Column:
    """true if the text speaks of it, else null."""
    return F.when(F.lower(text).rlike(r"\bcot\b|chain[- ]of[- ]thought"), True)


def temperature(text: Column) -> Column:
    """the number after temp or temperature."""
    return _group(F.lower(text), r"temp(?:erature)?\s*=?\s*([0-9.]+)").try_cast("double")


def name_settings(name: Column) -> Column:
    """what a model's name says of its evaluation: ten fields, text or null. Remarks in brackets are read first and leave the name."""
    remark = F.coalesce(_group(name, r"\(([^)]+)\)\s*$"), _group(name, r"\(([^)]+)\)"), F.lit(""))
    told = F.lower(F.concat(remark, F.lit(" "), name))
    first = lambda rules: F.coalesce(*(_group(told, p) if v is None else F.when(told.rlike(p), F.lit(v)) for p, v in rules))
    last = r"\s*\([^)]+\)\s*$"
    bare = F.trim(F.when(name.rlike(last), F.regexp_replace(name, last, "")).otherwise(F.regexp_replace(name, r"\([^)]+\)", "")))
    prompts = F.nullif(F.concat_ws("; ", *(F.when(told.rlike(p), F.lit(v)) for p, v in PROMPT_KINDS)), F.lit(""))
    return F.struct(bare.alias("clean_name"), *(first(rules).alias(field) for field, rules in NAME_SETTINGS.items()), prompts.alias("prompt_info"))


def harness(text: Column) -> Column:
    """the first harness that a text names, or empty."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.rlike(pattern), F.lit(name)) for name, patterns in HARNESSES for pattern in patterns), F.lit(""))


def arxiv_ids(text: Column) -> Column:
    """F32: distinct ids of a text, those in addresses first, in order."""
    linked = F.regexp_extract_all(text, F.lit(r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})"), 1)
    named = F.regexp_extract_all(text, F.lit(r"(?i)(?:paper|preprint|citation)[:\s]+(\d{4}\.\d{4,5})"), 1)
    return F.array_distinct(F.concat(linked, named))


def clean_value(value: Column) -> Column:
    """words for nothing become null."""
    return F.when(~F.lower(F.trim(value)).isin("", "null", "none", "n/a", "na", "unknown", "not specified"), value)


def clean_list(values: Column) -> Column:
    """null if every entry means nothing."""
    return F.when(F.exists(values, lambda v: F.coalesce(clean_value(v).isNotNull(), F.lit(False))), values)


def interval(centre: Column, text: Column) -> Column:
    """(lower, upper) around a score from +a/-b or ±d."""
    plus, minus = _group(text, r"\+\s*([0-9.]+)\s*/\s*-\s*[0-9.]+").try_cast("double"), _group(text, r"\+\s*[0-9.]+\s*/\s*-\s*([0-9.]+)").try_cast("double")
    both = _group(text, r"±\s*([0-9.]+)").try_cast("double")
    return F.struct((centre - F.coalesce(minus, both)).alias("lower"), (centre + F.coalesce(plus, both)).alias("upper"))


def rating(text: Column) -> Column:
    """[[n]], else Rating: n; 1 to 10 only."""
    n = F.coalesce(_group(text, r"\[\[(\d+(?:\.\d+)?)\]\]"), _group(text, r"(?i)rating:\s*(\d+(?:\.\d+)?)")).try_cast("double")
    return F.when(n.between(1, 10), n)


def final_number(text: Column) -> Column:
    """the number after ####, else the last number; commas dropped."""
    marked = _group(text, r"####\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?)")
    last = F.element_at(F.regexp_extract_all(text, F.lit(r"-?[0-9][0-9,]*(?:\.[0-9]+)?"), 0), -1)
    found = F.coalesce(marked, F.when(text.rlike("[0-9]"), last))
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def answers(text: Column) -> Column:
    """what each extractor takes as the answer: strict (####), last number, boxed, 'answer is', and the first that finds one."""
    number = r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)"
    plain = lambda c: F.replace(c, F.lit(","), F.lit(""))
    strict = plain(_group(text, rf"####\s*{number}"))
    last = plain(F.when(text.rlike("[0-9]"), F.element_at(F.regexp_extract_all(text, F.lit(number), 1), -1)))
    boxed = plain(_group(text, rf"\\boxed\{{\s*{number}\s*\}}"))
    said = plain(_group(text, rf"(?i)answer is:?\s*\$?{number}"))
    return F.struct(strict.alias("strict"), last.alias("last_number"), boxed.alias("boxed"), said.alias("answer_is"), F.coalesce(strict, boxed, said, last).alias("flexible"))


def sample_hash(raw: Column, reference: Column) -> Column:
    """one recipe for all harnesses, over the text and its reference."""
    return F.sha2(F.to_json(F.struct(raw.alias("raw"), reference.alias("reference"))), 256)


def json_text(text: Column) -> Column:
    """a text as a JSON string of ASCII signs only, as Python's json writes it: others become \\uXXXX, pairs of them beyond 16 bits."""
    short = {"0022": '\\"', "005C": "\\\\", "000A": "\\n", "000D": "\\r", "0009": "\\t", "0008": "\\b", "000C": "\\f"}
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), 0)
    one = lambda u: F.coalesce(
        *(F.when(u == k, F.lit(v)) for k, v in short.items()), F.when((u >= "0020") & (u <= "007E"), F.char(F.conv(u, 16, 10).cast("int"))), F.concat(F.lit("\\u"), F.lower(u))
    )
    plain = text.rlike(r"^[\x20\x21\x23-\x5B\x5D-\x7E]*$")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(units, one), "")), F.lit('"'))


def prompt_hash(text: Column) -> Column:
    """SHA-256 of a prompt without blanks at line ends."""
    return F.sha2(F.array_join(F.transform(F.split(text, r"\r\n|\r|\n", -1), lambda line: F.regexp_replace(line, r"(?U)\s+$", "")), "\n"), 256)


def value_in_text(value: Column, text: Column) -> Column:
    """F40, text values: as it stands, in any case, with - and _ as blanks, or without punctuation (4 characters or more)."""
    low, body = F.lower(F.trim(value)), F.lower(text)
    spaced = lambda c: F.regexp_replace(c, "[-_]", " ")
    bare = lambda c: F.regexp_replace(c, r"[\s\-_.()]+", "")
    return value.isNull() | (low == "") | F.contains(body, low) | F.contains(spaced(body), spaced(low)) | ((F.length(bare(low)) >= 4) & F.contains(bare(body), bare(low)))


def numbers(text: Column) -> Column:
    """the distinct numbers of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b\d+\.?\d*\b"), 0), lambda x: x.cast("double")))


def title_share(want: Column, have: Column) -> Column:
    """share of the wanted title's words that the other has; 0 unless the first words agree."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")
    a, b = words(want), words(have)
    share = F.try_divide(F.size(F.filter(a, lambda w: F.array_contains(b, w))), F.size(a))
    return F.when(F.try_element_at(a, F.lit(1)) == F.try_element_at(b, F.lit(1)), share).otherwise(F.lit(0.0))


def same_words(a: Column, b: Column) -> Column:
    """the same words in any order."""
    bag = lambda c: F.array_sort(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))
    return bag(a) == bag(b)


def head_and_tail(text: Column, limit: int) -> Column:
    """a text too long keeps its first and last halves of the limit."""
    half = limit // 2
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit("\n...\n"), F.right(text, F.lit(half)))).otherwise(text)


def argmax(values: Column) -> Column:
    """position of the largest entry from 0, the first of equals."""
    return F.array_position(values, F.array_max(values)) - 1


def choices(arguments: Column) -> Column:
    """the second argument of gen_args_0, gen_args_1, ... up to the first gap; arguments: map of struct arg_0, arg_1."""
    numbered = F.transform(F.sequence(F.lit(0), F.size(arguments)), lambda i: F.try_element_at(arguments, F.concat(F.lit("gen_args_"), i.cast("string")))["arg_1"])
    return F.slice(numbered, F.lit(1), F.coalesce(F.nullif(F.array_position(F.transform(numbered, lambda x: x.isNull()), True), F.lit(0)) - 1, F.size(numbered)))


def interaction(assistants: Column, tools: Column) -> Column:
    """agentic with tools, multi_turn with more than one assistant message, else single_turn."""
    return F.when(tools > 0, "agentic").when(assistants > 1, "multi_turn").otherwise("single_turn")


def bibtex(key: Column, title: Column, authors: Column, year: Column) -> Column:
    """F50."""
    return F.concat(F.lit("@article{"), key, F.lit(",\n  title={"), title, F.lit("},\n  author={"), authors, F.lit("},\n  year={"), year.cast("string"), F.lit("}\n}"))


def summary(text: Column, limit: int = 200) -> Column:
    """cut to the limit with dots."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def title_keyword(title: Column, body: Column) -> Column:
    """whether the body has a capitalised word of the title."""
    return F.exists(F.regexp_extract_all(title, F.lit(r"\b([A-Z][A-Za-z0-9]{2,})\b"), 1), lambda w: F.contains(F.lower(body), F.lower(w)))
