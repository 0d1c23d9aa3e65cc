"""Records from papers and model cards (C15-C17), the sheet for their annotation (P16), the best of several reports of a result (V15) and repair with its outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.normalize import arxiv_month
from tallyloom.operators.records import autofix, record_errors
from tallyloom.operators.stats import counted_before

# Names of benchmarks in a list of papers' results (lower case, without outer blanks) and their canonical names.
PAPER_BENCHMARKS = {
    "mmlu": "MMLU", "mmlu (5-shot)": "MMLU", "gsm8k": "GSM8K", "gsm8k (5-shot)": "GSM8K", "gsm8k (8-shot)": "GSM8K", "hellaswag": "HellaSwag", "hellaswag (10-shot)": "HellaSwag",
    "truthfulqa": "TruthfulQA", "truthfulqa (0-shot)": "TruthfulQA", "arc (challenge)": "ARC-Challenge", "arc-challenge": "ARC-Challenge", "winogrande": "WinoGrande", "humaneval": "HumanEval",
    "mbpp": "MBPP", "ifeval": "IFEval", "bbh": "BBH", "gpqa": "GPQA", "math": "MATH", "math (4-shot)": "MATH", "math500": "MATH-500", "math 500": "MATH-500", "mmlu-pro": "MMLU-Pro", "musr": "MuSR",
    "swe-bench": "SWE-bench", "swe-bench verified": "SWE-bench", "drop": "DROP", "natural questions": "NaturalQuestions", "alpaca_eval": "AlpacaEval 2.0", "alpacaeval 2.0": "AlpacaEval 2.0",
    "mt-bench": "MT-Bench", "humaneval+": "HumanEval+", "mbpp+": "MBPP+", "bigcodebench": "BigCodeBench",
}


def paper_benchmark(name: Column) -> Column:
    """the canonical name of a benchmark, null if it has none; rows of unknown ones are to be dropped."""
    known = F.create_map(*(F.lit(x) for pair in PAPER_BENCHMARKS.items() for x in pair))
    return F.try_element_at(known, F.lower(F.trim(name)))


def _full(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def safe(name: Column) -> Column:
    """A name in an id: signs other than letters of any script, digits, _ - . become _, 80 characters at most."""
    return F.left(F.regexp_replace(name, r"[^\p{L}\p{N}_\-.]", "_"), F.lit(80))


def same_organisation(authors: Column, family: Column) -> Column:
    """Whether a model family is named among a paper's authors, case, blanks and hyphens aside."""
    plain = lambda c: F.replace(F.replace(F.lower(c), F.lit("-")), F.lit(" "))
    return F.coalesce((family != "") & F.contains(plain(authors), plain(family)), F.lit(False))


def relationship(baseline: Column, authors: Column, family: Column) -> Column:
    """First party, unless the model is a baseline of another organisation."""
    return F.when(F.coalesce(baseline, F.lit(False)) & ~same_organisation(authors, family), "third_party").otherwise("first_party")


def paper_developer(told: Column, baseline: Column, family: Column, authors: Column) -> Column:
    """The developer that is told, else a baseline's family (unknown without one), else the authors."""
    own = F.when(F.coalesce(baseline, F.lit(False)), F.coalesce(_full(family), F.lit("unknown"))).otherwise(authors)
    return F.coalesce(_full(told), own)


def paper_harness(of_benchmark: Column, of_paper: Column, applies_to_all: Column) -> Column:
    """The benchmark's harness, else the paper's if it is said to hold for all benchmarks, else null."""
    return F.coalesce(of_benchmark, F.when(F.coalesce(applies_to_all, F.lit(False)), of_paper))


def arguments_hash(arguments: Column) -> Column:
    """Eight digits that tell settings apart, map<string,string> of JSON values by name."""
    entries = F.array_sort(F.map_entries(arguments))
    body = F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", ")
    return F.left(F.md5(F.concat(F.lit("{"), body, F.lit("}"))), F.lit(8))


def _text_map(**values: Column) -> Column:
    return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())


def _paper_source(label: Column, party: Column, paper: Column, **more: Column) -> Column:
    details = _text_map(
        paper_url=F.concat(F.lit("https://arxiv.org/abs/"), paper["arxiv_id"]), arxiv_id=paper["arxiv_id"], paper_title=F.coalesce(_full(paper["actual_title"]), paper["title"]),
        paper_title_expected=paper["title"], year=paper["year"], **more,
    )
    return F.struct(label.alias("source_name"), F.lit("documentation").alias("source_type"), F.lit("arXiv").alias("source_organization_name"), party.alias("evaluator_relationship"), details.alias("additional_details"))


def paper_record(paper: Column, model: Column, bench: Column, whole: Column, arguments: Column, approach: Column, day: Column) -> Column:
    """One model's result on one benchmark of a paper.

    paper: arxiv_id, title, actual_title, authors, year. model: model_name, developer, model_family, is_baseline. bench:
    benchmark_name, score, metric_name, eval_harness. whole: eval_harness, eval_harness_applies_to_all, seed,
    eval_library_version (null if the paper says nothing). arguments: map<string,string> of JSON values, shots among them.
    """
    label = F.concat(F.lit("arxiv_html_"), approach)
    name, task = F.replace(F.coalesce(model["model_name"], F.lit("unknown")), F.lit("_"), F.lit("-")), F.coalesce(bench["benchmark_name"], F.lit("unknown"))
    harness = paper_harness(bench["eval_harness"], whole["eval_harness"], whole["eval_harness_applies_to_all"])
    tag = F.concat_ws("_", F.coalesce(F.try_element_at(arguments, F.lit("shots")), F.lit("x")), arguments_hash(arguments))
    baseline = F.coalesce(model["is_baseline"], F.lit(False))
    return F.struct(
        F.lit("0.2.1").alias("schema_version"), F.concat_ws("/", label, safe(name), paper["arxiv_id"], task, tag).alias("evaluation_id"), day.alias("retrieved_timestamp"),
        _paper_source(
            label, relationship(baseline, paper["authors"], model["model_family"]), paper, paper_authors=paper["authors"], is_baseline=F.when(baseline, "True").otherwise("False"),
            model_family=F.coalesce(model["model_family"], F.lit("")), extraction_approach=approach,
        ).alias("source_metadata"),
        F.struct(F.coalesce(harness, F.lit("unknown")).alias("name"), F.coalesce(whole["eval_library_version"], F.lit("unknown")).alias("version")).alias("eval_library"),
        F.struct(name.alias("name"), safe(name).alias("id"), paper_developer(model["developer"], baseline, model["model_family"], paper["authors"]).alias("developer")).alias("model_info"),
        F.array(F.struct(
            task.alias("evaluation_name"), bench["metric_name"].alias("metric_name"), bench["score"].alias("score"), arguments.alias("generation_args"),
            _text_map(source=label, eval_harness=harness, seed=whole["seed"]).alias("additional_details"),
        )).alias("evaluation_results"),
    )


def fallback_record(paper: Column, name: Column, arguments: Column, more: Column, approach: Column, day: Column) -> Column:
    """C17: the record of a paper without a benchmark: score 0 on multiple_benchmarks. `more` are harness, decoding strategy and seed as map<string,string>."""
    label = F.concat(F.lit("arxiv_html_"), approach)
    return F.struct(
        F.lit("0.2.1").alias("schema_version"), F.concat_ws("/", label, safe(name), paper["arxiv_id"]).alias("evaluation_id"), day.alias("retrieved_timestamp"),
        _paper_source(label, F.lit("first_party"), paper, authors=paper["authors"], extraction_approach=approach).alias("source_metadata"),
        F.struct(F.coalesce(F.try_element_at(more, F.lit("eval_harness")), F.lit("unknown")).alias("name"), F.lit("unknown").alias("version")).alias("eval_library"),
        F.struct(name.alias("name"), safe(name).alias("id"), paper["authors"].alias("developer")).alias("model_info"),
        F.array(F.struct(
            F.lit("multiple_benchmarks").alias("evaluation_name"), F.lit("various").alias("metric_name"), F.lit(0.0).alias("score"), arguments.alias("generation_args"),
            F.map_concat(_text_map(source=label), F.map_filter(more, lambda k, v: v.isNotNull())).alias("additional_details"),
        )).alias("evaluation_results"),
    )


def card_record(model: Column, developer: Column, library: Column, results: Column, stamp: Column, papers: Column) -> Column:
    """A model card's results as a record; null without any.

    results: array<struct<benchmark, metric_name, score, shots, eval_lib>>. Shots below 0 (few, number unknown) are left out.
    The library is the first that a result tells, else the card's, else unknown; the month of the first paper dates it.
    """
    told = F.try_element_at(F.filter(F.transform(results, lambda r: _full(r["eval_lib"])), lambda x: x.isNotNull()), F.lit(1))
    shown = F.transform(results, lambda r: F.struct(
        r["benchmark"].alias("evaluation_name"), r["metric_name"].alias("metric_name"), r["score"].alias("score"), F.when(r["shots"] >= 0, r["shots"]).alias("shots"), _full(r["eval_lib"]).alias("harness"),
    ))
    dated = F.filter(F.transform(papers, arxiv_month), lambda x: x != "")
    return F.when(F.size(results) > 0, F.struct(
        F.concat_ws("/", F.lit("hf_model_cards"), F.replace(model, F.lit("/"), F.lit("_")), stamp).alias("evaluation_id"), F.try_element_at(dated, F.lit(1)).alias("evaluation_timestamp"), stamp.alias("retrieved_timestamp"),
        F.lit("first_party").alias("evaluator_relationship"), F.coalesce(told, _full(library), F.lit("unknown")).alias("library"), model.alias("model_id"), F.substring_index(model, "/", -1).alias("model_name"),
        developer.alias("developer"), shown.alias("results"),
    ))


def annotation_sheet(rows: DataFrame, sets: list[str], sample_set: str, path: str, columns: dict[str, Column]) -> DataFrame:
    """Rows to annotate, numbered from 1 by sample set, in the order given, and path; a path may come once in a set. Rows of other sets go.

    Numbers come from sums over ranges of the key, so no task sees all rows.
    """
    place = F.array_position(F.array(*map(F.lit, sets)), F.col(sample_set))
    empty = {"annotation": F.lit(""), "annotator_notes": F.lit("")}
    picked = rows.where(place > 0).withColumn("_key", F.concat(F.lpad(place.cast("string"), 6, "0"), F.lit("/"), F.col(path))).withColumn("_one", F.lit(1).cast("long"))
    numbered = counted_before(picked, "_key", "_one")
    return numbered.select((F.col("before") + 1).cast("long").alias("row_id"), F.col(sample_set).alias("sample_set"), *(c.alias(k) for k, c in columns.items()), F.col(path).alias("json_file"), *(c.alias(k) for k, c in empty.items()))


def report_date(stamp: Column, paper: Column) -> Column:
    """When a result was reported: its stamp, else the month of its paper, else 1970-01-01."""
    return F.coalesce(_full(stamp), _full(arxiv_month(paper)), F.lit("1970-01-01"))


def best_reports(rows: DataFrame, key: list[str], score: Column, most: Column, date: Column, order: Column) -> DataFrame:
    """Of the reports of a result the latest with a plausible score (not over 1.1 times the scale's top), else the latest; ties to the first in `order`."""
    odd = F.coalesce((most > 0) & (score > most * 1.1), F.lit(False))
    window = Window.partitionBy(*key).orderBy(odd, date.desc(), order)  # sorts and spills: reports of one result, however many
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def repaired(records: DataFrame, repair: bool = True) -> DataFrame:
    """Valid records, those that repair makes valid (fixed, or fixable where nothing is to be repaired), and invalid ones, with fixes and remaining errors."""
    before = record_errors(records).withColumn("_before", F.size("errors") == 0).drop("errors", "status")
    after = record_errors(autofix(before))
    status = F.when(F.col("_before"), "valid").when(F.size("errors") == 0, "fixed" if repair else "fixable").otherwise("invalid")
    return after.withColumn("status", status).drop("_before")


def pass_rate(audited: DataFrame) -> DataFrame:
    """Records by status and the share that is valid, as given or repaired."""
    by = {s: F.count_if(F.col("status") == s).alias(s) for s in ("valid", "fixed", "fixable", "invalid")}
    return audited.agg(F.count("*").alias("total"), *by.values(), F.try_divide(F.count_if(F.col("status").isin("valid", "fixed")), F.count("*")).alias("pass_rate"))
