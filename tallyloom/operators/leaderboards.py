"""Leaderboards to results (C12) and scraped rows to records (C13): the layout of each document is told from its VARIANT, and its board's converter is looked up by name.

A board's document is whole (an object or a list) or one row of a table (an object of its cells). Documents become entries, one a model; entries become results, an array in place.
Only boards that put several rows of a model together (AlpacaEval, MT-Bench) are shuffled, by model. Scores are whole numbers, decimals or text of them; true and false are no scores.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.normalize import developer, iso_date
from tallyloom.functions.normalize import number as decimal
from tallyloom.operators.schema import let
from tallyloom.operators.stats import py_round

ENTRY = "struct<model:string,organization:string,eval_date:string,keyed:boolean,body:variant>"
RESULT = "struct<benchmark:string,score:double,shots:int,metric:string,least:double,most:double,note:string,reasoning:boolean,missing:boolean,rank:bigint,details:map<string,string>>"

# Columns of the open leaderboard's table -> (benchmark, shots, metric, note, whether reasoning is asked for).
OPEN_BOARD = {
    "IFEval": ("IFEval (strict-prompt)", 0, "prompt_level_strict_acc", None, None),
    "BBH": ("BBH", 3, "acc_norm", "3-shot, multiple choice (log-likelihood)", False),
    "MATH Lvl 5": ("MATH Lvl 5", 4, "exact_match", "4-shot, generative, worked solutions in the prompt, level 5 only", True),
    "GPQA": ("GPQA-Diamond", 0, "acc_norm", "0-shot, multiple choice (log-likelihood), Diamond subset", False),
    "MUSR": ("MuSR", 0, "acc_norm", "0-shot, multiple choice (log-likelihood)", False),
    "MMLU-PRO": ("MMLU-Pro", 5, "accuracy", "5-shot, multiple choice (log-likelihood)", False),
}
# Benchmarks of the open leaderboard's documents.
OPEN_NAMES = {"ifeval": "IFEval", "bbh": "BBH", "math": "MATH Level 5", "gpqa": "GPQA-Diamond (acc_norm)", "musr": "MUSR", "mmlu_pro": "MMLU-PRO"}
# Problems of the verified set, categories of MT-Bench, notes.
VERIFIED = 500
CATEGORIES = ("writing", "roleplay", "reasoning", "math", "coding", "extraction", "stem", "humanities")
AGENTIC = "agentic scaffolding; not directly comparable to non-agentic benchmarks"
PAIRWISE = "GPT-4-based pairwise judge vs GPT-4-Turbo baseline; scale -100 to 100"


def at(value: Column, key: str, kind: str = "variant") -> Column:
    """An object's member; SQL null if it is absent, or null and not asked for as a VARIANT."""
    return F.try_variant_get(value, f"$['{key}']" if key else "$['']", kind)


def text(value: Column, key: str) -> Column:
    return at(value, key, "string")


def number(words: Column) -> Column:
    return let(words, decimal)


def either(value: Column, keys: Sequence[str]) -> Column:
    """Text of the first member that is neither null, empty, false nor the number 0; else of the last one of them, if it is there."""
    if len(keys) == 1:
        return text(value, keys[0])
    told = [F.struct(text(value, k).alias("text"), F.schema_of_variant(at(value, k)).alias("kind")) for k in keys]
    full = lambda x: (x["text"] != "") & ~((x["kind"] == "BOOLEAN") & (x["text"] == "false")) & ~(x["kind"].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & (number(x["text"]) == 0))
    return let(F.array(*told), lambda all_: F.coalesce(F.try_element_at(F.filter(all_, full), F.lit(1)), all_[len(keys) - 1])["text"])


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def members(value: Column) -> Column:
    """(key, value) of an object, by key; none of anything else."""
    return F.coalesce(F.map_entries(F.when(is_object(value), F.try_variant_get(value, "$", "map<string,variant>"))), F.array().cast("array<struct<key:string,value:variant>>"))


def items(value: Column, *keys: str) -> Column:
    """A list's items, or those of the first of an object's members that is there."""
    chosen = reduce(lambda rest, k: F.when(at(value, k).isNotNull(), at(value, k, "array<variant>")).otherwise(rest), reversed(keys), F.lit(None).cast("array<variant>"))
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), chosen, F.array().cast("array<variant>"))


def every_member_has(value: Column, key: str) -> Column:
    """The layout model -> result: each member is an object with this key."""
    return (F.size(members(value)) > 0) & F.forall(members(value), lambda m: is_object(m["value"]) & at(m["value"], key).isNotNull())


def entry(model: Column, body: Column, organization: Column | None = None, eval_date: Column | None = None, split: bool = False, keyed: bool = False) -> Column:
    """An entry; split takes a name org/.../model apart; keyed tells that the document is model -> result."""
    org = F.when(model.contains("/"), F.substring_index(model, "/", 1)).otherwise(F.lit("")) if split else F.lit("")
    name = F.substring_index(model, "/", -1) if split else model
    return F.struct(name.alias("model"), (organization if organization is not None else org).alias("organization"), (eval_date if eval_date is not None else F.lit("")).alias("eval_date"), F.lit(keyed).alias("keyed"), body.alias("body")).cast(ENTRY)


def result(benchmark: Column | str, score: Column, shots: int | None, metric: str, least: float, most: float, note: str | None = None, reasoning: bool | None = None, missing: Column | None = None, rank: Column | None = None, details: Column | None = None) -> Column:
    """A result; null without a score."""
    return let(score, lambda score: F.when(score.isNotNull(), F.struct(
        (F.lit(benchmark) if isinstance(benchmark, str) else benchmark).alias("benchmark"), score.alias("score"), F.lit(shots).cast("int").alias("shots"), F.lit(metric).alias("metric"), F.lit(least).alias("least"), F.lit(most).alias("most"),
        F.lit(note).cast("string").alias("note"), F.lit(reasoning).cast("boolean").alias("reasoning"), (F.lit(False) if missing is None else missing).alias("missing"), (F.lit(0) if rank is None else rank).cast("bigint").alias("rank"),
        (F.lit(None).cast("map<string,string>") if details is None else details).alias("details"),
    ).cast(RESULT)))


def details_of(pairs: dict[str, Column]) -> Column:
    """Details whose values are there; null without any."""
    kept = F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: F.coalesce(v != "", F.lit(False)))
    return F.when(F.size(kept) > 0, kept)


def as_percentage(score: Column) -> Column:
    """A score of at most 1 is a fraction; two digits."""
    return let(score, lambda v: py_round(F.when(v <= 1, v * 100).otherwise(v), 2))


@dataclass(frozen=True)
class Board:
    """entries(document, name) -> array of ENTRY; results(entry's body, struct of name and keyed) -> RESULTs, null where there is none. merged: rows of one model are put together, the greatest rank stays."""

    entries: Callable[[Column, Column], Column]
    results: Callable[[Column, Column], Sequence[Column]]
    merged: bool = False
    averaged: bool = False


BOARDS: dict[str, Board] = {}
SCRAPED: dict[str, Board] = {}


def board(name: str, registry: dict[str, Board] | None = None, merged: bool = False, averaged: bool = False):
    """Register a class with entries and results under a name; a later one of the same name replaces it."""

    def register(cls):
        (BOARDS if registry is None else registry)[name] = Board(cls.entries, cls.results, merged, averaged)
        return cls

    return register


def row_entries(*names: str, organization: str | None = None):
    """Entries of a table's row: one, by the first of these names, without outer blanks."""

    def entries(row: Column, _: Column) -> Column:
        model = F.trim(either(row, names))
        org = F.coalesce(F.trim(text(row, organization)), F.lit("")) if organization else None
        return F.array(entry(model, row, org))

    return staticmethod(entries)


@board("open_llm_leaderboard_v2")
class _OpenTable:
    @staticmethod
    def entries(row, _):
        return F.array(entry(F.trim(text(row, "fullname")), row, split=True))

    @staticmethod
    def results(row, _):
        return [result(b, py_round(number(text(row, c)), 2), shots, metric, 0.0, 100.0, note, cot) for c, (b, shots, metric, note, cot) in OPEN_BOARD.items()]


@board("evalplus")
class _EvalPlus:
    """Three layouts: model -> {pass@1: {...}}; a list (or models, results) of flat entries; the same of entries with pass@1 inside. Only in the first is a score of 0 one."""

    @staticmethod
    def entries(doc, _):
        listed = F.transform(items(doc, "models", "results"), lambda e: entry(either(e, ["model", "name"]), e, split=True))
        return F.when(every_member_has(doc, "pass@1"), F.transform(members(doc), lambda m: entry(m["key"], m["value"], split=True, keyed=True))).otherwise(listed)

    @staticmethod
    def results(body, about):
        nested = at(body, "pass@1")
        listed = lambda low, high: either(F.to_variant_object(F.struct(at(nested, low).alias("a"), at(body, low).alias("b"), at(body, high).alias("c"))), ["a", "b", "c"])
        first = lambda low, high: number(F.when(about["keyed"], text(nested, low)).otherwise(listed(low, high)))
        return [result(b, as_percentage(first(low, b)), shots, "pass@1", 0.0, 100.0) for b, low, shots in (("HumanEval+", "humaneval+", 0), ("MBPP+", "mbpp+", 3))]


@board("bfcl")
class _Calls:
    entries = row_entries("Model")

    @staticmethod
    def results(row, _):
        share = lambda k: py_round(number(F.rtrim(F.trim(text(row, k)), F.lit("%"))), 2)
        overall = share("Overall Acc")
        details = details_of({k: F.trim(text(row, k)) for k in ("Total Cost ($)", "Latency Mean (s)")})
        parts = (("BFCL-v3", overall, details), ("BFCL-v3 AST", share("Non-Live AST Acc"), None), ("BFCL-v3 Live", share("Live Overall Acc"), None))
        return [result(b, F.when(overall.isNotNull(), s), 0, "accuracy", 0.0, 100.0, details=d) for b, s, d in parts]


@board("swe_bench")
class _Verified:
    """name: the submission, yyyymmdd_agent. Without a list of what is resolved the score is 0 and missing."""

    @staticmethod
    def entries(doc, name):
        day = F.substring_index(name, "_", 1)
        agent = F.when(name.contains("_"), F.substring(name, F.length(day) + 2, F.length(name))).otherwise(name)
        return F.array(entry(agent, doc, eval_date=F.when(day.rlike(r"^\d{8}$"), iso_date(day)).otherwise(F.lit(""))))

    @staticmethod
    def results(doc, about):
        absent = at(doc, "resolved").isNull()
        n = F.when(absent, F.lit(0)).otherwise(F.nullif(F.size(at(doc, "resolved", "array<variant>")), F.lit(-1)))
        details = details_of(dict(resolved=n, total=F.lit(VERIFIED), submission=about["name"]))
        return [result("SWE-Bench-Verified", py_round(n / VERIFIED * 100, 2), 0, "resolved_pct", 0.0, 100.0, AGENTIC, missing=absent, details=details)]


@board("alpacaeval2", merged=True)
class _Alpaca:
    """Rows of a model are put together: the last rate of a row that gives it stays; a rate told by the row's mode counts only without such a row, and then the first."""

    entries = row_entries("model", "", "Unnamed: 0")

    @staticmethod
    def results(row, _):
        given = py_round(number(either(row, ["length_controlled_winrate", "lc_win_rate"])), 2)
        raw, mode = py_round(number(text(row, "win_rate")), 2), F.lower(F.trim(text(row, "mode")))
        by_mode = F.when(mode.contains("weighted") | mode.contains("lc"), raw)
        return [
            result("AlpacaEval 2.0 LC", given, 0, "lc_win_rate", 0.0, 100.0, rank=F.lit(2)), result("AlpacaEval 2.0", raw, 0, "win_rate", 0.0, 100.0, rank=F.lit(2)),
            result("AlpacaEval 2.0 LC", F.when(given.isNull(), by_mode), 0, "lc_win_rate", 0.0, 100.0, rank=F.lit(1)),
        ]


@board("chatbot_arena")
class _Arena:
    entries = row_entries("Model", organization="Organization")

    @staticmethod
    def results(row, _):
        votes = number(F.replace(F.coalesce(F.nullif(text(row, "Votes"), F.lit("")), F.lit("0")), F.lit(",")))
        both, same = r"^\+?(\d+\.?\d*)[/\-](\d+\.?\d*)$", r"^[±]?(\d+\.?\d*)$"
        bounds = lambda ci: F.when(ci.rlike(both), F.array(F.regexp_extract(ci, both, 1), F.regexp_extract(ci, both, 2))).when(ci.rlike(same), F.array_repeat(F.regexp_extract(ci, same, 1), 2))
        details = lambda elo, ends: details_of(dict(ci_upper=py_round(elo + ends[0].try_cast("double"), 1), ci_lower=py_round(elo - ends[1].try_cast("double"), 1), num_battles=votes.cast("bigint")))
        made = lambda elo: result("Arena Elo", elo, None, "elo", 0.0, 3000.0, "raw Elo; practical range ~800–1400", details=let(let(F.trim(text(row, "95% CI")), bounds), lambda ends: details(elo, ends)))
        return [let(number(F.trim(text(row, "Arena Score"))), made)]


@board("mt_bench", averaged=True)
class _Judged:
    """Rows are single judgements: (model_id, category, score); their mean is the result, means of the known categories its details."""

    @staticmethod
    def entries(row, _):
        return F.array(entry(text(row, "model_id"), row))

    @staticmethod
    def results(row, _):
        return [result("MT-Bench", number(text(row, "score")), None, "judge_score", 0.0, 10.0, "GPT-4 judge score averaged over 8 categories", details=details_of(dict(category=text(row, "category"))))]


@board("wildbench")
class _Wild:
    """Three layouts: model -> {score, adjusted_score} from 1 to 10; a list (or models, rows) of entries from -100 to 100; the same with entries inside row."""

    @staticmethod
    def entries(doc, _):
        inner = F.transform(items(doc, "models", "rows"), lambda e: F.coalesce(at(e, "row"), e))
        listed = F.transform(inner, lambda e: entry(either(e, ["model_id", "model"]), e, split=True))
        return F.when(every_member_has(doc, "score"), F.transform(members(doc), lambda m: entry(m["key"], m["value"], split=True, keyed=True))).otherwise(listed)

    @staticmethod
    def results(body, about):
        plain = about["keyed"]
        raw = number(text(body, "score"))
        return [
            result("WildBench v2", F.when(plain, py_round(raw, 2)), None, "wb_score", 1.0, 10.0, "GPT-4 judge score; scale 1-10"),
            result("WildBench v2 (adj)", F.when(plain & raw.isNotNull(), py_round(number(text(body, "adjusted_score")), 2)), None, "wb_score_adjusted", -100.0, 100.0),
            result("WildBench v2", F.when(~plain, number(either(body, ["wb_score", "score"]))), None, "wb_score", -100.0, 100.0, PAIRWISE),
        ]


@board("bigcodebench")
class _Code:
    @staticmethod
    def entries(row, _):
        return F.array(entry(F.trim(text(row, "model")), row, eval_date=F.coalesce(iso_date(F.trim(text(row, "date"))), F.lit("")), split=True))

    @staticmethod
    def results(row, _):
        return [result(f"BigCodeBench-{k.title()}", as_percentage(number(text(row, k))), 0, "pass@1", 0.0, 100.0) for k in ("complete", "instruct")]


def _zero_for(raw: Column) -> tuple[Column, Column]:
    """A score without which a record is still written, as 0, and whether it was absent or no number."""
    return F.coalesce(raw, F.lit(0.0)), raw.isNull()


@board("alpacaeval2", SCRAPED)
class _ScrapedAlpaca:
    """Rates are fractions, to four digits; without a length-controlled rate it is 0 and missing; a plain rate of 0 is left out."""

    entries = row_entries("name", "model", "model_name", "Model", "")

    @staticmethod
    def results(row, _):
        rate = lambda *keys: number(F.trim(F.replace(either(row, keys), F.lit("%")))) / 100
        lc, missing = _zero_for(rate("lc_win_rate", "lc_winrate", "LC WinRate", "lc_win_rate_se", "length_controlled_winrate"))
        plain = rate("win_rate", "winrate", "WinRate")
        return [result("AlpacaEval LC Win Rate", py_round(lc, 4), None, "win_rate", 0.0, 1.0, missing=missing), result("AlpacaEval Win Rate", F.when(plain > 0, py_round(plain, 4)), None, "win_rate", 0.0, 1.0)]


@board("bigcodebench", SCRAPED)
class _ScrapedCode:
    entries = row_entries("model", "Model", "name")

    @staticmethod
    def results(row, _):
        complete, instruct = number(text(row, "complete")), number(either(row, ["instruct", "instruct_score"]))
        plain = number(F.trim(F.replace(either(row, ["score", "Score", "pass@1"]), F.lit(","))))
        scores = {"BigCodeBench-Complete": complete, "BigCodeBench-Instruct": instruct, "BigCodeBench": F.when(complete.isNull() & instruct.isNull(), plain)}
        return [result(b, s, None, "pass@1", 0.0, 100.0) for b, s in scores.items()]


@board("chatbot_arena", SCRAPED)
class _ScrapedArena:
    entries = row_entries("model", "Model", "name")

    @staticmethod
    def results(row, _):
        elo, missing = _zero_for(number(F.trim(F.replace(either(row, ["elo", "Elo", "elo_rating", "Arena Elo rating"]), F.lit(",")))))
        return [result("Chatbot Arena Elo", elo, None, "elo", 0.0, 3000.0, missing=missing)]


@board("mt_bench", SCRAPED)
class _ScrapedJudged:
    entries = row_entries("model", "Model", "name")

    @staticmethod
    def results(row, _):
        score, missing = _zero_for(number(F.trim(either(row, ["score", "turn_avg", "average", "Score"]))))
        return [result("MT-Bench", score, None, "judge_score", 1.0, 10.0, missing=missing, details=details_of(dict(temperature=F.lit("0.7"))))]


@board("wildbench", SCRAPED)
class _ScrapedWild:
    entries = row_entries("model", "Model", "model_name")

    @staticmethod
    def results(row, _):
        keys = ("wb_score", "WB-Score", "score", "wb_score_adjusted", "wb_avg_score", "reward", "win_rate")
        return [result("WildBench-v2 WB-Score", F.coalesce(*(number(text(row, k)) for k in keys)), None, "wb_score", -100.0, 100.0)]


@board("hfopenllm_v2", SCRAPED)
class _ScrapedOpen:
    """evaluations: benchmark -> {name, value}; a null or absent value is 0 and missing, one above 1 a per cent. Names without a slash are refused."""

    @staticmethod
    def entries(row, _):
        name = text(at(row, "model"), "name")
        return F.array(entry(F.when(name.contains("/"), name), row))

    @staticmethod
    def results(row, _):
        def one(m):
            known = F.try_element_at(F.create_map(*(F.lit(x) for pair in OPEN_NAMES.items() for x in pair)), m["key"])
            raw = py_round(number(text(m["value"], "value")), 4)
            score, missing = _zero_for(F.when(raw > 1, py_round(raw / 100, 4)).otherwise(raw))
            return result(F.coalesce(text(m["value"], "name"), known, m["key"]), score, None, "accuracy", 0.0, 1.0, missing=missing)

        return F.transform(members(at(row, "evaluations")), one)


def results(documents: DataFrame, board: str, document: str, name: str, position: str, registry: dict[str, Board] | None = None) -> DataFrame:
    """Results of documents of several boards.

    board, document (VARIANT), name (of the file or submission) and position (a row's place in its table) are column names.
    Returns board, model, organization, eval_date and a RESULT's fields. Unknown boards, models without a name and null documents give no rows; repeated rows give repeated results but where a board merges.
    The expression of a row names all boards of the registry, so documents of one board are read faster with a registry of that board alone.
    """
    registry = BOARDS if registry is None else registry
    single = {k: b for k, b in registry.items() if not (b.merged or b.averaged)}
    parts = [_rows(documents, single, board, document, name, position)] if single else []
    parts += [_merged(_rows(documents, {k: b}, board, document, name, position)) for k, b in registry.items() if b.merged]
    parts += [_averaged(_rows(documents, {k: b}, board, document, name, position)) for k, b in registry.items() if b.averaged]
    columns = ["board", "model", "organization", "eval_date", *(F.col(f"r.{f}").alias(f) for f in ("benchmark", "score", "shots", "metric", "least", "most", "note", "reasoning", "missing", "details"))]
    return reduce(DataFrame.unionByName, (p.select(*columns) for p in parts))


def _rows(documents: DataFrame, boards: dict[str, Board], board: str, document: str, name: str, position: str) -> DataFrame:
    of = lambda make: reduce(lambda rest, k: F.when(F.col("board") == k, make(boards[k])).otherwise(rest), boards, F.lit(None))
    doc = documents.where(F.col(board).isin(*boards)).select(F.col(board).alias("board"), F.col(document).alias("doc"), F.col(name).alias("name"), F.col(position).alias("at"))
    entries = doc.select("board", "name", "at", F.explode(of(lambda b: b.entries(F.col("doc"), F.col("name"))).cast(f"array<{ENTRY}>")).alias("e")).where("e.model <> ''")

    def made(b):
        r = b.results(F.col("e.body"), F.struct("name", "e.keyed"))
        return (r if isinstance(r, Column) else F.array(*r)).cast(f"array<{RESULT}>")

    return entries.select("board", "at", "e.model", "e.organization", "e.eval_date", "e.body", F.explode(of(made)).alias("r")).where(F.col("r").isNotNull())


def _merged(rows: DataFrame) -> DataFrame:
    last = F.struct("r.rank", F.when(F.col("r.rank") > 1, F.col("at")).otherwise(-F.col("at")))
    keys = ["board", "model"]
    return rows.groupBy(*keys, F.col("r.benchmark").alias("b")).agg(F.max_by("r", last).alias("r"), F.first("organization").alias("organization"), F.first("eval_date").alias("eval_date"))


def _averaged(rows: DataFrame) -> DataFrame:
    """Sums by category first, so that a model of many judgements is a few rows."""
    sums = rows.groupBy("board", "model", F.col("r.details")["category"].alias("category")).agg(F.sum("r.score").alias("s"), F.count("*").alias("n"), F.any_value("r").alias("r"))
    known = F.when(F.col("category").isin(*CATEGORIES), F.struct(F.col("category").alias("key"), py_round(F.col("s") / F.col("n"), 2).cast("string").alias("value")))
    whole = sums.groupBy("board", "model").agg(py_round(F.sum("s") / F.sum("n"), 2).alias("score"), F.array_sort(F.collect_list(known)).alias("means"), F.any_value("r").alias("r"))
    details = F.when(F.size("means") > 0, F.map_from_entries("means"))
    return whole.select("board", "model", F.lit("").alias("organization"), F.lit("").alias("eval_date"), F.col("r").withField("score", F.col("score")).withField("details", details).alias("r"))


def live_rows(overall: DataFrame, live: DataFrame, row: str, position: str) -> DataFrame:
    """BFCL's two tables as one: the live accuracy joins the overall row of its model; of several live rows the last counts.

    row: the column of cells, VARIANT objects; position: the place in the table. Returns overall's columns, row with the live cell added where the model has one.
    """
    model = lambda r: F.trim(text(F.col(r), "Model"))
    last = live.where(model(row) != "").groupBy(model(row).alias("_model")).agg(F.max_by(text(F.col(row), "Live Overall Acc"), position).alias("_live"))
    cells = F.map_from_entries(F.filter(members(F.col(row)), lambda m: m["key"] != "Live Overall Acc"))
    added = F.to_variant_object(F.map_concat(cells, F.create_map(F.lit("Live Overall Acc"), at(F.to_variant_object(F.struct("_live")), "_live"))))
    joined = overall.withColumn("_model", model(row)).join(last, "_model", "left")
    return joined.withColumn(row, F.when(F.col("_live").isNotNull(), added).otherwise(F.col(row))).select(*overall.columns)


def scraped(rows: DataFrame, board: str, row: str, ids: dict[str, str] | None = None) -> DataFrame:
    """Scraped rows as records' columns: model, model_id, developer, platform and a RESULT's fields; missing tells a score of 0 that stands for none.

    ids: known names in lower case -> org/model, the caller's table. Rows without a model, or without any score on boards that ask for one, give nothing.
    """
    tables = rows.select(F.col(board).alias("board"), F.col(row).alias("doc"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("at"))
    made = _rows(tables, SCRAPED, "board", "doc", "name", "at").select("board", "model", "body", "r.*")
    body = F.col("body")
    runs_on = F.when(F.col("board") == "bigcodebench", either(body, ["inference_platform", "backend"])).when(F.col("board") == "wildbench", either(body, ["inference_platform", "api"]))
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in ids.items() for x in pair)), F.lower("model")) if ids else F.lit(None).cast("string")
    guessed = F.coalesce(F.when(F.col("board") != "alpacaeval2", F.nullif(either(body, ["developer", "organization"]), F.lit(""))), developer(F.col("model"), F.lit(None).cast("string")))
    model_id = F.when(F.col("model").contains("/"), F.col("model")).otherwise(F.coalesce(known, F.concat_ws("/", guessed, F.col("model"))))
    platform = F.when(F.col("board") == "hfopenllm_v2", "huggingface").otherwise(F.nullif(F.lower(F.trim(runs_on)), F.lit("")))
    return made.select("board", "model", model_id.alias("model_id"), F.substring_index(model_id, "/", 1).alias("developer"), platform.alias("platform"), "benchmark", "score", "least", "most", "missing", "details")

