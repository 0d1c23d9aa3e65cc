"""Whether a text bears out what a record says: numbers by an index of the texts' numbers, names by a cascade of looser spellings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.textmeta import value_in_text
from tallyloom.operators.schema import let

#: A number as texts write it: with thousands commas, or digits with or without a fraction.
NUMBER = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?\b|[0-9]+(?:\.[0-9]+)?"
# How texts call a metric.
METRIC_ALIASES = {
    "accuracy": ["acc", "accuracy", "acc."], "exact_match": ["em", "exact match", "exact-match", "exactmatch"], "pass@1": ["pass@1", "pass @1"], "pass@10": ["pass@10", "pass @10"], "pass@100": ["pass@100", "pass @100"],
    "bleu": ["bleu", "bleu-4", "b@4"], "rouge": ["rouge", "rouge-l", "rougel"], "f1": ["f1", "f1-score", "f1 score"], "win_rate": ["win rate", "win_rate", "winrate"],
    "normalized_accuracy": ["acc_norm", "norm_acc", "normalized accuracy", "acc (norm)"], "average_score": ["avg", "average", "mean"], "meteor": ["meteor"], "cider": ["cider"], "ndcg@10": ["ndcg@10", "ndcg"], "miou": ["miou"], "map": ["map"],
}


#: Numbers in a piece of the index.
PIECE = 256


def number_index(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """The index: one row (text_id, pieces) a text id, its distinct numbers without commas, sorted and cut into pieces of at most PIECE. A text is read once, whatever the number of values."""
    tokens = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(NUMBER), 0), lambda x: F.replace(x, F.lit(","), F.lit(""))))
    one = texts.select(text_id, tokens.alias("_tokens")).groupBy(text_id).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_tokens")))).alias("_all"))  # the texts of an id
    starts = F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / PIECE).cast("int"))
    return one.where(F.size("_all") > 0).select(text_id, F.transform(starts, lambda i: F.slice("_all", i * PIECE + 1, F.lit(PIECE))).alias("pieces"))


def number_forms(value: Column) -> Column:
    """how a text may write a number, given as a record writes it.

    As it is (without sign and commas); the integer, if it is whole; with up to two zeros more; over a hundred with 2 to
    4 digits, where it is in (0, 100]; times a hundred with 0 to 2 digits, where it is in (0, 1). Never fewer digits than
    written. Null for anything that is no number.
    """
    negative = F.startswith(F.trim(value.cast("string")), F.lit("-"))

    def of(bare: Column, number: Column) -> Column:
        point = F.when(F.contains(bare, F.lit(".")), F.lit("")).otherwise(F.lit("."))
        scaled = lambda factor, digits: (number * F.lit(factor).cast("decimal(5,2)")).cast(f"decimal(30,{digits})").cast("string")
        positive = ~negative & (number > 0)
        forms = [
            bare, F.when(number == F.floor(number), number.cast("decimal(30,0)").cast("string")), *(F.concat(bare, point, F.lit("0" * k)) for k in (1, 2)),
            *(F.when(positive & (number <= 100), scaled("0.01", d)) for d in (2, 3, 4)), *(F.when(positive & (number < 1), scaled("100", d)) for d in (0, 1, 2)),
        ]
        return F.when(number.isNotNull(), F.array_distinct(F.array_compact(F.array(*forms))))

    parsed = lambda bare: F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)?$"), bare.try_cast("decimal(30,10)"))
    return let(F.regexp_replace(F.trim(value.cast("string")), r"^[+-]|,", ""), lambda bare: let(parsed(bare), lambda number: of(bare, number)))


def number_evidence(values: DataFrame, key: list[str], text_id: str, value: str, texts: DataFrame, text: str) -> DataFrame:
    """Values with `found`: whether their text has one of a value's forms. Null values need no evidence; others that are no numbers have none.

    Values meet their text's numbers in one join by text: what is shuffled are values and numbers, not forms, and nothing where both are dealt by text already.
    Forms are sought only in the pieces between whose ends they lie. The numbers of one text are a row, as the text is.
    """
    index = number_index(texts, text_id, text).withColumnsRenamed({text_id: "_of", "pieces": "_pieces"})
    within = lambda forms, piece: F.filter(forms, lambda f: (f >= piece[0]) & (f <= F.element_at(piece, -1)))
    hit = let(number_forms(F.col(value)), lambda forms: F.exists("_pieces", lambda piece: F.arrays_overlap(within(forms, piece), piece)))
    joined = values.join(index, F.col(text_id) == F.col("_of"), "left")
    return joined.withColumn("found", F.col(value).isNull() | F.coalesce(hit, F.lit(False))).drop("_of", "_pieces")


def evidence_summary(judged: DataFrame, by: list[str]) -> DataFrame:
    """G11 from texts: values, those borne out, and their share in per cent (precision), by kind of value."""
    return judged.groupBy(*by).agg(F.count("*").alias("scores"), F.count_if("found").alias("correct"), (F.count_if("found") * 100.0 / F.count("*")).alias("precision"))


def name_in_text(value: Column, text: Column) -> Column:
    """F40 for names: value_in_text; a metric's other names; any part between commas; base and tag of "base (tag)", or the base alone with - and _ as blanks; a model name without its size."""
    body = F.lower(text)
    spaced = lambda c: F.regexp_replace(c, "[-_]", " ")
    known: dict[str, list[str]] = {}
    for name, others in METRIC_ALIASES.items():
        for alias in (name, *others):
            known[alias] = [name, *others]

    def as_metric(name: Column) -> Column:
        forms = F.coalesce(*(F.when(F.lower(F.trim(name)).isin(*[a for a, f in known.items() if f == forms]), F.array(*map(F.lit, forms))) for forms in {tuple(f): f for f in known.values()}.values()))
        return F.coalesce(F.exists(forms, lambda x: F.contains(body, x)), F.lit(False))

    def loose(name: Column) -> Column:
        low = F.lower(F.trim(name))
        base, tag = (F.trim(F.regexp_extract(low, r"^(.+?)\s*\((.+?)\)$", g)) for g in (1, 2))
        tagged = (base != "") & ((F.contains(body, base) & F.contains(body, tag)) | F.contains(spaced(body), spaced(base)))
        unsized = F.trim(F.regexp_replace(low, r"\s*[-_]?[0-9]+\.?[0-9]*[bm]$", ""))
        sized = (unsized != "") & (unsized != low) & (F.contains(body, unsized) | F.contains(spaced(body), spaced(unsized)))
        return value_in_text(name, text) | as_metric(name) | tagged | sized

    parts = F.filter(F.split(value, ","), lambda p: F.trim(p) != "")
    return F.coalesce(loose(value) | (F.contains(value, F.lit(",")) & F.exists(parts, loose)), F.lit(True))


def record_evidence(values: DataFrame, key: list[str], text_id: str, name: str, value: str, numeric: Column, texts: DataFrame, text: str) -> DataFrame:
    """One row a record (key) with `validated` and `incorrect`, the values without evidence as "name: value", in order.

    values has a row for each value of a record; numeric says which are numbers. Names are looked up in their text after a
    join by text, numbers through the index.
    """
    tagged = values.withColumn("_numeric", numeric)
    numbers = number_evidence(tagged.where("_numeric"), [*key, name], text_id, value, texts, text)
    names = tagged.where("NOT _numeric").join(texts.select(text_id, F.col(text).alias("_text")), text_id, "left").withColumn("found", name_in_text(F.col(value), F.coalesce("_text", F.lit("")))).drop("_text")
    wrong = F.when(~F.col("found"), F.concat_ws(": ", F.col(name), F.col(value)))
    every = reduce(DataFrame.unionByName, [numbers, names])
    return every.groupBy(*key).agg(F.array_sort(F.array_compact(F.collect_list(wrong))).alias("incorrect")).withColumn("validated", F.size("incorrect") == 0)
