"""Coverage, composition and audit counts (G01-G13, G24-G30, G33-G40). Shares are unrounded; the report layer rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(yes: Column) -> Column:
    return F.coalesce(F.avg(yes.cast("double")) * 100, F.lit(0.0))


def coverage(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """N and the per cent of rows with a value in each field; 0.0 without rows."""
    return rows.agg(F.count("*").alias("n"), *(_share(c).alias(k) for k, c in fields.items()))


def coverage_by(rows: DataFrame, by: str, fields: dict[str, Column], listed: DataFrame | None = None) -> DataFrame:
    """Coverage by a column in one pass; groups of `listed` (column `by`) without rows get n 0."""
    out = rows.groupBy(by).agg(F.count("*").alias("n"), *(_share(c).alias(k) for k, c in fields.items()))
    return out if listed is None else listed.select(by).distinct().join(out, by, "left").na.fill(0).select(out.columns)


def composition(rows: DataFrame, by: str, entities: dict[str, str]) -> DataFrame:
    """Rows and distinct entities by a column, and in total (by is null there; zeros without rows).

    Rows first become one count a group and value of each entity, which are then counted by group and, once more made distinct, in total: two copies of a row for two entities, where distinct counts in a rollup make six.
    """
    if not entities:
        return rows.rollup(by).agg(F.count("*").alias("n"))
    keys = [f"_{i}" for i in range(len(entities))]
    named = rows.select(F.col(by).alias("_by"), *(F.col(c).alias(k) for k, c in zip(keys, entities.values(), strict=True)))
    pairs = named.groupingSets([[F.col("_by"), F.col(k)] for k in keys], F.col("_by"), *(F.col(k) for k in keys)).agg(*(F.grouping(k).alias(f"_not{k}") for k in keys), F.count("*").alias("_n"))
    values = pairs.groupBy(*keys, *(f"_not{k}" for k in keys)).agg(F.sum("_n").alias("_n"))
    sums = [F.coalesce(F.sum(F.when(F.col("_not_0") == 0, F.col("_n"))), F.lit(0)).alias("n"), *(F.count_if((F.col(f"_not{k}") == 0) & F.col(k).isNotNull()).alias(e) for k, e in zip(keys, entities, strict=True))]
    total = values.agg(*sums).select(F.lit(None).cast(named.schema["_by"].dataType).alias(by), "n", *entities)
    return pairs.groupBy(F.col("_by").alias(by)).agg(*sums).unionByName(total)


def field_counts(rows: DataFrame, by: str, fields: dict[str, Column]) -> DataFrame:
    """Total and rows with a value, by a column."""
    return rows.groupBy(by).agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in fields.items()))


def audit(rows: DataFrame, source: str, fields: dict[str, Column]) -> DataFrame:
    """Per cent of each field by source, largest source first."""
    return coverage_by(rows, source, fields).orderBy(F.desc("n"), source)


def fill_and_distinct(rows: DataFrame, entities: dict[str, str], fields: dict[str, Column]) -> DataFrame:
    """Distinct entities and shares of filled fields, one row."""
    return rows.agg(*(F.count_distinct(c).alias(k) for k, c in entities.items()), *(_share(c).alias(k) for k, c in fields.items()))


def non_null_share(rows: DataFrame, score: str) -> DataFrame:
    """G10."""
    return rows.agg(_share(F.col(score).isNotNull()).alias("non_null"))


def score_audit(rows: DataFrame, kind: Column, correct: Column, by: str | None = None) -> DataFrame:
    """Precision of score rows and recall (captured against missed), a missing kind being a score row."""
    kind = F.coalesce(kind, F.lit("score"))
    n_score, right, missed = F.count_if(kind == "score"), F.count_if((kind == "score") & correct), F.count_if((kind == "recall") & ~correct)
    captured = F.count_if((kind == "recall") & correct)
    return (rows.groupBy(by) if by else rows.groupBy()).agg(
        n_score.alias("scores"), right.alias("correct"), captured.alias("captured"), missed.alias("missed"), F.try_divide(right.cast("double") * 100, n_score).alias("precision"), F.try_divide(captured.cast("double") * 100, captured + missed).alias("recall")
    )


def confusion(rows: DataFrame, attributable: Column, named: Column, correct: Column) -> DataFrame:
    """Attributable values, those named right, missed, named wrong, and rightly left out."""
    return rows.agg(
        F.count_if(attributable).alias("attributable"), F.count_if(attributable & named & correct).alias("correct"), F.count_if(attributable & ~named).alias("missed"),
        F.count_if(named & ~correct).alias("wrong"), F.count_if(~attributable & ~named).alias("abstained"),
    )


def grouped_audit(rows: DataFrame, correct: Column, field: str, paper: str) -> DataFrame:
    """Overall, by field and by paper in one pass (grouping sets)."""
    return rows.groupingSets([[], [F.col(field)], [F.col(paper)]], F.col(field), F.col(paper)).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if(correct).alias("correct"))


def histogram_top(rows: DataFrame, by: str, value: str, k: int = 5) -> DataFrame:
    """The k most frequent values of each group, ties by value."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), F.asc_nulls_first(value)))).where(F.col("rank") <= k)


def ranges(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """Least, most, mean and number of scores."""
    return rows.groupBy(*by).agg(F.min(score).alias("least"), F.max(score).alias("most"), F.avg(score).alias("mean"), F.count(score).alias("n"))


def empty_columns(rows: DataFrame) -> DataFrame:
    """For each column whether every row leaves it blank, long form; one pass."""
    flags = rows.agg(*(F.coalesce(~F.bool_or(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""), F.lit(True)).alias(c) for c in rows.columns))
    return flags.unpivot([], flags.columns, "name", "is_empty")


def day_spans(rows: DataFrame, source: str, day: Column) -> DataFrame:
    """First and last day of each source, and the sources that share a span."""
    spans = rows.groupBy(source).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return spans.groupBy("first_day", "last_day").agg(F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"), F.count("*").alias("n"))


def cross_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by columns."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def mean_or_ratio(mean: Column, total: Column, count: Column) -> Column:
    """The mean, or sum by count if it is absent or 0, or 0."""
    return F.coalesce(F.nullif(mean, F.lit(0.0)), F.try_divide(total, F.nullif(count, F.lit(0))), F.lit(0.0))


def counts_with_papers(rows: DataFrame, benchmark: str, paper: str) -> DataFrame:
    """Rows and distinct papers by benchmark, most rows first."""
    return rows.groupBy(benchmark).agg(F.count("*").alias("n"), F.count_distinct(paper).alias("papers")).orderBy(F.desc("n"), benchmark)


def resolved_share(resolved: Column, total: int = 500) -> Column:
    """G34."""
    return F.size(resolved) / F.lit(float(total))


def instance_rollup(rows: DataFrame, evaluation: str, score: Column) -> DataFrame:
    """Mean of instance scores by evaluation."""
    return rows.groupBy(evaluation).agg(F.avg(score).alias("score"), F.count("*").alias("n"))


def token_usage(rows: DataFrame, key: str, prompt: Column, completion: Column, output: Column) -> DataFrame:
    """Tokens summed with 0 for absent ones; reasoning is completion less output, null if 0."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return rows.groupBy(key).agg(total(prompt).alias("prompt"), total(completion).alias("completion"), F.nullif(total(completion) - total(output), F.lit(0).cast("long")).alias("reasoning"))


def model_ids(rows: DataFrame, model: str, source: str, but: str) -> DataFrame:
    """Distinct ids with a slash, without unknown/unknown and without one source, sorted."""
    return rows.where(F.col(model).contains("/") & (F.col(model) != "unknown/unknown") & (F.col(source) != but)).select(model).distinct().orderBy(model)


def any_of(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, flags)
