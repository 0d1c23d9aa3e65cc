"""Summaries of controlled experiments and lookups in tables of scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import relations, stats


def level_means(rows: DataFrame, factors: list[str], value: str) -> DataFrame:
    """Number and mean of the values at each level of each factor; rows are read once, as one row a factor."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors))).alias("x"), F.col(value).alias("v"))
    return long.groupBy("x.factor", "x.level").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


def largest_delta(rows: DataFrame, key: list[str], version: str, a: str, b: str, value: str, by: list[str]) -> DataFrame:
    """The largest absolute difference between two versions, and how many keys both have, for each group of keys."""
    return relations.paired_delta(rows, key, version, a, b, value).groupBy(*by).agg(F.count("*").alias("n"), F.max(F.abs("delta")).alias("largest"))


def version_report(rows: DataFrame, version: str, value: str, by: list[str]) -> DataFrame:
    """Number, mean and standard deviation (0 of a single value) of each version."""
    return rows.groupBy(*by, version).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value)).alias("sd"))


def eta_of_cells(rows: DataFrame, task: str, group: str, cell: list[str], value: str) -> DataFrame:
    """Means of cells first, then the share of their variation between groups, task by task; 0 if nothing varies, null with one group."""
    cells = rows.groupBy(task, group, *cell).agg(F.avg(value).alias("x"))
    per = cells.groupBy(task, group).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("s"))
    whole = Window.partitionBy(task)
    grand = F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole)
    parts = per.withColumn("b", F.col("n") * F.pow(F.col("m") - grand, F.lit(2))).groupBy(task).agg(F.sum("b").alias("b"), F.sum(F.col("n") * F.col("s")).alias("w"), F.count("*").alias("k"), F.sum("n").alias("cells"))
    eta = F.when(F.col("k") < 2, None).when(F.col("b") + F.col("w") == 0, 0.0).otherwise(F.col("b") / (F.col("b") + F.col("w")))
    return parts.select(task, F.col("k").alias("groups"), "cells", eta.alias("eta2"))


def macro_mean(rows: DataFrame, run: str, part: str, value: str) -> DataFrame:
    """Each run's mean over the parts that every run has, each part counting once."""
    per = rows.groupBy(run, part).agg(F.avg(value).alias("x"))
    runs = rows.agg(F.count_distinct(run).alias("runs"))
    shared = per.groupBy(part).agg(F.count("*").alias("have")).join(F.broadcast(runs), F.col("have") == F.col("runs")).select(part)  # runs is one row
    return per.join(shared, part, "left_semi").groupBy(run).agg(F.count("*").alias("parts"), F.avg("x").alias("macro"))


def gap_parts(a: Column, a_shared: Column, c: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """The gap b - a as the sum of restricting the parts, changing the protocol and the rest, whether they add up, and which is largest."""
    steps = {"restriction": a_shared - a, "protocol": c - a_shared, "remainder": b - c}
    total = reduce(lambda x, y: x + y, steps.values())
    most = F.greatest(*map(F.abs, steps.values()))
    label = F.when(most <= tolerance, "none")
    for name, step in steps.items():
        label = label.when(F.abs(step) == most, name)
    return F.struct(*(s.alias(n) for n, s in steps.items()), (b - a).alias("gap"), (F.abs(total - (b - a)) <= tolerance).alias("adds_up"), label.alias("outcome"))


def quoted(raw: Column, shown: Column) -> Column:
    """OK if a quoted percentage is the raw share rounded to two digits, else DIFFERS; MISSING without a raw share."""
    return F.when(raw.isNull(), "MISSING").when(F.abs(F.round(raw * 100, 2) - shown) < 1e-9, "OK").otherwise("DIFFERS")


def gate(found: DataFrame, published: DataFrame, key: str, tolerance: float = 0.1) -> DataFrame:
    """Recomputed beside published values, and whether they are within the tolerance; absent ones fail."""
    both = published.join(found, key, "left")
    return both.withColumn("passes", F.coalesce(F.abs(F.col("found") - F.col("published")) <= tolerance, F.lit(False)))


def spread_and_pooled(rows: DataFrame, entity: str, group: str, value: str, without: str) -> tuple[DataFrame, DataFrame]:
    """Largest less least group mean of each entity, and a one-way analysis over all entities but one."""
    means = rows.groupBy(entity, group).agg(F.avg(value).alias("m"))
    return means.groupBy(entity).agg((F.max("m") - F.min("m")).alias("spread")), stats.one_way(rows.where(F.col(entity) != without), group, value)


def settled(explicit: Column, *readings: Column) -> Column:
    """P10: what a record says itself, else what its texts say, in the order given."""
    return F.coalesce(explicit, *readings)


def filled(rows: DataFrame, about: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Gaps (null or empty) of a row filled from what is known of its data set, row by row: nothing leaks into other rows."""
    known = relations.last_values(about, [key], fields[0], fields).select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    gap = lambda f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_{f}"))
    return rows.join(known, key, "left").withColumns({f: gap(f) for f in fields}).drop(*(f"_{f}" for f in fields))


def matching(rows: DataFrame, patterns: dict[str, str], source: str | None = None) -> DataFrame:
    """Rows whose columns, in lower case, match patterns; of one source if it is given."""
    hit = reduce(lambda a, b: a & b, (F.lower(c).rlike(p) for c, p in patterns.items()))
    return rows.where(hit if source is None else hit & (F.col("source") == source))


def in_range(rows: DataFrame, key: str, value: str, low: float, high: float, order: str) -> DataFrame:
    """Of each key the distinct values in a range, the largest, and the first row's."""
    return rows.where(F.col(value).between(low, high)).groupBy(key).agg(F.count_distinct(value).alias("n"), F.max(value).alias("largest"), F.min_by(value, order).alias("first"))


def first_with(rows: DataFrame, key: str, column: str, token: str, order: str, values: list[str]) -> DataFrame:
    """The first row of each key whose column contains a token."""
    return relations.first_values(rows.where(F.contains(F.lower(column), F.lit(token.lower()))), [key], order, values)


def newest(rows: DataFrame, key: list[str], order: list[Column], k: int = 3) -> DataFrame:
    """The k newest rows of each key, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= k)


def some(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in an order; sorted by partition first, so that only limit rows a task meet."""
    return rows.orderBy(*order).limit(limit)


def conflict_pairs(pairs: DataFrame, sources: tuple[str, str], scores: tuple[str, str], row: str) -> DataFrame:
    """One row of each pair of {source: score}, whatever the sides and cells it was found in; the least row stands for it."""
    sides = [F.struct(F.col(s).alias("source"), F.col(v).alias("score")) for s, v in zip(sources, scores, strict=True)]
    return pairs.groupBy(F.least(*sides).alias("a"), F.greatest(*sides).alias("b")).agg(F.count("*").alias("n"), F.min(row).alias("row"))


def metadata_coverage(rows: DataFrame, fields: dict[str, Column], harness: Column) -> DataFrame:
    """Filled, total and share of each field, and of the harness being known (not null, empty or "unknown"); one pass."""
    checks = fields | {"harness": harness.isNotNull() & ~F.lower(F.trim(harness)).isin("", "unknown")}
    counts = rows.agg(F.count("*").alias("total"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    lines = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("filled"), "total") for n in checks)))
    return counts.select(lines.alias("x")).select("x.*", F.try_divide(F.col("x.filled"), F.col("x.total")).alias("share"))
