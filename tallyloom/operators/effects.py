"""How much a setting moves a score: spreads within cells, differences between levels, means by category (G15-G19, G21, G23, G36), and lookups of names by what they contain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import relations
from tallyloom.operators.quantiles import beside, exact_median, held
from tallyloom.operators.stats import py_round


def spreads(rows: DataFrame, cell: list[str], value: str, least: int = 1) -> DataFrame:
    """Greatest less least value of each cell, and its number of values; cells with fewer than `least` are left out."""
    found = rows.groupBy(*cell).agg((F.max(value) - F.min(value)).alias("spread"), F.count(value).alias("values"))
    return found.where(F.col("values") >= least)


def spread_summary(rows: DataFrame, cell: list[str], by: list[str], value: str, least: int = 1, median: bool = False) -> DataFrame:
    """Number, mean and greatest of the cells' spreads, and their exact median if asked for."""
    found = spreads(rows, cell, value, least)
    given = held(found) if median else found
    summed = given.groupBy(*by).agg(F.count("*").alias("n"), F.avg("spread").alias("mean"), F.max("spread").alias("most"))
    return beside(summed, exact_median(given, by, "spread"), by) if median else summed


def mismatch(rows: DataFrame, others: list[str], factor: str, order: str, value: str, a, b, by: list[str]) -> DataFrame:
    """Mean absolute difference between levels a and b of a factor where all other factors agree, and the number of pairs. The last row of a cell counts."""
    last = relations.last_values(rows.where(F.col(factor).isin(a, b)), [*others, factor], order, [value])
    return relations.paired_delta(last, others, factor, a, b, value).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs("delta")).alias("mean"))


def mismatch_any(rows: DataFrame, others: list[str], factor: str, order: str, value: str, by: list[str]) -> DataFrame:
    """G18 over all pairs of levels, without making the pairs: sorted values x1..xk differ by the sum of (2i - k - 1) xi in all.

    A group holds one value a level, so it is as large as the factor has levels.
    """
    last = relations.last_values(rows.where(F.col(value).isNotNull()), [*others, factor], order, [value])
    k = F.size("x")
    signed = F.transform("x", lambda x, i: x * (2 * i + 1 - k))
    cells = last.groupBy(*others).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("x")).where(k > 1)
    sums = cells.select(*by, (k * (k - 1) / 2).cast("long").alias("pairs"), F.aggregate(signed, F.lit(0.0), lambda s, x: s + x).alias("apart"))
    return sums.groupBy(*by).agg(F.sum("pairs").alias("n"), (F.sum("apart") / F.sum("pairs")).alias("mean"))


def mode_gap(rows: DataFrame, entity: str, mode: str, a: str, b: str, value: str, order: str) -> DataFrame:
    """Entities with both modes, and the greatest absolute difference of their values rounded to two digits; the last row of a mode counts."""
    last = relations.last_values(rows.where(F.col(mode).isin(a, b)), [entity, mode], order, [value])
    return relations.paired_delta(last.withColumn(value, py_round(F.col(value), 2)), [entity], mode, a, b, value).agg(F.count("*").alias("n"), F.max(F.abs("delta")).alias("gap"))


def judge_spread(rows: DataFrame, judge: str, by: list[str], value: str) -> DataFrame:
    """How many judges rated a group, and greatest less least of their means; `by` may name a category too."""
    means = rows.groupBy(*by, judge).agg(F.avg(value).alias("m"))
    return means.groupBy(*by).agg(F.count("*").alias("judges"), (F.max("m") - F.min("m")).alias("spread"))


def category_means(rows: DataFrame, entity: str, category: str, categories: dict[str, str], value: str) -> DataFrame:
    """An entity's mean over all its rows and over those of each category, named by `categories`."""
    return rows.groupBy(entity).agg(F.avg(value).alias("overall"), *(F.avg(F.when(F.col(category) == k, F.col(value))).alias(name) for k, name in categories.items()))


def longest_within(rows: DataFrame, name: str, table: DataFrame, pattern: str, value: str, anywhere: bool = False) -> DataFrame:
    """Beside each row the value of the longest pattern that starts its name or a part of it after - or / (anywhere: that it contains).

    Case does not count; equal patterns give the least value, names without one null, null names and empty patterns match
    nothing. Substrings of the patterns' lengths meet the patterns in an equi-join, so names and patterns are never compared in pairs.
    """
    known = table.where(F.length(pattern) > 0).groupBy(F.lower(pattern).alias("_p")).agg(F.min(value).alias("_v"))
    lengths = [r[0] for r in known.select(F.length("_p")).distinct().collect()]  # at most as many as a name has characters
    names = rows.select(F.lower(name).alias("_l")).where(F.length("_l") > 0).distinct()
    starts = F.sequence(F.lit(1), F.length("_l"))
    if not anywhere:
        starts = F.filter(starts, lambda at: (at == 1) | F.substr("_l", F.greatest(at - 1, F.lit(1)), F.lit(1)).isin("-", "/"))
    size = F.array(*map(F.lit, sorted(lengths))) if lengths else F.array().cast("array<int>")
    pieces = names.select("_l", F.explode(starts).alias("_at")).select("_l", "_at", F.explode(size).alias("_n")).where(F.col("_at") + F.col("_n") - 1 <= F.length("_l"))
    found = pieces.select("_l", F.substr("_l", F.col("_at"), F.col("_n")).alias("_p")).distinct().join(known, "_p")
    best = found.groupBy("_l").agg(F.min_by("_v", F.struct(-F.length("_p"), "_p")).alias(value))
    return rows.withColumn("_l", F.lower(name)).join(best, "_l", "left").drop("_l")


def named_in(flags: DataFrame, deltas: DataFrame, name: str, other: str, value: str) -> DataFrame:
    """Beside flagged names the value of the longest other name that they contain, else of the one that contains them (the least such)."""
    inside = longest_within(flags, name, deltas.select(F.col(other).alias("_q"), F.col(value)), "_q", value, anywhere=True)
    around = longest_within(deltas.select(other, F.col(value).alias("_w")), other, flags.select(F.col(name).alias("_q"), F.lower(name).alias("_f")).distinct(), "_q", "_f", anywhere=True)
    around = around.where("_f IS NOT NULL").groupBy("_f").agg(F.min("_w").alias("_w"))
    return inside.join(around, F.lower(name) == F.col("_f"), "left").withColumn(value, F.coalesce(F.col(value), F.col("_w"))).drop("_f", "_w")

