"""Scores of one model on one benchmark from several sources: how many disagree, by how much, and who."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.quantiles import beside, exact_median, held

from tallyloom.functions.normalize import severity, to_fraction


def cells(rows: DataFrame, key: list[str], source: str, score: str, harness_missing: Column, scoring_missing: Column) -> DataFrame:
    """One row a cell: distinct sources, spread of scores (null with fewer than two), whether any record omits a field. NaN scores are dropped."""
    value = F.when(~F.isnan(score), F.col(score))
    return rows.groupBy(*key).agg(
        F.count_distinct(source).alias("sources"), F.when(F.count(value) >= 2, F.max(value) - F.min(value)).alias("spread"),
        F.coalesce(F.bool_or(harness_missing), F.lit(False)).alias("no_harness"), F.coalesce(F.bool_or(scoring_missing), F.lit(False)).alias("no_scoring"),
    )


def prevalence(cell: DataFrame, small: float = 1.0, large: float = 5.0) -> DataFrame:
    """Pairs, collisions, those that differ by more than small and large, and those that differ with a field missing."""
    multi = F.col("sources") >= 2
    differ = multi & F.coalesce(F.col("spread") > small, F.lit(False))
    return cell.agg(
        F.count("*").alias("pairs"), F.count_if(multi).alias("collisions"), F.count_if(differ).alias("differ_small"), F.count_if(differ & (F.col("spread") > large)).alias("differ_large"),
        F.count_if(differ & F.col("no_harness")).alias("harness_missing"), F.count_if(differ & F.col("no_scoring")).alias("scoring_missing"),
    )


def reference_gaps(rows: DataFrame, key: list[str], source: str, score: str, reference: str, order: str) -> DataFrame:
    """For each cell that the reference and others have, the median of the others less the reference's first score."""
    own, value = F.col(source) == reference, F.col(score)
    usable = rows.where(value.isNotNull() & ~F.isnan(value))
    found = usable.groupBy(*key).agg(F.min_by(F.when(own, value), F.when(own, F.col(order))).alias("own"), F.median(F.when(~own, value)).alias("others"))
    return found.where("own IS NOT NULL AND others IS NOT NULL").select(*key, (F.col("others") - F.col("own")).alias("gap"))


def gap_groups(gaps: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """gap_summary of each group of least gaps or more, the largest groups first."""
    return gap_summary(gaps, by).where(F.col("n") >= least).orderBy(F.desc("n"), *by)


def gap_summary(gaps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number, positive ones and median of the gaps."""
    given = held(gaps.select(*(by or []), "gap"))
    counts = given.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(F.col("gap") > 0).alias("positive"))
    return beside(counts, exact_median(given, by or [], "gap"), by or [])


def conflicts(rows: DataFrame, key: list[str], row: str, source: str, score: str, least: Column, most: Column) -> DataFrame:
    """Pairs of records of one cell from different sources, each pair once, with difference and severity.

    Copies of a score within a source say nothing new, so one record (the least row) stands for them: this keeps the
    pairs of a busy cell down to distinct scores. The join is one shuffle on the key with the rest as a residual
    condition, which adaptive execution can split.
    """
    one = rows.where(F.col(score).isNotNull()).groupBy(*key, source, score).agg(F.min(F.struct(F.col(row).alias("row"), least.alias("least"), most.alias("most"))).alias("_r")).select(*key, source, score, "_r.*")
    a = one.select(*key, *(F.col(c).alias(f"{c}_a") for c in (source, score, "row", "least", "most")))
    b = one.select(*(F.col(c).alias(f"_{c}") for c in key), *(F.col(c).alias(f"{c}_b") for c in (source, score, "row", "least", "most")))
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    pairs = a.join(b, [*same, F.col("row_a") < F.col("row_b"), F.col(f"{source}_a") != F.col(f"{source}_b")])
    gap = F.abs(to_fraction(F.col(f"{score}_a"), F.col("least_a"), F.col("most_a")) - to_fraction(F.col(f"{score}_b"), F.col("least_b"), F.col("most_b")))
    return pairs.select(*key, "row_a", "row_b", f"{source}_a", f"{source}_b", f"{score}_a", f"{score}_b", gap.alias("relative_diff"), severity(gap).alias("severity"))


def worst(found: DataFrame, k: int = 10) -> DataFrame:
    """The k gravest conflicts, by severity and difference, ties by rows."""
    rank = F.array_position(F.array(*map(F.lit, ("exact", "rounding", "minor", "significant", "major"))), F.col("severity"))
    return found.orderBy(F.desc(rank), F.desc("relative_diff"), "row_a", "row_b").limit(k)
