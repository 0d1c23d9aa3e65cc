"""Exact quantiles by refining histograms: no task holds more than a histogram, however many values a group has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.shared import shared_folder

#: Bins of a histogram; each round divides the range of a wanted value by so much.
BINS = 4096


def held(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the cluster names in spark.checkpoint.dir; only where it is unset, and on one machine, in one of our own."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """By and one column a share (name to share in 0..1), interpolated between the two values around share * (n - 1).

    Nulls and NaN take no part; a group of nothing else has no row, and without `by` neither has an empty table. Each round counts, for every wanted
    rank, the values in equal bins between the bounds known so far and keeps the bin that holds the rank, with its least
    and greatest value as the new bounds; it ends when these meet. Only counts are shuffled. Rounds are few (two or three
    for most data, a dozen at worst), and each reads the values once more.
    """
    at = [f"_by{i}" for i in range(len(by))]
    usable = rows.select(*(F.col(c).alias(a) for c, a in zip(by, at, strict=True)), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    position = lambda share: F.lit(float(share)) * (F.col("_n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(position(s)), F.ceil(position(s))) for s in shares.values()))))
    sizes = usable.groupBy(*at).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0")
    wanted = held(sizes.select(*at, "_n", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.explode(ranks).alias("_r")))
    while not (open_ := wanted.where("_lo < _hi")).isEmpty():
        met = [F.col(a).eqNullSafe(F.col(f"{a}w")) for a in at]
        bounds = open_.select(*(F.col(a).alias(f"{a}w") for a in at), "_lo", "_hi", "_before", "_r")
        inside = usable.join(bounds, met, "inner") if at else usable.crossJoin(F.broadcast(bounds))  # without groups, two rows a share
        half = lambda c: F.col(c) / 2  # noqa: E731  so that the widest range is finite
        bin_ = F.least(F.floor((half("_v") - half("_lo")) / (half("_hi") - half("_lo")) * bins), F.lit(bins - 1))
        counted = inside.where("_v BETWEEN _lo AND _hi").groupBy(*at, "_r", "_before", bin_.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(*at, "_r").orderBy("_bin"))  # a histogram
        chosen = counted.withColumn("_upto", F.col("_before") + upto).where((F.col("_upto") > F.col("_r")) & (F.col("_upto") - F.col("_c") <= F.col("_r")))
        refined = chosen.select(*at, "_r", "_lo", "_hi", (F.col("_upto") - F.col("_c")).alias("_before"))
        sized = open_.select(*(F.col(a).alias(f"{a}w") for a in at), F.col("_r").alias("_rw"), "_n")
        back = refined.join(sized, [*met, F.col("_r") == F.col("_rw")]).select(*at, "_n", "_lo", "_hi", "_before", "_r")
        wanted = held(wanted.where("_lo >= _hi").unionByName(back))
    values = wanted.groupBy(*at, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_lo"))).alias("_m"))  # two ranks a share at most

    def between(share: float):
        low, high = F.col("_m")[F.floor(position(share))], F.col("_m")[F.ceil(position(share))]
        return low + (high - low) * (position(share) - F.floor(position(share)))

    return values.select(*(F.col(a).alias(c) for a, c in zip(at, by, strict=True)), *(between(s).alias(name) for name, s in shares.items()))


def exact_median(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(rows, by, value, {name: 0.5})


def beside(summary: DataFrame, quantiles: DataFrame, by: list[str]) -> DataFrame:
    """A summary with the quantiles of its groups, null where a group has no values; null groups meet."""
    named = quantiles.select(*(F.col(c).alias(f"_q{i}") for i, c in enumerate(by)), *(c for c in quantiles.columns if c not in by))
    met = [F.col(c).eqNullSafe(F.col(f"_q{i}")) for i, c in enumerate(by)] or F.lit(True)
    return summary.join(named, met, "left").drop(*(f"_q{i}" for i in range(len(by))))
