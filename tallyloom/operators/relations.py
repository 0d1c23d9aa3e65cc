"""Joins, windows, keep-first and keep-last, set operations and dedup as the analyses need them (J, W, O, D)."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired_delta(rows: DataFrame, key: list[str], version: str, a: str, b: str, value: str) -> DataFrame:
    """Value under b less value under a where both exist; one shuffle on the key."""
    wide = rows.where(F.col(version).isin(a, b)).groupBy(*key).agg(F.avg(F.when(F.col(version) == a, F.col(value))).alias("a"), F.avg(F.when(F.col(version) == b, F.col(value))).alias("b"))
    return wide.where("a IS NOT NULL AND b IS NOT NULL").withColumn("delta", F.col("b") - F.col("a"))


def near_names(rows: DataFrame, name: str, norm: Column) -> DataFrame:
    """Names that share a normal form, without comparing all pairs."""
    return rows.select(F.col(name).alias("name"), norm.alias("norm")).distinct().groupBy("norm").agg(F.count("*").alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name")).where("n > 1")


def undone(plan: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Planned rows whose key is not done."""
    return plan.join(done.select(*key).distinct(), key, "left_anti")


def undone_groups(plan: DataFrame, done: DataFrame, group: str, key: str) -> DataFrame:
    """Groups of which at least one key is not done."""
    known = done.select(F.col(key)).distinct().withColumn("_done", F.lit(1))
    return plan.join(known, key, "left").groupBy(group).agg(F.count("*").alias("n"), F.count("_done").alias("n_done")).where("n > n_done")


def best_match(want: DataFrame, have: DataFrame, block: str, score: Column, order: str) -> DataFrame:
    """For each wanted row (id w) the candidate (id h) of its block with the best score, ties to the first."""
    scored = want.join(have, block).withColumn("score", score)
    return scored.groupBy("w").agg(F.max_by("h", F.struct(F.col("score"), -F.col(order))).alias("h"), F.max("score").alias("score"))


def lookup(rows: DataFrame, table: DataFrame, key: str, order: str | Column | None = None) -> DataFrame:
    """The table's first row of a key beside each row; first in the order given, else by the table's columns. No row is multiplied."""
    values = [c for c in table.columns if c != key]
    first = table.groupBy(key).agg(F.min_by(F.struct(*values), F.struct(*values) if order is None else order).alias("_v"))
    return rows.join(first.select(key, *(F.col("_v")[c].alias(c) for c in values)), key, "left")


def merged(a: DataFrame, b: DataFrame, key: str, shared: list[str]) -> DataFrame:
    """Two boards by model; shared columns come from the first that has them."""
    left, right = (df.select(key, *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c != key)) for df, s in ((a, "a"), (b, "b")))
    both = left.join(right, key, "full_outer")
    return both.select(key, *(F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in shared), *(c for c in both.columns if c != key and c[:-2] not in shared))


def plan_grid(domain: DataFrame, levels: dict[str, list]) -> DataFrame:
    """Every combination of levels for each row of the domain; a few lists of literals, so exploded rather than joined."""
    for name, values in levels.items():
        domain = domain.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return domain


def by_id_or_short_name(want: DataFrame, have: DataFrame, name: str, full: str, short: str, value: str) -> DataFrame:
    """The value of the full id, else of the short name if just one id has it; the least value of an id that has several."""
    by_full = have.groupBy(F.col(full).alias(name)).agg(F.min(value).alias("_full"))
    by_short = have.groupBy(F.col(short).alias(name)).agg(F.min(value).alias("_short"), F.count_distinct(full).alias("_ids")).where("_ids = 1").drop("_ids")
    return want.join(by_full, name, "left").join(by_short, name, "left").withColumn(value, F.coalesce("_full", "_short")).drop("_full", "_short")


def keep(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def last_values(rows: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """The values of the last row of each key; aggregated on both sides of the shuffle, unlike a window."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*key, "_v.*")


def first_values(rows: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """W04 by aggregation."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*values), order).alias("_v")).select(*key, "_v.*")


def ordinal_rank(block: str, *order: Column) -> Column:
    """W02, W06."""
    return F.row_number().over(Window.partitionBy(block).orderBy(*order))


def running_total(key: str, order: str, value: str) -> Column:
    """F44's budget: the sum up to and with this row."""
    return F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; empty if both are alike."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def difference(wanted: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """D02."""
    return wanted.select(*key).distinct().join(known.select(*key), key, "left_anti")


def duplicates_within(rows: DataFrame, key: list[str], score: str) -> DataFrame:
    """Keys with several records; a warning if scores differ (null counts as a score), else information."""
    found = rows.groupBy(*key).agg(F.count("*").alias("n"), F.size(F.collect_set(F.struct(score))).alias("scores")).where("n > 1")
    return found.withColumn("severity", F.when(F.col("scores") > 1, "WARNING").otherwise("INFO")).withColumn("scores", F.col("scores").cast("long"))


def canonical_hash(text: str | None, ignored: tuple[str, ...] = ("retrieved_timestamp", "evaluation_id")) -> str | None:
    """SHA-256 of a JSON document with sorted keys and lists, some keys left out at every depth; null if it is none."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in sorted(x.items()) if k not in ignored}
        if isinstance(x, list):
            return sorted((plain(v) for v in x), key=lambda v: json.dumps(v, sort_keys=True))
        return x

    try:
        return hashlib.sha256(json.dumps(plain(json.loads(text)), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    except (TypeError, ValueError):
        return None


def content_hash(document: Column) -> Column:
    """D03 as a column; Spark cannot sort the keys of arbitrary JSON."""

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(canonical_hash)

    return digest(document)


def duplicate_groups(rows: DataFrame, digest: Column, row: str) -> DataFrame:
    """Documents of one content: how many and the first."""
    return rows.withColumn("_h", digest).where("_h IS NOT NULL").groupBy(F.col("_h").alias("hash")).agg(F.count("*").alias("n"), F.min(row).alias("first_row")).where("n > 1")
