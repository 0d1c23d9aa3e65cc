"""Experiment statistics as aggregates (T01-T22). Groups are compared by sums of squared deviations from joined means, which stay exact where differences of sums of squares would cancel."""

from __future__ import annotations

import math
import zlib
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.schema import let
from tallyloom.operators.tails import chi2_tail, f_tail, t_tail  # noqa: F401


def average_rank(value: str, block: str) -> Column:
    """Ranks within a block, ties sharing their mean."""
    w = Window.partitionBy(block)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(block, value)) - 1) / 2.0


def one_way(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Eta squared and F of groups of values, one row. Without variation eta2 is null; without variation within, F is infinite."""
    groups = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    whole = groups.agg(F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("n").alias("total"), F.count("*").alias("k"))
    parts = groups.crossJoin(F.broadcast(whole)).agg(  # whole is one row
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("s") / F.col("total"), F.lit(2))).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.first("total").alias("n"), F.first("k").alias("k")
    )
    return _ratio(parts, F.col("k") - 1, F.col("n") - F.col("k"))


def _ratio(parts: DataFrame, dfb: Column, dfw: Column) -> DataFrame:
    b, w = F.col("between"), F.col("within")
    f = F.when((w <= 1e-12) & (b > 0), F.lit(float("inf"))).otherwise(F.try_divide(F.try_divide(b, dfb), F.try_divide(w, dfw)))
    return parts.select(F.col("n").cast("long").alias("n"), dfb.cast("long").alias("dfb"), dfw.cast("long").alias("dfw"), F.try_divide(b, b + w).alias("eta2"), f.alias("f"))


def f_tail_d2(f: Column, dfw: Column) -> Column:
    """T04 for two degrees of freedom between: a closed form."""
    return F.when(f == float("inf"), F.lit(0.0)).otherwise(F.pow(dfw / (dfw + 2 * f), dfw / 2.0))


def chi2_tail_2(x: Column) -> Column:
    """T05 for two degrees of freedom."""
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.exp(-x / 2))


def friedman(rows: DataFrame, block: str, treatment: str, value: str, k: int, ties: bool = False) -> DataFrame:
    """Friedman's statistic over complete blocks of k treatments, with or without the correction for ties; Kendall's W."""
    full = rows.where(F.col(value).isNotNull()).withColumn("_k", F.size(F.collect_set(treatment).over(Window.partitionBy(block)))).where(F.col("_k") == k)
    tied = F.count("*").over(Window.partitionBy(block, value))
    ranked = full.select(block, treatment, average_rank(value, block).alias("rank"), (tied * tied - 1).cast("double").alias("tie"))
    sums = ranked.groupBy(treatment).agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.sum("tie").alias("tie"))
    total = sums.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.max("n").alias("n"), F.sum("tie").alias("tie"))
    n = F.col("n")
    plain = F.try_divide(12 * F.col("rr"), n * k * (k + 1)) - 3 * n * (k + 1)
    stat = F.try_divide(plain, 1 - F.try_divide(F.col("tie"), n * k * (k * k - 1))) if ties else plain
    return total.select(n.alias("blocks"), F.lit(k - 1).cast("long").alias("df"), stat.alias("statistic"), F.try_divide(stat, n * (k - 1)).alias("w"))


def repeated_measures(rows: DataFrame, subject: str, treatment: str, value: str, k: int) -> DataFrame:
    """Repeated-measures ANOVA over subjects with all k treatments, the last value of each cell being given."""
    full = rows.withColumn("_k", F.count("*").over(Window.partitionBy(subject))).where(F.col("_k") == k)
    cells = full.select(
        subject, treatment, F.col(value).cast("double").alias("x"), F.avg(value).over(Window.partitionBy(subject)).alias("s")
    ).join(F.broadcast(full.groupBy(treatment).agg(F.avg(value).alias("t"))), treatment)  # k rows, as blocks are complete
    whole = full.agg(F.avg(value).alias("g"), F.count("*").alias("cells"))
    d = lambda c: F.pow(c, F.lit(2))
    parts = cells.crossJoin(F.broadcast(whole)).agg(  # whole is one row
        F.sum(d(F.col("t") - F.col("g"))).alias("between"), F.sum(d(F.col("x") - F.col("s") - F.col("t") + F.col("g"))).alias("within"), (F.first("cells") / k).alias("n")
    )
    return _ratio(parts, F.lit(k - 1), (F.col("n") - 1) * (k - 1))


def paired_t(pairs: DataFrame, delta: Column) -> DataFrame:
    """N, mean and t of differences; t is infinite if they are all alike (0 if all are 0), null for n below 2."""
    got = pairs.select(delta.alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    t = F.when(F.col("n") < 2, None).when(F.col("sd") == 0, F.when(F.col("mean") == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")))
    return got.select("n", "mean", "sd", t.alias("t"), (F.col("n") - 1).alias("df"))


def spearman(rows: DataFrame, item: str, judge: str, value: str) -> DataFrame:
    """Rank correlation of every pair of judges over the items both rated; null if one side is constant."""
    both = rows.select(item, F.col(judge).alias("a"), F.col(value).alias("x")).join(rows.select(item, F.col(judge).alias("b"), F.col(value).alias("y")), item).where("a < b")
    pair = [F.col("a"), F.col("b")]
    rank = lambda c: F.rank().over(Window.partitionBy(*pair).orderBy(c)) + (F.count("*").over(Window.partitionBy(*pair, c)) - 1) / 2.0
    ranked = both.select("a", "b", rank("x").alias("rx"), rank("y").alias("ry"))
    return ranked.groupBy("a", "b").agg(F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("rho"), F.count("*").alias("n"))


def partial_r2(rows: DataFrame, entity: str, x: str, y: str) -> DataFrame:
    """Share of y's variation within entities that x explains (fixed effects by demeaning); 0 if x does not vary."""
    w = Window.partitionBy(entity)
    inner = rows.select((F.col(x) - F.avg(x).over(w)).alias("dx"), (F.col(y) - F.avg(y).over(w)).alias("dy"))
    s = inner.agg(F.sum(F.col("dx") * F.col("dy")).alias("xy"), F.sum(F.col("dx") * F.col("dx")).alias("xx"), F.sum(F.col("dy") * F.col("dy")).alias("yy"))
    return s.select(F.coalesce(F.try_divide(F.col("xy") * F.col("xy"), F.col("xx") * F.col("yy")), F.lit(0.0)).alias("r2"))


def bootstrap_eta2(rows: DataFrame, group: str, value: str, resamples: int = 10_000, seed: int = 12345, leaf: int = 2_000) -> DataFrame:
    """Percentile interval of eta squared; every resample draws as many values of each group as it has. Nulls take no part.

    Rows are never multiplied. Values with their counts are dealt by hash to the leaves of a binary tree (about `leaf`
    distinct values each); a leaf walks down from its root, where seeded binomial draws that all leaves below a node share
    split a resample's draws, and draws its own values from the multinomial law. So the draws are exactly those of
    sampling with replacement, alike on every run, and only (group, resample) sums are shuffled.
    """
    counts = rows.where(F.col(value).isNotNull()).select(F.to_json(F.struct(F.col(group).alias("g"))).alias("g"), F.col(value).cast("double").alias("v")).groupBy("g", "v").agg(F.count("*").alias("c"))
    distinct, centre = counts.agg(F.count("*"), F.sum(F.col("v") * F.col("c")) / F.sum("c")).first()
    depth = max(0, math.ceil(math.log2(max(distinct, 1) / leaf)))
    leaves = counts.groupBy("g", F.pmod(F.xxhash64("v"), F.lit(1 << depth)).alias("b")).agg(F.sum("c").alias("m"), F.array_sort(F.collect_list(F.struct(F.col("v") - F.lit(centre or 0.0), "c"))).alias("values"))
    nodes = leaves.select("g", "b", "m", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    nodes = nodes.withColumn("node", F.call_function("shiftright", F.col("b"), F.lit(depth) - F.col("level")))
    nodes = nodes.withColumn("parent", F.call_function("shiftright", F.col("node"), F.lit(1)))
    splits = nodes.groupBy("g", "level", "parent").agg(F.sum("m").alias("total"), F.sum(F.when(F.col("node") % 2 == 0, F.col("m")).otherwise(0)).alias("left"))
    steps = nodes.join(splits, ["g", "level", "parent"]).groupBy("g", "b").agg(F.array_sort(F.collect_list(F.struct("level", "parent", "total", "left", "node"))).alias("path"))
    drawn = leaves.join(steps, ["g", "b"]).mapInPandas(_draws(resamples, seed), "r int, n double, s double, q double, g string")
    groups = drawn.groupBy("g", "r").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    whole = groups.groupBy("r").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("q").alias("q"))
    mean = F.col("s") * F.col("s") / F.col("n")
    eta = whole.select(F.try_divide(F.col("b") - mean, F.col("q") - mean).alias("eta2"))
    ordered = eta.agg(F.array_sort(F.collect_list("eta2")).alias("e"))  # as many as there are resamples, a parameter
    return ordered.select(*(F.try_element_at("e", F.lit(int(share * resamples) + 1)).alias(name) for share, name in ((0.025, "low"), (0.975, "high"))))


def _draws(resamples: int, seed: int):
    """Leaves of bootstrap_eta2 to the count, sum and sum of squares that each resample draws in them, summed over a task's leaves of a group."""

    def of_leaf(g, b, values, path):
        key = zlib.crc32(g.encode())
        v, c = np.array([x[0] for x in values]), np.array([x[1] for x in values], dtype="int64")
        k = np.full(resamples, path[0]["total"], dtype="int64")  # level 0 is the root: all draws of the group
        for step in path[1:]:
            left = np.random.default_rng([seed, key, step["level"], step["parent"]]).binomial(k, step["left"] / step["total"])
            k = k - left if step["node"] % 2 else left
        rng, at_once = np.random.default_rng([seed, key, len(path), b]), max(1, (1 << 21) // len(v))
        parts = []
        for i in range(0, resamples, at_once):
            w = rng.multinomial(k[i : i + at_once], c / c.sum())
            parts.append(np.stack([w.sum(axis=1), w @ v, w @ (v * v)]))
        return np.concatenate(parts, axis=1)

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def out():
            for g, x in sums.items():
                yield pd.DataFrame({"r": np.arange(resamples, dtype="int32"), "n": x[0], "s": x[1], "q": x[2], "g": g})
            sums.clear()

        for batch in batches:
            for g, b, values, path in zip(batch["g"], batch["b"], batch["values"], batch["path"], strict=True):
                sums[g] = sums.get(g, 0) + of_leaf(g, int(b), [tuple(x.values()) for x in values], path)
                if len(sums) >= 32:
                    yield from out()
        yield from out()

    return run


def counted_before(rows: DataFrame, order: str, count: str, parts: int = 64) -> DataFrame:
    """Rows with `before`, the sum of `count` over all rows of a smaller `order`, which must be distinct; no task sees more than a range of them.

    The ranges are cut at keys that a hash picks (4,096 at most go to the driver); they only share out the work.
    """
    picked = sorted(r[0] for r in rows.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(4096).collect())
    bounds = sorted({picked[len(picked) * i // parts] for i in range(1, parts)}) if picked else []
    part = reduce(lambda total, at: total + (F.col(order) > F.lit(at)).cast("int"), bounds, F.lit(0))
    dealt = rows.withColumn("_part", part)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = dealt.groupBy("_part").agg(F.sum(count).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.sum(count).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.join(F.broadcast(starts), "_part").withColumn("before", F.col("_start") + F.coalesce(inside, F.lit(0))).drop("_part", "_start")


def wilcoxon(rows: DataFrame, delta: Column) -> DataFrame:
    """Signed-rank test of differences from 0: n without zeros, the rank sums of either sign, and z by the normal law, corrected for ties."""
    sizes = rows.select(delta.cast("double").alias("d")).where("d IS NOT NULL AND d <> 0").groupBy(F.abs("d").alias("a")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    rank = F.col("before") + (F.col("c") + 1) / 2
    c = F.col("c").cast("double")
    sums = counted_before(sizes, "a", "c").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.col("up") * rank).alias("plus"), F.sum((F.col("c") - F.col("up")) * rank).alias("minus"), F.sum(c * c * c - c).alias("ties"))
    n = F.col("n").cast("double")
    z = F.try_divide(F.least("plus", "minus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    return sums.select("n", "plus", "minus", z.alias("z"))


def spread_of_pairs(pairs: DataFrame, value: str = "rho") -> DataFrame:
    """Least, greatest and mean correlation of the pairs that have one."""
    return pairs.agg(F.count(value).alias("pairs"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def within_tolerance(got: Column, wanted: Column, tolerance: float) -> Column:
    """T19."""
    return F.when(F.abs(got - wanted) <= tolerance, "PASS").otherwise("FAIL")


def py_round(value: Column, digits: int) -> Column:
    """rounding as Python does it, by the exact binary value, halves to even; digits from 0 to 6.

    A product with 10^digits that is farther from a half than its own rounding is decided by it. Nearer ones have the fraction's 92 bits taken apart into two whole numbers, so that a half
    is told from what is next to it; that takes decimals and many times longer. Numbers of 2^53 / 10^digits or more, NaN and infinity stay as they are.
    """
    unit, one = 10**digits, F.lit(Decimal(2**92)).cast("decimal(38,0)")

    def fraction_bits(size):
        high = F.floor((size - F.floor(size)) * 2.0**30)
        low = ((size - F.floor(size)) * 2.0**30 - high) * 2.0**62
        return ((high.cast("decimal(12,0)") * F.lit(2**62).cast("decimal(20,0)") + low.cast("bigint").cast("decimal(20,0)")) * F.lit(unit).cast("decimal(7,0)")).cast("decimal(38,0)")

    def nearest(v, parts):
        steps, twice = F.call_function("div", parts, one), (parts % one) * 2
        least = F.floor(F.abs(v)) * unit + steps
        up = (twice > one) | ((twice == one) & (least % 2 == 1))
        return F.signum(v) * (least + up.cast("int")) / unit

    def rounded(v, product):
        over = product - F.floor(product)
        plain = F.signum(v) * (F.floor(product) + (over > 0.5).cast("int")) / unit
        return F.when(F.abs(over - 0.5) > product * 2.0**-52, plain).otherwise(let(fraction_bits(F.abs(v)), lambda parts: nearest(v, parts)))

    return let(value.cast("double"), lambda v: F.when(F.abs(v) < 2.0**53 / unit, let(F.abs(v) * unit, lambda product: rounded(v, product))).otherwise(v))
