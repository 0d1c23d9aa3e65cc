"""Resampling without multiplying rows, and ranks over ranges, against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from tallyloom.operators import stats


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(0, 1, 70).round(1), "b": rng.normal(0.6, 2, 50).round(1), None: rng.normal(0, 1, 40).round(1)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows + [("a", None)], "g string, v double")
    etas = []
    for _ in range(4000):
        drawn = [rng.choice(x, len(x)) for x in groups.values()]
        grand = np.concatenate(drawn).mean()
        between = sum(len(x) * (x.mean() - grand) ** 2 for x in drawn)
        etas.append(between / (between + sum(((x - x.mean()) ** 2).sum() for x in drawn)))
    low, high = np.quantile(etas, [0.025, 0.975])
    for leaf in (2000, 8):  # one leaf, and a tree of several levels
        got = stats.bootstrap_eta2(df, "g", "v", 4000, leaf=leaf).first()
        assert abs(got.low - low) < 0.012 and abs(got.high - high) < 0.025, (leaf, got, low, high)
    again = stats.bootstrap_eta2(df.repartition(5), "g", "v", 4000, leaf=8).first()
    assert abs(again.low - got.low) < 1e-9 and abs(again.high - got.high) < 1e-9
    assert tuple(stats.bootstrap_eta2(df.where("false"), "g", "v", 10).first()) == (None, None)


def test_ranges_and_ranks(spark):
    sizes = spark.createDataFrame([(float(i % 83) + i // 83 * 0.1, 1 + i % 4) for i in range(500)], "x double, c long").groupBy("x").agg(F.sum("c").alias("c"))
    total = 0
    for r in sorted(stats.counted_before(sizes, "x", "c", parts=7).collect(), key=lambda r: r.x):
        assert r.before == total
        total += r.c
    assert stats.counted_before(sizes.where("false"), "x", "c").collect() == []
    got = stats.wilcoxon(spark.createDataFrame([(1.0,), (-2.0,), (2.0,), (3.0,), (0.0,), (None,)], "d double"), F.col("d")).first()
    assert (got.n, got.plus, got.minus) == (4, 7.5, 2.5)
    p = spark.range(1).select(stats.t_tail(F.lit(2.0), F.lit(10))).first()[0]
    assert abs(p - 0.0733880) < 1e-6
