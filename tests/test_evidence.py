"""Number evidence, name stages, exact quantiles and partial R2 against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import evidence, quantiles, regression


def test_number_forms_and_evidence(spark):
    texts = spark.createDataFrame([(1, "It scored 45.60 and 0.7852, of 1,234,567.5 tokens; 12.5% in 1,2345 and 30"), (2, None), (3, "no number"), (4, "7 " * 50_000 + "8.25")], "t int, text string")
    cases = {
        (1, "45.6"): True, (1, "45.60"): True, (1, "45.600"): False, (1, "5.6"): False, (1, "78.52"): True, (1, "0.785"): False, (1, "1234567.5"): True, (1, "1,234,567.50"): False, (1, "0.125"): True, (1, "-45.6"): True, (1, "30.0"): True,
        (1, "234"): False, (1, "2345"): True, (1, "x"): False, (1, None): True, (2, "1"): False, (3, "3"): False, (4, "7"): True, (4, "8.25"): True, (4, "825"): False, (9, "7"): False,
    }
    values = spark.createDataFrame([(i, t, v, "x") for i, (t, v) in enumerate(cases)] * 2, "row int, t int, value string, token string").repartition(3).drop("token")
    got = evidence.number_evidence(values, ["row"], "t", "value", texts, "text").collect()
    assert len(got) == 2 * len(cases) and {(r["t"], r["value"]): r["found"] for r in got} == cases


def test_values_meet_pieces_of_their_text_without_a_shuffle_of_forms(spark):
    texts = spark.createDataFrame([(1, " ".join(f"{i}.5" for i in range(1000))), (2, "7.25"), (1, "and 9999")], "t int, text string")  # several pieces, several texts of an id
    values = spark.createDataFrame([(1, f"{i}.5") for i in range(1200)] + [(1, "9999"), (2, "7.25"), (2, "7"), (3, "7"), (None, "7")], "t int, value string")
    got = evidence.number_evidence(values, [], "t", "value", texts, "text")
    assert {(r["t"], r["value"]) for r in got.where("found").collect()} == {(1, f"{i}.5") for i in range(1000)} | {(1, "9999"), (2, "7.25")} and got.count() == 1205
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # before: a semi-join of forms, distinct, and a join back


def test_record_evidence(spark):
    texts = spark.createDataFrame([(1, "On Big_Bench the Foo Model reached acc. 0.50 with lm evaluation harness")], "t int, text string")
    values = [(1, "model_name", "Foo-Model 7B"), (1, "metric_name", "accuracy"), (1, "score", "50"), (2, "harness", "OpenCompass, lm-evaluation-harness"), (2, "score", "51"), (2, "metric_name", "bleu"), (3, "name", "Big-Bench (hard)")]
    df = spark.createDataFrame([(r, 1, n, v) for r, n, v in values], "record int, t int, name string, value string")
    got = evidence.record_evidence(df, ["record"], "t", "name", "value", F.col("name") == "score", texts, "text").orderBy("record").collect()
    assert [(r["record"], r["validated"], r["incorrect"]) for r in got] == [(1, True, []), (2, False, ["metric_name: bleu", "score: 51"]), (3, True, [])]


@pytest.mark.parametrize("bins", [2, 16, 4096])
def test_exact_quantiles(spark, bins):
    rng = random.Random(bins)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(3000)], "same": [4.25] * 50, "one": [-3.0], "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, 5.0, 5.0], "ties": [float(i % 3) for i in range(100)], None: [1.0, 2.0], "none": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("hot", None), ("hot", float("nan"))]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", {"m": 0.5, "low": 0.1, "top": 1.0}, bins).collect()
    assert {r["g"] for r in got} == set(groups) - {"none"}
    for r in got:
        v = groups[r["g"]]
        assert r["top"] == max(v) and r["m"] == pytest.approx(statistics.median(v), rel=1e-12) and r["low"] == pytest.approx(np.quantile(v, 0.1), rel=1e-9, abs=1e-12), r
    whole = quantiles.exact_median(spark.createDataFrame(rows, "g string, v double"), [], "v").collect()
    assert [r["median"] for r in whole] == [pytest.approx(statistics.median([v for vs in groups.values() for v in vs]), rel=1e-12)]
    assert quantiles.exact_median(spark.createDataFrame([], "g string, v double"), [], "v").collect() == []


def test_partial_r2_is_that_of_least_squares(spark):
    rng = np.random.default_rng(5)
    n, entity = 400, np.repeat(np.arange(10), 40)
    x = rng.normal(size=(n, 4)) + entity[:, None]
    x[:, 3] = 2 * x[:, 0] - x[:, 1]  # says nothing new
    y = 1e6 + entity * 3 + x[:, 0] - 0.5 * x[:, 1] + 0.2 * x[:, 2] + rng.normal(size=n)
    df = spark.createDataFrame([(int(e), *map(float, r), float(v)) for e, r, v in zip(entity, x, y, strict=True)] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0, 1.0)], "e int, a double, b double, c double, d double, y double").repartition(5)
    got = regression.sensitivity(df, "e", "y", ["a", "b", "c", "d"]).first()
    dummies = (entity[:, None] == np.arange(10)).astype(float)
    rest = lambda *more: float(((y - (m := np.column_stack([dummies, *more])) @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())
    base = rest()
    assert got["n"] == n and got["entities"] == 10 and got["r2_base"] == pytest.approx(1 - base / float(((y - y.mean()) ** 2).sum()), rel=1e-6)
    for i, c in enumerate("abcd"):
        assert got[f"partial_{c}"] == pytest.approx((base - rest(x[:, i])) / base, rel=1e-5)
    assert got["partial_all"] == pytest.approx((base - rest(*x.T)) / base, rel=1e-5)
    still = regression.sensitivity(df.withColumn("y", F.lit(3.0)), "e", "y", ["a"]).first()
    assert (still["r2_base"], still["partial_a"], still["partial_all"]) == (0.0, 0.0, 0.0)


def test_codes(spark):
    df = spark.createDataFrame([("cot",), ("standard",), (None,), ("odd",), ("cot",)], "f string")
    assert sorted((str(r["f"]), r["c"]) for r in regression.category_codes(df, "f", "c").collect()) == [("None", -1.0), ("cot", 0.0), ("cot", 0.0), ("odd", 1.0), ("standard", 2.0)]
    assert [r["c"] for r in df.select(regression.mapped_codes(F.col("f"), regression.FORMAT_CODES).alias("c")).collect()] == [1.0, 0.0, -1.0, -1.0, 1.0]


def test_few_categories_stay_off_the_shuffle(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 10 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("f")).repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = regression.category_codes(df, "f", "c"), regression.category_codes(df, "f", "c", most=2)
        assert "BroadcastHashJoin [f#" in few._jdf.queryExecution().toString() and "SortMergeJoin [f#" in many._jdf.queryExecution().toString()
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and {r.c for r in few.collect()} == {-1.0, 0.0, 1.0, 2.0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
