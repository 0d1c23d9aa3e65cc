"""Single operators on small literals."""

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import normalize, presence, textmeta
from tallyloom.operators import collisions, coverage, records, relations, stats
from tallyloom.plans.report import Section, select
from tallyloom.sources import readers, sinks

GROUPS = [[12.5, 14.0, 11.25, 17.0], [21.0, 19.5, 25.75, 22.0], [16.0, 15.5, 18.25, 13.0]]


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


@pytest.fixture(scope="module")
def flat(spark):
    rows = [("org/model-a", "BBH", 40.0, "board", "3", "", "lm_eval"), ("model-a", "BBH (3-shot)", 47.0, "paper", "", "0.0", ""), ("org/model-b", "BBH", 50.0, "board", "3", "", "lm_eval"), ("org/model-b", "BBH", 51.5, "paper", "", "", "lm_eval")]
    df = spark.createDataFrame(rows, "model_id string, benchmark string, score double, source string, shots string, temperature string, eval_library string")
    return df.withColumns({"m": normalize.norm_model(F.col("model_id"), F.lit("")), "b": normalize.norm_bench(F.col("benchmark")), "row": F.monotonically_increasing_id()})


def test_coverage_and_collisions(flat):
    assert coverage.coverage(flat, {"shots": presence.present(F.col("shots")), "high": F.col("score") > 45}).first().asDict() == {"n": 4, "shots": 50.0, "high": 75.0}
    assert coverage.coverage(flat.limit(0), {"shots": F.col("shots") != ""}).first().asDict() == {"n": 0, "shots": 0.0}
    cell = collisions.cells(flat, ["m", "b"], "source", "score", ~presence.has(F.col("eval_library")), F.lit(True))
    got = collisions.prevalence(cell).first()
    assert (got["pairs"], got["differ_small"], got["differ_large"], got["harness_missing"]) == (2, 2, 1, 1)
    assert collisions.prevalence(cell, 2, 10).first()["differ_small"] == 1
    gaps = collisions.reference_gaps(flat, ["m", "b"], "source", "score", "board", "row")
    assert sorted(r["gap"] for r in gaps.collect()) == [1.5, 7.0]
    assert collisions.reference_gaps(flat, ["m", "b"], "source", "score", "none", "row").count() == 0


def test_conflicts_meet_once(flat):
    found = collisions.conflicts(flat, ["m", "b"], "row", "source", "score", F.lit(0.0), F.lit(100.0))
    assert sorted((round(r["relative_diff"], 4), r["severity"]) for r in found.collect()) == [(0.015, "minor"), (0.07, "significant")]
    assert collisions.worst(found, 1).first()["severity"] == "significant"


def test_anova(spark):
    df = spark.createDataFrame([(str(i), v) for i, g in enumerate(GROUPS) for v in g], "g string, v double")
    got = stats.one_way(df, "g", "v").first()
    grand = sum(map(sum, GROUPS)) / 12
    b = sum(len(g) * (sum(g) / len(g) - grand) ** 2 for g in GROUPS)
    w = sum((v - sum(g) / len(g)) ** 2 for g in GROUPS for v in g)
    assert (got["dfb"], got["dfw"]) == (2, 9)
    assert got["eta2"] == pytest.approx(b / (b + w)) and got["f"] == pytest.approx(b / 2 / (w / 9))
    flat_within = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    assert math.isinf(stats.one_way(flat_within, "g", "v").first()["f"])


def test_tails(spark):
    """Against closed forms: two degrees between, Student's law with one and two, even and odd degrees of chi squared."""
    inf = math.inf
    f = [(x, 2.0, d2, (d2 / (d2 + 2 * x)) ** (d2 / 2)) for x in (0.001, 0.5, 3.2, 40.0) for d2 in (1.0, 9.0, 500.0, 99_995.0)]
    f += [(t * t, 1.0, 1.0, 1 - 2 * math.atan(t) / math.pi) for t in (0.01, 1.0, 30.0)] + [(t * t, 1.0, 2.0, 1 - t / math.sqrt(2 + t * t)) for t in (0.01, 1.0, 30.0)] + [(inf, 2.0, 9.0, 0.0), (0.0, 3.0, 4.0, 1.0), (-1.0, 3.0, 4.0, 1.0), (13.0032, 2.0, 69.0, (69 / (69 + 26.0064)) ** 34.5)]
    for r in spark.createDataFrame(f, "f double, a double, b double, want double").select("*", stats.f_tail(F.col("f"), F.col("a"), F.col("b")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"], rel=1e-8, abs=1e-13), r
    poisson = lambda x, k: sum(math.exp(j * math.log(x / 2) - x / 2 - math.lgamma(j + 1)) for j in range(k // 2))
    c = [(x, float(k), poisson(x, k)) for x in (0.01, 4.0, 7.3, 90.0, 1000.0) for k in (2, 4, 50, 1000)] + [(x, 1.0, math.erfc(math.sqrt(x / 2))) for x in (0.01, 3.84, 50.0)] + [(0.0, 3.0, 1.0), (-2.0, 1.0, 1.0), (inf, 5.0, 0.0)]
    for r in spark.createDataFrame(c, "x double, k double, want double").select("*", stats.chi2_tail(F.col("x"), F.col("k")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"], rel=1e-7, abs=1e-12), r
    nothing = spark.createDataFrame([(None, 2.0)], "x double, k double").select(stats.f_tail(F.col("x"), F.col("k"), F.col("k")).alias("f"), stats.chi2_tail(F.col("x"), F.col("k")).alias("c")).first()
    assert nothing["f"] is None and nothing["c"] is None


def test_friedman(spark):
    matrix = [[7, 5, 3], [8, 6, 2], [6, 7, 1], [9, 4, 5]]
    df = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r)] + [(9, 0, 1.0)], "b int, t int, v double")
    got = stats.friedman(df, "b", "t", "v", 3).first()
    assert (got["blocks"], got["df"]) == (4, 2) and got["w"] == pytest.approx(got["statistic"] / 8)


def test_spearman_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(i, j, float(v)) for i in range(4) for j, v in (("a", i), ("b", -i), ("c", 1))], "i int, j string, v double")
    got = {(r["a"], r["b"]): r["rho"] for r in stats.spearman(df, "i", "j", "v").collect()}
    assert got["a", "b"] == pytest.approx(-1) and got["a", "c"] is None


def test_presence(spark):
    words = spark.createDataFrame([(w,) for w in (None, "", " ", "unknown", "NaN", "standard", "0", "x")], "w string")
    got = words.select("w", presence.present(F.col("w")).alias("p"), presence.prompt_present(F.col("w")).alias("q"), presence.has(F.col("w")).alias("h"), presence.aggregate_present(F.col("w")).alias("a")).collect()
    assert [r["p"] for r in got] == [False, False, False, False, False, True, True, True]
    assert [r["q"] for r in got] == [False, False, False, True, False, False, True, True]
    assert [r["a"] for r in got] == [False, False, True, False, True, True, True, True]


def test_text_settings(spark):
    text = lambda x: F.lit(x)
    assert one(spark, textmeta.shots(text("5-shot CoT")), textmeta.shots(text("few shot")), textmeta.shots(text("none")), textmeta.temperature(text("temp=0.7"))) == [5, -1, None, 0.7]
    got = one(spark, textmeta.name_settings(text("Model-X (8-shot, CoT, maj1@16, greedy)")))[0]
    assert (got["clean_name"], got["shots"], got["chain_of_thought"], got["samples"], got["self_consistency"], got["temperature"]) == ("Model-X", "8", "yes", "16", "yes", "0.0")
    assert one(spark, textmeta.harness(text("We used LM-Eval and vLLM")))[0] == "lm-eval-harness"
    assert one(spark, textmeta.arxiv_ids(text("arxiv.org/abs/2407.10671v2, paper: 2401.00001, arxiv.org/pdf/2407.10671")))[0] == ["2407.10671", "2401.00001"]
    assert one(spark, textmeta.rating(text("[[7]]")), textmeta.rating(text("Rating: 11")), textmeta.final_number(text("1 2 #### 1,234")), textmeta.final_number(text("a 3 b 4"))) == [7.0, None, 1234.0, 4.0]
    assert one(spark, normalize.number(text("1d")), normalize.number(text(" 1e3 ")), normalize.percent(text("1,234.5%"))) == [None, 1000.0, 1234.5]
    assert one(spark, normalize.arxiv_month(text("2407.10671")), normalize.arxiv_month(text("2413.1")), normalize.iso_date(text("2024/05/06"))) == ["2024-07-01", "", "2024-05-06"]
    bounds = one(spark, normalize.score_range(text("0-100")), normalize.score_range(text("1-inf")), normalize.metric_bounds(text("Pass@5")), normalize.metric_bounds(text("perplexity")))
    assert tuple(bounds[0]) == (0.0, 100.0) and tuple(bounds[1]) == (1.0, None) and tuple(bounds[2]) == (False, 0.0, 100.0) and tuple(bounds[3]) == (True, 1.0, None)
    assert one(spark, normalize.model_args(text("pretrained=a,b,dtype=x=y")))[0] == {"pretrained": "a,b", "dtype": "x=y"}


RECORD = """{"schema_version": "0.2.1", "evaluation_id": "e", "retrieved_timestamp": "1", "source_metadata": {"source_type": "paper_html", "evaluator_relationship": "unknown", "source_name": "s"},
"eval_library": {"name": "lm_eval"}, "model_info": {"name": "m", "id": "o/m"}, "evaluation_results": [
{"evaluation_name": "Big-Bench Hard", "source_data": {"dataset_name": "Big-Bench Hard"}, "metric_config": {"metric_name": "accuracy", "min_score": 0, "max_score": 100}, "score_details": {"score": 75.5}, "generation_config": {"generation_args": {"shots": 5}}},
{"evaluation_name": "P", "metric_config": {"metric_name": "Parameters (Billions)", "min_score": 0, "max_score": 100}, "score_details": {"score": 7.0}}]}"""


@pytest.fixture(scope="module")
def recs(spark):
    return spark.range(1).select(F.from_json(F.lit(RECORD), records.RECORD).alias("r")).select("r.*")


def test_records(recs):
    rows = records.flatten(recs, {"Big-Bench Hard": "BBH"}).orderBy("er_index").collect()
    assert (rows[0]["benchmark"], rows[0]["harness"], rows[0]["shots"], rows[0]["source"], rows[1]["shots"]) == ("BBH", "lm_eval", "5", "s", "")
    cut = records.drop_leaks(recs).first()
    assert (cut["removed"], len(cut["evaluation_results"])) == (1, 1)
    fixed = records.autofix(recs).first()
    assert fixed["source_metadata"]["source_type"] == "documentation" and fixed["source_metadata"]["evaluator_relationship"] == "other" and fixed["eval_library"]["version"] == "unknown" and len(fixed["fixes"]) == 3
    assert records.record_errors(recs).first()["status"] == "invalid" and records.record_errors(records.autofix(recs)).first()["status"] == "valid"
    named = records.canonical_results(recs, {"Big-Bench Hard": "BBH"}).first()["evaluation_results"][0]
    assert (named["evaluation_name"], named["source_data"]["dataset_name"]) == ("BBH", "BBH")
    assert records.split_results(recs).count() == 2


def test_issue_checks(spark):
    df = spark.createDataFrame([(1, 150.0), (2, None), (3, 0.0), (4, 50.0)], "row int, score double")
    got = sorted((r["row"], r["severity"]) for r in records.score_issues(df, F.lit("s"), F.col("score"), F.lit(0.0), F.lit(100.0), "row").collect())
    assert got == [(1, "CRITICAL"), (1, "ERROR"), (2, "ERROR"), (3, "WARNING")]


def test_harness_log(spark):
    log = '{"t": {"exact_match,strict": 0.5, "exact_match_stderr,strict": 0.1, "alias": null}}'
    got = one(spark, records.harness_results(F.from_json(F.lit(log), "map<string,map<string,double>>")))[0]
    assert [(r["task"], r["metric"], r["filter"], r["value"], r["stderr"]) for r in got] == [("t", "exact_match", "strict", 0.5, 0.1)]


def test_keep_and_lookup(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "c", 1)], "k int, v string, o int")
    assert {r["k"]: r["v"] for r in relations.last_values(df, ["k"], "o", ["v"]).collect()} == {1: "b", 2: "c"}
    assert {r["k"]: r["v"] for r in relations.keep(df, ["k"], F.col("o")).collect()} == {1: "a", 2: "c"}
    assert relations.canonical_hash('{"b": [2, 1], "a": 1, "evaluation_id": 5}') == relations.canonical_hash('{"a": 1, "b": [1, 2]}') != relations.canonical_hash('{"a": 2}')


def test_files(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.append_new(df, path, ["k"])
    sinks.append_new(df.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), path, ["k"])
    assert spark.read.parquet(path).count() == 3
    (tmp_path / "log.txt").write_text('noise\nRESULT_JSON: {"a": 1}\n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.prefixed_lines(spark, str(tmp_path / "log.txt"), "a int").collect()) == [1, 2]
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    tree = tmp_path / "data"
    for place in ("x", "x/samples", "x/aggregated"):
        (tree / place).mkdir(parents=True, exist_ok=True)
        (tree / place / "r.json").write_text(RECORD)
    assert readers.record_tree(spark, str(tree), records.RECORD).count() == 1
    got = one(spark, readers.table_rows(F.lit("| Model | Score |\n|---|---|\n| m | 12 | 8.9 |")), readers.raw_objects(F.lit('{"a":1}{"a":2}[{"a":3}]')))
    assert [(r["name"], r["score"]) for r in got[0]] == [("m", 8.9)] and len(got[1]) == 3


def test_cached_rows(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return spark.createDataFrame([(len(calls),)], "n int")

    get = lambda age, **how: readers.cached(spark, str(tmp_path), "board", fetch, age, **how).first()["n"]
    assert [get(3600), get(3600)] == [1, 1]
    (tmp_path / "board" / "99999999999999").mkdir()  # a fetch that was cut off
    assert [get(3600), get(0), get(3600, refresh=True), get(3600)] == [1, 2, 3, 3]


def test_sections():
    known = [Section("a", "A", None), Section("b", "B", None)]
    assert [s.key for s in select(known, ["b"])] == ["b"]
    with pytest.raises(KeyError):
        select(known, ["z"])


def test_composition_of_odd_rows(spark):
    """Nulls among groups and entities, an entity that is the group itself, no rows."""
    from tallyloom.operators import coverage

    rows = [("a", 1, "x"), ("a", 1, None), ("b", 1, "x"), (None, None, "y"), (None, 2, "y"), ("b", None, None)]
    df = spark.createDataFrame(rows, "s string, m int, b string")
    entities = {"models": "m", "benchmarks": "b", "sources": "s"}
    distinct = lambda of: (len(of), *(len({r[i] for r in of} - {None}) for i in (1, 2, 0)))
    wanted = [(s, *distinct([r for r in rows if r[0] == s])) for s in ("a", "b", None)] + [(None, *distinct(rows))]
    assert sorted(map(str, map(tuple, coverage.composition(df, "s", entities).collect()))) == sorted(map(str, wanted))
    assert [tuple(r) for r in coverage.composition(df.where("false"), "s", entities).collect()] == [(None, 0, 0, 0, 0)]
    assert coverage.composition(df, "s", entities).columns == ["s", "n", "models", "benchmarks", "sources"]
