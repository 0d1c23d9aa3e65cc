"""Queries of the records of papers: orders stand for papers, customers for models, parts for model cards, events for reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import papers
from tallyloom.plans import query

AUTHORS = "c_mktsegment || ' Team, Jane-Doe'"
FAMILY = "CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'Other' END"


def models(read):
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    paper = F.struct(F.concat(F.lit("2401."), F.lpad(k.cast("string"), 5, "0")).alias("arxiv_id"), F.col("c_name").alias("title"), F.when(k % 2 == 0, F.concat(F.col("c_name"), F.lit("!"))).alias("actual_title"), F.concat(s, F.lit(" Team, Jane-Doe")).alias("authors"), F.lit("2024").alias("year"))
    model = F.struct(F.concat(F.lit("m_"), F.col("c_nationkey").cast("string"), F.lit(" x")).alias("model_name"), F.when(k % 5 == 0, s).alias("developer"), F.when(k % 3 == 0, s).when(k % 3 == 1, "Other").alias("model_family"), (k % 2 == 1).alias("is_baseline"))
    bench = F.struct(F.lit("MMLU").alias("benchmark_name"), F.col("c_acctbal").alias("score"), F.lit("accuracy").alias("metric_name"), F.when(k % 7 == 0, "own").alias("eval_harness"))
    whole = F.struct(F.lit("shared").alias("eval_harness"), (k % 2 == 0).alias("eval_harness_applies_to_all"), F.when(k % 4 == 0, "7").alias("seed"), F.lit(None).cast("string").alias("eval_library_version"))
    arguments = F.when(k % 2 == 0, F.create_map(F.lit("temperature"), F.lit("0.5"), F.lit("shots"), (k % 6).cast("string"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    return read("customer"), paper, model, bench, whole, arguments


@query(f"""SELECT c_custkey, 'arxiv_html_llm/m-' || c_nationkey || '_x/2401.' || lpad(c_custkey::VARCHAR, 5, '0') || '/MMLU/' ||
CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 6) || '_' || left(md5('{{"shots": ' || (c_custkey % 6) || ', "temperature": 0.5}}'), 8) ELSE 'x_' || left(md5('{{}}'), 8) END AS id,
CASE WHEN c_custkey % 2 = 1 AND c_custkey % 3 > 0 THEN 'third_party' ELSE 'first_party' END AS party,
CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 1 THEN coalesce({FAMILY}, 'unknown') ELSE {AUTHORS} END AS developer,
CASE WHEN c_custkey % 7 = 0 THEN 'own' WHEN c_custkey % 2 = 0 THEN 'shared' ELSE 'unknown' END AS library, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS title,
round(c_acctbal, 6) AS score, CASE WHEN c_custkey % 4 = 0 THEN '7' END AS seed FROM customer""")
def c16_paper_record(read):
    rows, paper, model, bench, whole, arguments = models(read)
    r = rows.select("c_custkey", papers.paper_record(paper, model, bench, whole, arguments, F.lit("llm"), F.lit("2024-01-31")).alias("r"))
    result = F.col("r.evaluation_results")[0]
    return r.select(
        "c_custkey", F.col("r.evaluation_id").alias("id"), F.col("r.source_metadata.evaluator_relationship").alias("party"), F.col("r.model_info.developer").alias("developer"), F.col("r.eval_library.name").alias("library"),
        F.col("r.source_metadata.additional_details")["paper_title"].alias("title"), result["score"].alias("score"), result["additional_details"]["seed"].alias("seed"),
    )


@query(f"""SELECT c_custkey, 'arxiv_html_naive/' || replace(c_name, '#', '_') || '/2401.' || lpad(c_custkey::VARCHAR, 5, '0') AS id, {AUTHORS} AS developer, 'multiple_benchmarks' AS bench, 0.0::DOUBLE AS score,
CASE WHEN c_custkey % 2 = 0 THEN 'lm-eval' ELSE 'unknown' END AS library FROM customer""")
def c17_fallback_record(read):
    rows, paper, _, _, _, arguments = models(read)
    more = F.create_map(F.lit("eval_harness"), F.when(F.col("c_custkey") % 2 == 0, "lm-eval"))
    r = rows.select("c_custkey", papers.fallback_record(paper, F.col("c_name"), arguments, more, F.lit("naive"), F.lit("2024-01-31")).alias("r"))
    result = F.col("r.evaluation_results")[0]
    return r.select("c_custkey", F.col("r.evaluation_id").alias("id"), F.col("r.model_info.developer").alias("developer"), result["evaluation_name"].alias("bench"), result["score"].alias("score"), F.col("r.eval_library.name").alias("library"))


@query("""SELECT p_partkey, 'hf_model_cards/org_m' || p_partkey || '/1700000000' AS id, 'm' || p_partkey AS model, CASE WHEN p_partkey % 2 = 0 THEN '2023-05-01' END AS dated,
CASE WHEN p_partkey % 3 = 0 THEN 'helm' WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE p_brand END AS library, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 5 - 1)::BIGINT END AS shots FROM part""")
def c15_card_record(read):
    k = F.col("p_partkey")
    one = lambda lib, shots: F.struct(F.lit("MMLU").alias("benchmark"), F.lit("acc").alias("metric_name"), F.lit(0.5).alias("score"), shots.cast("long").alias("shots"), lib.alias("eval_lib"))
    results = F.array(one(F.lit(""), k % 5 - 1), one(F.when(k % 3 == 0, "helm"), F.lit(5)))
    papers_of = F.array(F.lit("2399.00001"), F.when(k % 2 == 0, "2305.00001").otherwise("none"))
    r = read("part").select("p_partkey", papers.card_record(F.concat(F.lit("org/m"), k.cast("string")), F.lit("org"), F.when(k % 4 == 0, "").otherwise(F.col("p_brand")), results, F.lit("1700000000"), papers_of).alias("r"))
    return r.select("p_partkey", F.col("r.evaluation_id").alias("id"), F.col("r.model_name").alias("model"), F.col("r.evaluation_timestamp").alias("dated"), F.col("r.library").alias("library"), F.col("r.results")[0]["shots"].alias("shots"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'GSM8K' WHEN 1 THEN 'SWE-bench' WHEN 2 THEN 'MATH-500' END AS bench FROM nation")
def f25_paper_benchmark(read):
    name = F.element_at(F.array(*map(F.lit, (" GSM8K (8-Shot) ", "SWE-Bench Verified", "math 500", "unheard of"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return read("nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), papers.paper_benchmark(name).alias("bench"))


@query("""SELECT row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 1 ELSE 2 END, lpad(event_id::VARCHAR, 12, '0')) AS row_id, event_type AS sample_set, user_id, round(value, 6) AS extracted_score,
lpad(event_id::VARCHAR, 12, '0') AS json_file, '' AS annotation, '' AS annotator_notes FROM events WHERE event_type IN ('view', 'click')""")
def p16_annotation_sheet(read):
    rows = read("events").withColumn("path", F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return papers.annotation_sheet(rows, ["view", "click"], "event_type", "path", {"user_id": F.col("user_id"), "extracted_score": F.col("value")})


@query("""WITH r AS (SELECT *, CASE WHEN value > 110 THEN 1 ELSE 0 END AS odd, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 3 = 1 THEN '2020-' || lpad((event_id % 12 + 1)::VARCHAR, 2, '0') || '-01' ELSE '1970-01-01' END AS d FROM events)
SELECT user_id, event_type, event_id, d AS reported, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY odd, d DESC, event_id) AS i FROM r) WHERE i = 1""")
def v15_best_reports(read):
    e = F.col("event_id")
    month = F.concat(F.lit("20"), F.lpad((e % 12 + 1).cast("string"), 2, "0"), F.lit(".00001"))
    date = papers.report_date(F.when(e % 3 == 0, F.date_format("ts", "yyyy-MM-dd")), F.when(e % 3 == 1, month))
    rows = read("events").withColumn("reported", date)
    return papers.best_reports(rows, ["user_id", "event_type"], F.col("value"), F.lit(100.0), F.col("reported"), e).select("user_id", "event_type", "event_id", "reported", "value")
