"""Queries of the converters: line items, orders, events and conversations stand for the logs of evaluation harnesses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import converters as c
from tallyloom.operators import records
from tallyloom.plans import query

TASKS = "map<string,map<string,variant>>"


def texts(**values):
    """A map<string,string> column."""
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'plain' ELSE 'plain,text' END AS tasks FROM lineitem WHERE l_linenumber % 3 > 0
UNION ALL SELECT l_orderkey, l_linenumber::BIGINT, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'text' END FROM lineitem WHERE l_linenumber % 3 = 0""")
def c01_leaf_tasks(read):
    n = F.col("l_linenumber")
    log = F.concat(
        F.lit('{"group": {"alias": "group", " ": " "}, "plain": {"alias": "p", "acc,none": '), F.when(n % 3 > 0, F.col("l_linenumber").cast("string")).otherwise(F.lit('"N/A"')),
        F.lit(', "acc_stderr,none": 0.1}, "text": {"sample_count": 3, "f1,none": '), F.when(n % 2 == 0, F.lit('"0.5"')).otherwise(F.lit("0.5")), F.lit("}}"),
    )
    tasks = c.leaf_tasks(F.from_json(log, TASKS))
    return read("lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.array_sort(F.map_keys(tasks)), ",").alias("tasks"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN -1 WHEN 3 THEN 0 WHEN 4 THEN 0 END)::DOUBLE AS least,
(CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 100 END)::DOUBLE AS most FROM lineitem""")
def c02_bounds(read):
    metric = F.element_at(F.array(*map(F.lit, ("acc", "mcc", "bleu", "ter", "perplexity", "word", "byte"))), F.col("l_linenumber"))
    return read("lineitem").select("l_orderkey", "l_linenumber", c.bounds(metric).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'org/m' || c_nationkey ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'org' END AS developer,
CASE WHEN c_custkey % 3 = 1 THEN 'together' END AS platform, CASE WHEN c_custkey % 3 = 0 THEN 'transformers' END AS engine, c_mktsegment AS dtype,
CASE WHEN c_custkey % 2 = 0 THEN 'pretrained=org/m' || c_nationkey || ',dtype=auto' END AS args FROM customer""")
def c03_model(read):
    kind = F.when(F.col("c_custkey") % 3 == 0, "hf").when(F.col("c_custkey") % 3 == 1, "together").otherwise("dummy")
    args = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("pretrained=org/m"), F.col("c_nationkey").cast("string"), F.lit(",dtype=auto"))).otherwise(F.lit(""))
    m = c.harness_model(kind, args, F.col("c_name"), texts(model_dtype=F.col("c_mktsegment"), model_sha=F.lit("")))
    return read("customer").select("c_custkey", m.alias("m")).select("c_custkey", "m.name", "m.developer", F.col("m.inference_platform").alias("platform"), F.col("m.inference_engine.name").alias("engine"), F.col("m.additional_details")["dtype"].alias("dtype"), F.col("m.additional_details")["model_args"].alias("args"))


@query("""SELECT o_orderkey, o_orderstatus AS dataset, CASE WHEN o_orderkey % 3 = 0 THEN 'hf_dataset' ELSE 'other' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'org/' || o_orderstatus END AS repo,
CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'test' ELSE 'validation' END END AS split FROM orders""")
def c04_source(read):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    path = F.when(k % 3 == 0, F.concat(F.lit("org/"), s)).when(k % 3 == 1, F.concat(F.lit("/data/"), s)).otherwise(s)
    config = texts(dataset_path=path, test_split=F.when(k % 2 == 0, "test").otherwise(""), validation_split=F.lit("validation"))
    d = c.harness_source(config, s)
    return read("orders").select("o_orderkey", d.alias("d")).select("o_orderkey", F.col("d.dataset_name").alias("dataset"), F.col("d.source_type").alias("kind"), F.col("d.hf_repo").alias("repo"), F.col("d.hf_split").alias("split"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_tax, 6) AS temperature, 16 * l_linenumber::BIGINT AS max_tokens, l_returnflag AS stop, CASE WHEN l_linenumber > 2 THEN l_linenumber::VARCHAR END AS shots FROM lineitem""")
def c05_generation(read):
    kwargs = texts(temperature=F.col("l_tax"), max_gen_toks=F.col("l_linenumber") * 16, until=F.col("l_returnflag"))
    g = c.harness_generation(kwargs, F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")))
    return read("lineitem").select("l_orderkey", "l_linenumber", g.alias("g")).select("l_orderkey", "l_linenumber", "g.generation_args.temperature", "g.generation_args.max_tokens", F.col("g.additional_details")["until"].alias("stop"), F.try_element_at("g.additional_details", F.lit("num_fewshot")).alias("shots"))


@query("""SELECT l_orderkey::VARCHAR AS sample_id, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'task/strict' ELSE 'task' END AS name,
(CASE l_linenumber % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.5 END)::DOUBLE AS score, l_linenumber % 3 = 1 AS correct, l_returnflag AS reference FROM lineitem""")
def c06_samples(read):
    n = F.col("l_linenumber")
    body = F.concat(
        F.lit('{"metrics": ["note", "acc"], "note": "1.0", "doc_id": '), F.col("l_orderkey").cast("string"), F.lit(', "target": "'), F.col("l_returnflag"), F.lit('", "filter": "'), F.when(n % 2 == 0, "strict").otherwise("none"),
        F.lit('"'), F.when(n % 3 == 1, ', "acc": 1}').when(n % 3 == 2, ', "acc": 0.5}').otherwise("}"),
    )
    s = c.harness_sample(F.from_json(body, "map<string,variant>"), F.lit("task"), F.lit("prompt"), F.lit("answer"))
    return read("lineitem").select(n, s.alias("s")).select("l_linenumber", "s.sample_id", F.col("s.evaluation_name").alias("name"), "s.evaluation.score", F.col("s.evaluation.is_correct").alias("correct"), F.col("s.input.reference")[0].alias("reference"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 'match' AS scorer, m.metric, round(CASE m.metric WHEN 'accuracy' THEN l_discount ELSE l_quantity END, 6) AS value, round(l_tax, 6) AS stderr, round(l_quantity, 6) AS stddev
FROM lineitem, (VALUES ('accuracy'), ('std')) m(metric)""")
def c07_scorers(read):
    metric = lambda name, v: (F.lit(name), F.struct(F.lit(name).alias("name"), F.col(v).alias("value")))
    found = F.create_map(*metric("accuracy", "l_discount"), *metric("stderr", "l_tax"), *metric("std", "l_quantity"))
    rows = c.scorer_results(F.array(F.struct(F.lit("").alias("name"), F.lit("match").alias("scorer"), found.alias("metrics"))))
    return read("lineitem").select("l_orderkey", "l_linenumber", F.explode(rows).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query("""SELECT conv_id, turn::BIGINT AS turn, role, text AS content, CASE WHEN role = 'assistant' THEN 'why' END AS thought, (role = 'assistant')::BIGINT AS calls, CASE WHEN role = 'user' THEN 'id' || turn END AS answers FROM conversations""")
def c08_messages(read):
    part = lambda kind, text, why: F.struct(F.lit(kind).alias("type"), text.alias("text"), why.alias("reasoning"))
    nothing, speaks = F.lit(None).cast("string"), F.col("role") == "assistant"
    parts = F.when(speaks, F.array(part("text", F.lit("draft"), nothing), part("reasoning", nothing, F.lit("why")), part("text", F.col("text"), nothing)))
    call = F.array(F.struct(F.lit("c").alias("id"), F.lit("f").alias("function"), texts(x=F.col("turn")).alias("arguments")))
    one = F.struct("role", F.col("text").alias("content"), parts.alias("parts"), call.alias("tool_calls"), F.concat(F.lit("id"), F.col("turn").cast("string")).alias("tool_call_id"))
    m = c.messages(F.array(one))[0]
    return read("conversations").select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", "m.role", "m.content", F.col("m.reasoning_trace").alias("thought"), F.size("m.tool_calls").alias("calls"), F.col("m.tool_call_id")[0].alias("answers"))


@query("""SELECT p_partkey, n.i::BIGINT AS i, p_brand || n.i AS name, CASE n.i WHEN 1 THEN p_type END AS kind FROM part, (VALUES (1), (2)) n(i) WHERE p_partkey % 2 = 0""")
def c09_tools(read):
    tool = lambda i, params: F.struct(F.concat(F.col("p_brand"), F.lit(str(i))).alias("name"), F.lit("d").alias("description"), params.alias("params"))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    step = F.struct(F.when(F.col("p_partkey") % 2 == 0, "use_tools").otherwise("generate").alias("solver"), F.array(F.array(tool(1, texts(kind=F.col("p_type"))), tool(2, empty)), F.array(tool(3, empty))).alias("tools"))
    rows = read("part").select("p_partkey", F.posexplode(c.available_tools(F.array(step))).alias("i", "t"))
    return rows.select("p_partkey", (F.col("i") + 1).alias("i"), "t.name", F.col("t.parameters")["kind"].alias("kind"))


@query("""SELECT o_orderkey, 'exact_match ' || o_orderstatus || ' on ' || o_orderpriority AS name, round(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice / 4 END, 6) AS score FROM orders
UNION ALL SELECT o_orderkey, 'Basic on ' || o_orderpriority, 0.0 FROM orders""")
def c10_stats(read):
    price, none = F.col("o_totalprice"), F.lit(None).cast("string")

    def stat(name, split, changed, n, total, mean):
        return F.struct(F.lit(name).alias("name"), split.alias("split"), changed.alias("perturbation"), F.lit(n).alias("count"), total.alias("sum"), mean.alias("mean"), F.lit(0.0).alias("stddev"))

    stats = F.array(
        stat("exact_match", F.col("o_orderstatus"), none, 4, price, F.when(F.col("o_orderkey") % 2 == 0, price).otherwise(0.0)), stat("exact_match", none, F.lit("typos"), 1, price, price),
        stat("Basic", F.lit(""), none, 0, F.lit(0.0), none.cast("double")), stat("other", none, none, 1, price, price),
    )
    spec = lambda name, names: F.struct(F.lit(name).alias("class_name"), names.cast("array<string>").alias("names"))
    metrics = c.run_metrics(F.array(spec("a.b.Basic", F.array()), spec("a.b.Other", F.array(F.lit("exact_match"))), spec("x", F.array(F.lit("exact_match")))))
    rows = read("orders").select("o_orderkey", F.explode(c.stat_results(stats, metrics, F.col("o_orderpriority"))).alias("r"))
    return rows.select("o_orderkey", F.col("r.evaluation_name").alias("name"), "r.score")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_tax, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) = 1)
SELECT o_orderkey::VARCHAR AS sample_id, sha256(o_orderpriority || o_orderstatus) AS sample_hash, round(CASE WHEN f.l_orderkey IS NULL THEN 0.0 WHEN o_orderkey % 2 = 0 THEN l_tax ELSE 0.5 END, 6) AS score,
CASE WHEN f.l_orderkey IS NOT NULL THEN l_quantity::BIGINT END AS tokens, o_orderstatus AS answer FROM orders LEFT JOIN f ON o_orderkey = f.l_orderkey""")
def c11_instances(read):
    ref = lambda text, *tags: F.struct(text.alias("text"), F.array(*map(F.lit, tags)).cast("array<string>").alias("tags"))
    status = F.col("o_orderstatus")
    states = read("orders").select(F.col("o_orderkey").alias("instance_id"), F.col("o_orderpriority").alias("prompt"), F.array(ref(F.lit("none")), ref(status, "correct")).alias("references"), F.array(F.concat(F.lit(" "), status), F.lit("wrong")).alias("completions"), F.lit(0.5).alias("request_time"))
    stat = lambda name, mean, total: F.struct(name.alias("name"), mean.alias("mean"), total.alias("sum"))
    exact = F.when(F.col("l_orderkey") % 2 == 0, "exact_match").otherwise("other")
    stats = read("lineitem").select(F.col("l_orderkey").alias("instance_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax").alias("at"), F.array(stat(exact, F.col("l_tax"), F.lit(0.0)), stat(F.lit("num_prompt_tokens"), F.lit(0.0), F.col("l_quantity").cast("double"))).alias("stats"))
    return c.instance_rows(states, stats).select("sample_id", "sample_hash", "score", F.col("token_usage.total_tokens").alias("tokens"), F.col("extracted_value").alias("answer"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE / 100 END AS temperature, p_size % 3 = 0 AS reasoning, CASE WHEN p_size % 5 = 0 THEN 3 ELSE p_size::BIGINT END AS attempts, 'docker' AS sandbox, (CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END)::BIGINT AS options FROM part""")
def c18_agent(read):
    n = F.col("p_size")
    options = texts(temperature=F.when(n % 2 == 0, n / 100), reasoning_effort=F.when(n % 3 == 0, "high").otherwise("None"), max_retries=F.lit(3))
    g = c.agent_generation(options, F.array(F.struct("p_brand")), F.array(F.lit("docker")), F.when(n % 5 == 0, 0).otherwise(n))
    return read("part").select("p_partkey", g.alias("g")).select("p_partkey", "g.temperature", "g.reasoning", F.col("g.max_attempts").alias("attempts"), F.col("g.sandbox.type").alias("sandbox"), F.size("g.additional_details").alias("options"))


@query("""SELECT c_custkey, 'a:' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ',b:1' ELSE '' END AS version, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE CASE WHEN c_custkey % 2 = 0 THEN 'org/' ELSE '' END || 'seen' END AS model,
CASE WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 0 THEN 'org' ELSE 'unknown' END AS provider FROM customer""")
def c19_versions(read):
    k, name = F.col("c_custkey"), F.col("c_name")
    path = F.when((k % 2 == 0) & (k % 3 > 0), F.concat(F.lit("org/"), name)).otherwise(name)
    seen = F.when(k % 3 > 0, "seen")
    version = c.library_version(texts(a=F.col("c_mktsegment"), b=F.when(k % 2 == 0, "1").otherwise("")))
    return read("customer").select("c_custkey", version.alias("version"), c.sampled_model(path, seen).alias("model"), c.sampled_model_info(path, seen)["provider"].alias("provider"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'scenario' WHEN 1 THEN o_orderstatus WHEN 2 THEN 'mmlu' ELSE 'plain' END AS dataset, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 2.0::DOUBLE END AS first_time,
CASE WHEN o_orderkey % 2 = 0 THEN '1993-01-01' ELSE o_orderdate::DATE::VARCHAR END AS stamp FROM orders""")
def f48_run_dataset(read):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate").cast("string")
    spec = F.when(k % 4 == 1, F.concat(F.lit("lsat:model=x,dataset="), F.col("o_orderstatus"), F.lit(",k=1"))).when(k % 4 == 2, "mmlu:subject=law").when(k % 4 == 3, "plain").otherwise("any:dataset=x")
    return read("orders").select("o_orderkey", c.run_dataset(spec, F.when(k % 4 == 0, "scenario")).alias("dataset"), c.run_time(F.array(F.lit(None).cast("double"), F.lit(0.0), F.when(k % 4 > 0, k * 2.0), F.when(k % 4 > 0, k * 3.0))).alias("first_time"), c.stamped(day, k % 2 == 0, F.lit("1993-01-01")).alias("stamp"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '{"a": {"b": ' || doc_id || '}}' END AS body FROM documents""")
def f43_first_object(read):
    k = F.col("doc_id")
    body = F.concat(F.lit('{"a": {"b": '), k.cast("string"), F.when(k % 3 == 0, "}").otherwise("}}"))
    return read("documents").select("doc_id", c.first_object(F.concat(F.lit("So:\n```json\n"), body, F.lit("\n```\nand } more {"))).alias("body"))


@query("""SELECT o_orderkey, t.task AS benchmark, CASE WHEN o_orderkey % 2 = 0 THEN 'org/m' ELSE 'unknown' END AS model_id, CASE t.task WHEN 'a' THEN '5' ELSE 'unknown' END AS n_shot,
CASE t.task WHEN 'a' THEN 'acc,none' ELSE 'unknown' END AS metric, CASE t.task WHEN 'a' THEN round(o_totalprice, 6) END AS score, CASE t.task WHEN 'a' THEN 'sha256:' || sha256('Q:' || chr(10) || 'A:') ELSE 'unknown' END AS prompt FROM orders, (VALUES ('a'), ('b')) t(task)""")
def p19_eval_specs(read):
    price = F.col("o_totalprice").cast("double")
    config = F.create_map(F.lit("a"), F.struct(F.lit("multiple_choice").alias("output_type"), F.lit(5).alias("num_fewshot"), F.lit("Q: \nA: \n").alias("doc_to_text")))
    logs = read("orders").withColumn("tasks", F.create_map(F.lit("a"), F.create_map(F.lit("acc,none"), price), F.lit("b"), F.create_map(F.lit("alias"), price)))
    logs = logs.withColumn("model", F.when(F.col("o_orderkey") % 2 == 0, "org/m").otherwise("")).withColumn("configs", config)
    return c.eval_specs(logs.select("o_orderkey", "model", "tasks", "configs"), F.col("model"), texts(lm_eval_version=F.lit("0.4")), "tasks", F.col("configs"), texts(a=F.lit(1)), keep=["o_orderkey"]).select("o_orderkey", "benchmark", "model_id", "n_shot", "metric", "score", F.col("prompt_template_hash").alias("prompt"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'name: no such model' ELSE '' END || CASE WHEN p_partkey % 6 = 0 THEN '; ' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'metric: absent' ELSE '' END AS missing FROM part""")
def v16_unsupported(read):
    k = F.col("p_partkey")
    values = {"name": F.when(k % 2 == 0, "no such model").otherwise(F.upper("p_name")), "metric": F.when(k % 3 == 0, "absent"), "score": F.lit(None).cast("string")}
    return read("part").select("p_partkey", F.array_join(c.unsupported(values, F.concat_ws(" ", "p_name", "p_brand")), "; ").alias("missing"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'error') AND event_type NOT IN ('error') GROUP BY ALL""")
def p06_sources(read):
    return records.of_sources(read("events"), "event_type", ["view", "click", "error"], ("error",)).groupBy("event_type").agg(F.count("*").alias("n"))
