"""Scalar functions bound to text and number columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import normalize as n
from tallyloom.functions import presence as p
from tallyloom.functions import textmeta as t
from tallyloom.plans import query

#: Text with settings in it, which the tables lack.
SHOT_TEXT = "concat(p_size, '-shot ', p_type)"


def shot_text():
    return F.concat(F.col("p_size").cast("string"), F.lit("-shot "), F.col("p_type"))


@query("SELECT p_partkey, p_size AS shots FROM part")
def f30_shots(read):
    return read("part").select("p_partkey", t.shots(shot_text()).alias("shots"))


@query("SELECT p_partkey, (p_size / 100.0)::DOUBLE AS temperature, true AS cot FROM part")
def f30_temperature(read):
    text = F.concat(F.lit("CoT, temperature="), (F.col("p_size") / 100).cast("string"))
    return read("part").select("p_partkey", t.temperature(text).alias("temperature"), t.chain_of_thought(text).alias("cot"))


@query("SELECT p_partkey, 'lm-eval-harness' AS harness FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, '' FROM part WHERE p_size % 2 = 1")
def f31_harness(read):
    return read("part").select("p_partkey", t.harness(F.when(F.col("p_size") % 2 == 0, "run with LM_Eval and vllm").otherwise("own scripts")).alias("harness"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN p_size::DOUBLE END AS rating FROM part")
def f35_rating(read):
    return read("part").select("p_partkey", t.rating(F.concat(F.lit("I say [["), F.col("p_size").cast("string"), F.lit("]]"))).alias("rating"))


@query("SELECT p_partkey, p_size::DOUBLE AS number FROM part")
def f36_number(read):
    return read("part").select("p_partkey", t.final_number(F.concat(F.lit("so 1,234 or\n#### "), F.col("p_size").cast("string"))).alias("number"))


@query("SELECT p_partkey, p_size::VARCHAR AS strict, p_size::VARCHAR AS last_number, NULL::VARCHAR AS boxed, '17' AS answer_is, p_size::VARCHAR AS flexible FROM part")
def f37_answers(read):
    text = F.concat(F.lit("The answer is 17\n#### "), F.col("p_size").cast("string"))
    return read("part").select("p_partkey", t.answers(text).alias("a")).select("p_partkey", "a.*")


@query("SELECT doc_id, try_cast(source AS DOUBLE) AS plain, n_chars::DOUBLE AS number, n_chars / 2.0::DOUBLE AS percent FROM documents")
def f11_fnum(read):
    half = F.concat((F.col("n_chars") / 2).cast("string"), F.lit("%"))
    return read("documents").select("doc_id", n.number(F.col("source")).alias("plain"), n.number(F.col("n_chars")).alias("number"), n.percent(half).alias("percent"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d') AS epoch_day, strftime(ts, '%Y-%m-%d') AS iso FROM events")
def f13_f15_dates(read):
    e = read("events")
    return e.select("event_id", n.stamp_day(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("day"), n.stamp_day(F.unix_timestamp("ts").cast("string")).alias("epoch_day"), n.iso_date(F.date_format("ts", "yyyyMMdd")).alias("iso"))


@query("SELECT event_id, round(CASE WHEN value <= 1 THEN value * 100 ELSE value END, 6) AS pct, round(CASE WHEN value > 1 THEN value / 100 ELSE value END, 6) AS fraction, round(value / 500, 6) AS position, CASE WHEN value <= 1 THEN 1.0 WHEN value <= 100 THEN 100.0 END::DOUBLE AS scale FROM events")
def f16_f20_scales(read):
    v = F.col("value")
    return read("events").select("event_id", n.as_percent(v).alias("pct"), n.as_fraction(v).alias("fraction"), n.to_fraction(v, F.lit(0.0), F.lit(500.0)).alias("position"), n.guess_scale(v, F.lit("accuracy")).alias("scale"))


@query("SELECT event_id, CASE WHEN value = 0 THEN 'exact' WHEN value / 500 < 0.005 THEN 'rounding' WHEN value / 500 < 0.02 THEN 'minor' WHEN value / 500 < 0.1 THEN 'significant' ELSE 'major' END AS severity FROM events")
def f21_severity(read):
    return read("events").select("event_id", n.severity(F.col("value") / 500).alias("severity"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'openai' WHEN p_brand = 'Brand#11' THEN 'google' ELSE 'unknown' END AS developer FROM part")
def f26_developer(read):
    name = F.when(F.col("p_brand") == "Brand#11", "gemma-x").otherwise("other")
    return read("part").select("p_partkey", n.developer(name, F.when(F.col("p_size") % 2 == 0, "OpenAI Inc")).alias("developer"))


@query("SELECT p_partkey, concat(p_size, 'B-x-y') AS name, concat('openai/gpt_', p_size, 'b') AS id FROM part")
def f27_model_ids(read):
    size = F.col("p_size").cast("string")
    return read("part").select("p_partkey", n.model_name(F.concat(size, F.lit("b-x_y"))).alias("name"), n.model_id(F.concat(F.lit("gpt_"), size, F.lit("b")), F.lit("")).alias("id"))


@query("SELECT p_partkey, 'a/b,c' AS pretrained, p_size::VARCHAR AS size FROM part")
def f29_model_args(read):
    args = n.model_args(F.concat(F.lit("pretrained=a/b,c,size="), F.col("p_size").cast("string")))
    return read("part").select("p_partkey", args["pretrained"].alias("pretrained"), args["size"].alias("size"))


@query("SELECT page_id, regexp_extract_all(url, '[0-9]+')[1] AS first_digits, sha256(url) AS hash FROM pages WHERE regexp_matches(url, '[0-9]')")
def f32_f38_ids(read):
    rows = read("pages").where(F.col("url").rlike("[0-9]"))
    return rows.select("page_id", F.regexp_extract("url", "([0-9]+)", 1).alias("first_digits"), F.sha2("url", 256).alias("hash"))


@query("SELECT doc_id, contains(lower(text), lower(lang)) AS found FROM documents WHERE length(lang) < 4 AND NOT regexp_matches(lang, '[-_]')")
def f40_value_in_text(read):
    return read("documents").select("doc_id", t.value_in_text(F.col("lang"), F.col("text")).alias("found"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS at FROM embeddings")
def f45_argmax(read):
    return read("embeddings").select("vec_id", t.argmax(F.col("embedding")).alias("at"))


@query("""SELECT doc_id, lower(trim(source)) NOT IN ('', 'unknown', 'nan') AS present, NOT trim(lang) IN ('', 'standard') AS prompt, toxic IS NOT NULL AS recorded, coalesce(toxic, 0) <> 0 AS truthy, coalesce(quality::VARCHAR, '') IN ('1') AS yes
FROM documents LEFT JOIN labels USING (doc_id)""")
def f01_f08_presence(read):
    rows = read("documents").join(read("labels"), "doc_id", "left")
    return rows.select("doc_id", p.present(F.col("source")).alias("present"), p.prompt_present(F.col("lang")).alias("prompt"), p.aggregate_present(F.col("toxic")).alias("recorded"), p.truthy_present(F.col("toxic")).alias("truthy"), p.truthy(F.col("quality")).alias("yes"))


@query("SELECT a.p_partkey, a.p_name = b.p_name AS same FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE list_sort(string_split(lower(a.p_name), ' ')) = list_sort(string_split(lower(b.p_name), ' '))")
def f42_fuzzy_title(read):
    a, b = read("part").select("p_partkey", "p_name"), read("part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return a.join(b, "p_partkey").where(t.same_words(F.col("p_name"), F.col("other"))).select("p_partkey", (F.col("p_name") == F.col("other")).alias("same"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(left(text, 200), '...') ELSE text END AS summary FROM documents")
def f50_summary(read):
    return read("documents").select("doc_id", t.summary(F.col("text")).alias("summary"))


@query()
def s07_multi_json(read):
    from tallyloom.sources.readers import raw_objects

    return read("events").select("event_id", F.size(raw_objects(F.concat("props", "props"))).cast("long").alias("objects"))


@query()
def s21_headings(read):
    from tallyloom.sources.readers import headings

    return read("pages").select("page_id", headings(F.col("html")).alias("headings"))


@query()
def d03_canonical_json(read):
    from tallyloom.operators.relations import content_hash, duplicate_groups

    return duplicate_groups(read("events"), content_hash(F.col("props")), "event_id")
