"""Coverage, collisions, joins, windows, sets, records and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import presence
from tallyloom.functions.normalize import norm_bench
from tallyloom.functions.textmeta import interaction
from tallyloom.operators import collisions, coverage, effects, records, relations
from tallyloom.plans import query

LABELLED = "documents d LEFT JOIN labels l USING (doc_id)"
CELL = "user_id, CAST(ts AS DATE) AS day, event_type, value, event_id"


def labelled(read):
    return read("documents").join(read("labels"), "doc_id", "left")


def events(read):
    return read("events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value", "event_id")


def fields():
    return {"quality": F.col("quality").isNotNull(), "toxic": presence.present(F.col("toxic")), "cot": presence.is_cot(F.lit("0"), F.col("text"))}
FIELD_SQL = """coalesce(avg((quality IS NOT NULL)::DOUBLE) * 100, 0) AS quality, coalesce(avg((toxic IS NOT NULL)::DOUBLE) * 100, 0) AS toxic,
  coalesce(avg((contains(lower(text), 'chain') OR contains(lower(text), 'cot'))::DOUBLE) * 100, 0) AS cot"""


@query(f"SELECT n, round(quality, 6) AS quality, round(toxic, 6) AS toxic, round(cot, 6) AS cot FROM (SELECT count(*) AS n, {FIELD_SQL} FROM {LABELLED})")
def g01_coverage(read):
    return coverage.coverage(labelled(read), fields())


@query(f"SELECT source, n, round(quality, 6) AS quality, round(toxic, 6) AS toxic, round(cot, 6) AS cot FROM (SELECT source, count(*) AS n, {FIELD_SQL} FROM {LABELLED} GROUP BY source)")
def g02_per_source(read):
    return coverage.coverage_by(labelled(read), "source", fields())


@query("SELECT o_orderpriority AS source, count(*) AS n, count(DISTINCT o_custkey) AS models, count(DISTINCT l_partkey) AS benchmarks FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ROLLUP (o_orderpriority)")
def g03_composition(read):
    rows = read("orders").join(read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("source"), "o_custkey", "l_partkey")
    return coverage.composition(rows, "source", {"models": "o_custkey", "benchmarks": "l_partkey"})


@query(f"SELECT lang, count(*) AS total, count(quality) AS quality, count(toxic) AS toxic FROM {LABELLED} GROUP BY lang")
def g04_by_benchmark(read):
    return coverage.field_counts(labelled(read), "lang", {k: fields()[k] for k in ("quality", "toxic")})


@query(f"SELECT source, n, round(quality, 6) AS quality, round(toxic, 6) AS toxic, round(cot, 6) AS cot FROM (SELECT source, count(*) AS n, {FIELD_SQL} FROM {LABELLED} GROUP BY source) ORDER BY n DESC, source")
def g05_audit(read):
    return coverage.audit(labelled(read), "source", fields())


CELLS = f"WITH e AS (SELECT {CELL} FROM events), c AS (SELECT user_id, day, count(DISTINCT event_type) AS sources, CASE WHEN count(value) >= 2 THEN max(value) - min(value) END AS spread, bool_or(value < 5) AS missing, bool_or(value < 50) AS unscored FROM e GROUP BY user_id, day)"


def cells(read):
    return collisions.cells(events(read), ["user_id", "day"], "event_type", "value", F.col("value") < 5, F.col("value") < 50)


@query(CELLS + " SELECT count(*) AS pairs, count(*) FILTER (sources >= 2) AS collisions, count(*) FILTER (sources >= 2 AND spread > 1) AS differ_small, count(*) FILTER (sources >= 2 AND spread > 5) AS differ_large, count(*) FILTER (sources >= 2 AND spread > 1 AND missing) AS harness_missing, count(*) FILTER (sources >= 2 AND spread > 1 AND unscored) AS scoring_missing FROM c")
def g06_prevalence(read):
    return collisions.prevalence(cells(read))


GAPS = f"WITH e AS (SELECT {CELL} FROM events), g AS (SELECT user_id, day, arg_min(value, event_id) FILTER (event_type = 'view') AS own, median(value) FILTER (event_type <> 'view') AS others FROM e GROUP BY user_id, day), gaps AS (SELECT user_id, day, others - own AS gap FROM g WHERE own IS NOT NULL AND others IS NOT NULL)"


def gaps(read):
    return collisions.reference_gaps(events(read), ["user_id", "day"], "event_type", "value", "view", "event_id")


@query(GAPS + " SELECT user_id, day, round(gap, 6) AS gap FROM gaps")
def g07_gaps(read):
    return gaps(read)


@query(GAPS + " SELECT count(*) AS n, count(*) FILTER (gap > 0) AS positive, round(median(gap), 6) AS median FROM gaps")
def g08_gap_summary(read):
    return collisions.gap_summary(gaps(read))


@query(f"SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, round(avg((quality IS NOT NULL)::DOUBLE) * 100, 6) AS quality FROM {LABELLED}")
def g09_fill(read):
    return coverage.fill_and_distinct(labelled(read), {"langs": "lang", "sources": "source"}, {"quality": fields()["quality"]})


@query(f"SELECT round(avg((quality IS NOT NULL)::DOUBLE) * 100, 6) AS non_null FROM {LABELLED}")
def g10_non_null(read):
    return coverage.non_null_share(labelled(read), "quality")


@query("""WITH x AS (SELECT source, CASE WHEN n_chars % 3 = 0 THEN 'recall' ELSE 'score' END AS kind, quality = 1 AS ok FROM documents JOIN labels USING (doc_id)),
y AS (SELECT source, count(*) FILTER (kind = 'score') AS scores, count(*) FILTER (kind = 'score' AND ok) AS correct, count(*) FILTER (kind = 'recall' AND ok) AS captured, count(*) FILTER (kind = 'recall' AND NOT ok) AS missed FROM x GROUP BY source)
SELECT source, scores, correct, captured, missed, round(correct * 100.0::DOUBLE / nullif(scores, 0), 6) AS "precision", round(captured * 100.0::DOUBLE / nullif(captured + missed, 0), 6) AS recall FROM y""")
def g11_precision_recall(read):
    rows = read("documents").join(read("labels"), "doc_id")
    return coverage.score_audit(rows, F.when(F.col("n_chars") % 3 == 0, "recall"), F.col("quality") == 1, "source")


@query(f"""WITH x AS (SELECT coalesce(quality = 1, false) AS a, coalesce(toxic = 0, false) AS named, n_chars % 2 = 0 AS ok FROM {LABELLED})
SELECT count(*) FILTER (a) AS attributable, count(*) FILTER (a AND named AND ok) AS correct, count(*) FILTER (a AND NOT named) AS missed, count(*) FILTER (named AND NOT ok) AS wrong, count(*) FILTER (NOT a AND NOT named) AS abstained FROM x""")
def g12_confusion(read):
    no = F.lit(False)
    return coverage.confusion(labelled(read), F.coalesce(F.col("quality") == 1, no), F.coalesce(F.col("toxic") == 0, no), F.col("n_chars") % 2 == 0)


@query("SELECT lang, source, grouping_id(lang, source) AS level, count(*) AS n, count(*) FILTER (n_chars > 1000) AS correct FROM documents GROUP BY GROUPING SETS ((), (lang), (source))")
def g13_grouping_sets(read):
    return coverage.grouped_audit(read("documents"), F.col("n_chars") > 1000, "lang", "source")


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(min(c_acctbal), 6) AS least, round(max(c_acctbal), 6) AS most FROM customer GROUP BY c_mktsegment")
def g15_stats(read):
    return coverage.ranges(read("customer"), ["c_mktsegment"], "c_acctbal")


@query("WITH a AS (SELECT event_type, user_id, max(value) - min(value) AS spread FROM events GROUP BY event_type, user_id) SELECT event_type, count(*) AS n, round(avg(spread), 6) AS mean, round(max(spread), 6) AS most FROM a GROUP BY event_type")
def g16_range(read):
    return effects.spread_summary(read("events"), ["event_type", "user_id"], ["event_type"], "value")


@query("WITH a AS (SELECT l_returnflag, l_linestatus, l_suppkey, max(l_quantity) - min(l_quantity) AS d FROM lineitem GROUP BY ALL HAVING count(*) >= 2) SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(d), 6) AS mean FROM a GROUP BY ALL")
def g17_axis(read):
    return effects.spread_summary(read("lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"], ["l_returnflag", "l_linestatus"], "l_quantity", least=2).drop("most")


LAST = "l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY ALL)"


@query(f"WITH {LAST} SELECT a.user_id % 7 AS part, count(*) AS n, round(avg(abs(a.v - b.v)), 6) AS mean FROM l a JOIN l b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL")
def g18_any(read):
    parts = read("events").withColumn("part", F.col("user_id") % 7)
    return effects.mismatch_any(parts, ["part", "user_id"], "event_type", "event_id", "value", ["part"])


@query(f"WITH {LAST} SELECT a.user_id % 7 AS part, count(*) AS n, round(avg(abs(a.v - b.v)), 6) AS mean FROM l a JOIN l b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' GROUP BY ALL")
def g18_mismatch(read):
    parts = read("events").withColumn("part", F.col("user_id") % 7)
    return effects.mismatch(parts, ["part", "user_id"], "event_type", "event_id", "value", "view", "click", ["part"])


@query("""WITH t AS (SELECT lower(r_name) AS p, r_regionkey AS v FROM region UNION ALL SELECT lower(n_name), 100 + n_nationkey FROM nation),
n AS (SELECT n_nationkey, 'x-' || lower(n_name) AS name FROM nation UNION ALL SELECT 100 + r_regionkey, 'y' || lower(r_name) FROM region UNION ALL SELECT 200 + r_regionkey, r_name || '/z' FROM region),
m AS (SELECT n_nationkey, name, v, row_number() OVER (PARTITION BY n_nationkey ORDER BY length(p) DESC, p, v) AS i FROM n JOIN t ON starts_with(lower(name), p) OR contains(lower(name), '-' || p) OR contains(lower(name), '/' || p))
SELECT n.n_nationkey::BIGINT AS n_nationkey, n.name, m.v::BIGINT AS v FROM n LEFT JOIN m ON n.n_nationkey = m.n_nationkey AND m.i = 1""")
def j05_prefix_lookup(read):
    table = read("region").select(F.lower("r_name").alias("p"), F.col("r_regionkey").cast("long").alias("v")).unionByName(read("nation").select(F.lower("n_name").alias("p"), (100 + F.col("n_nationkey")).cast("long").alias("v")))
    key = lambda c, plus: (F.col(c) + plus).cast("long").alias("n_nationkey")
    names = read("nation").select(key("n_nationkey", 0), F.concat(F.lit("x-"), F.lower("n_name")).alias("name"))
    names = names.unionByName(read("region").select(key("r_regionkey", 100), F.concat(F.lit("y"), F.lower("r_name")).alias("name"))).unionByName(read("region").select(key("r_regionkey", 200), F.concat("r_name", F.lit("/z")).alias("name")))
    return effects.longest_within(names, "name", table, "p", "v")


@query(f"WITH {LAST}, p AS (SELECT user_id, max(v) FILTER (event_type = 'view') AS a, max(v) FILTER (event_type = 'click') AS b FROM l GROUP BY user_id) SELECT count(*) AS n, round(max(abs(a - b)), 6) AS gap FROM p WHERE a IS NOT NULL AND b IS NOT NULL")
def g19_mode_gap(read):
    return effects.mode_gap(read("events"), "user_id", "event_type", "view", "click", "value", "event_id")


@query("WITH m AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY ALL) SELECT c_nationkey, count(*) AS judges, round(max(m) - min(m), 6) AS spread FROM m GROUP BY ALL")
def g21_spread(read):
    return effects.judge_spread(read("customer"), "c_mktsegment", ["c_nationkey"], "c_acctbal")


@query("SELECT c_nationkey, round(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 6) AS building, round(avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 6) AS machinery FROM customer GROUP BY c_nationkey")
def g23_category_pivot(read):
    return effects.category_means(read("customer"), "c_nationkey", "c_mktsegment", {"BUILDING": "building", "MACHINERY": "machinery"}, "c_acctbal").drop("overall")


@query("WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_nationkey) AS rank FROM c) WHERE rank <= 5")
def g24_top5(read):
    return coverage.histogram_top(read("customer"), "c_mktsegment", "c_nationkey")


@query("SELECT l_returnflag, l_linestatus, round(min(l_tax), 6) AS least, round(max(l_tax), 6) AS most, round(avg(l_tax), 6) AS mean, count(l_tax) AS n FROM lineitem GROUP BY ALL")
def g25_ranges(read):
    return coverage.ranges(read("lineitem"), ["l_returnflag", "l_linestatus"], "l_tax")


@query("SELECT unnest(['c_custkey', 'c_mktsegment', 'c_name']) AS name, unnest([(SELECT bool_and(trim(c_custkey::VARCHAR) = '') FROM customer), (SELECT bool_and(trim(c_mktsegment) = '') FROM customer), (SELECT bool_and(trim(c_name) = '') FROM customer)]) AS is_empty")
def g27_empty_columns(read):
    return coverage.empty_columns(read("customer").select("c_custkey", "c_mktsegment", "c_name"))


@query("WITH s AS (SELECT event_type, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events GROUP BY event_type) SELECT first_day, last_day, array_to_string(list_sort(list(event_type)), ',') AS sources, count(*) AS n FROM s GROUP BY ALL")
def g28_spans(read):
    return coverage.day_spans(read("events"), "event_type", F.to_date("ts"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def g29_cross_counts(read):
    return coverage.cross_counts(read("documents"), ["lang", "source"])


@query("SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS papers FROM part GROUP BY ALL")
def g33_counts_with_papers(read):
    return coverage.counts_with_papers(read("part"), "p_brand", "p_type")


@query("SELECT o_custkey, round(avg((o_orderstatus = 'F')::DOUBLE), 6) AS score, count(*) AS n FROM orders GROUP BY ALL")
def g35_instance_rollup(read):
    return coverage.instance_rollup(read("orders"), "o_custkey", (F.col("o_orderstatus") == "F").cast("double"))


@query("WITH c AS (SELECT event_type, user_id, max(value) - min(value) AS s FROM events GROUP BY ALL) SELECT event_type, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(max(s), 6) AS most FROM c GROUP BY ALL")
def g36_seed_spread(read):
    return effects.spread_summary(read("events"), ["event_type", "user_id"], ["event_type"], "value", median=True).drop("n")


@query("SELECT lang, sum(n_chars)::BIGINT AS prompt, sum(length(text))::BIGINT AS completion, nullif(sum(length(text)) - sum(n_chars), 0)::BIGINT AS reasoning FROM documents GROUP BY ALL")
def g37_token_usage(read):
    return coverage.token_usage(read("documents"), "lang", F.col("n_chars"), F.length("text").cast("long"), F.col("n_chars"))


PAIRS = f"WITH e AS (SELECT {CELL} FROM events), p AS (SELECT user_id, day, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM e GROUP BY ALL)"


@query(PAIRS + " SELECT user_id, day, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta FROM p WHERE a IS NOT NULL AND b IS NOT NULL")
def j01_paired_delta(read):
    return relations.paired_delta(events(read), ["user_id", "day"], "event_type", "view", "click", "value")


@query(f"""WITH e AS (SELECT {CELL} FROM events), o AS (SELECT user_id, day, event_type, value, min(event_id) AS r FROM e GROUP BY ALL),
p AS (SELECT a.user_id, a.day, a.r AS row_a, b.r AS row_b, a.event_type AS event_type_a, b.event_type AS event_type_b, a.value AS value_a, b.value AS value_b, abs(a.value / 500 - b.value / 500) AS d FROM o a JOIN o b ON a.user_id = b.user_id AND a.day = b.day AND a.r < b.r AND a.event_type <> b.event_type)
SELECT user_id, day, row_a, row_b, event_type_a, event_type_b, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b, round(d, 6) AS relative_diff, CASE WHEN d = 0 THEN 'exact' WHEN d < 0.005 THEN 'rounding' WHEN d < 0.02 THEN 'minor' WHEN d < 0.1 THEN 'significant' ELSE 'major' END AS severity FROM p""")
def j03_conflicts(read):
    return collisions.conflicts(events(read), ["user_id", "day"], "event_id", "event_type", "value", F.lit(0.0), F.lit(500.0))


@query("WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS norm FROM part) SELECT norm, count(*) AS n, min(name) AS first_name, max(name) AS last_name FROM n GROUP BY norm HAVING count(*) > 1")
def j04_near_dup_names(read):
    return relations.near_names(read("part"), "p_name", F.substring_index("p_name", " ", 1))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def j06_resume_antijoin(read):
    done = read("lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return relations.undone(read("orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j08_left(read):
    return relations.lookup(read("customer").select("c_custkey", "c_nationkey"), read("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")


@query("WITH a AS (SELECT c_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 6) AS bal FROM customer WHERE c_acctbal > 9000 GROUP BY ALL), b AS (SELECT s_nationkey AS k, count(*) AS n, round(max(s_acctbal), 6) AS top FROM supplier GROUP BY ALL) SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, b.n) AS n, bal AS bal_a, top AS top_b FROM a FULL JOIN b ON a.k = b.k")
def j09_full_outer(read):
    a = read("customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("bal"))
    b = read("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.max("s_acctbal").alias("top"))
    return relations.merged(a, b, "k", ["n"])


@query("SELECT r_regionkey, t AS temperature, s AS shots FROM region, (SELECT unnest([0.0, 0.7]) AS t), (SELECT unnest([0, 5]) AS s) WHERE r_name <> 'ASIA'")
def j11_plan_cross(read):
    return relations.plan_grid(read("region").where("r_name <> 'ASIA'").select("r_regionkey"), {"temperature": [0.0, 0.7], "shots": [0, 5]})


@query("WITH h AS (SELECT p_name AS full_name, split_part(p_name, ' ', 1) AS short, max(p_size) AS p_size FROM part GROUP BY ALL), s AS (SELECT short, any_value(p_size) AS v FROM h GROUP BY short HAVING count(DISTINCT full_name) = 1), w AS (SELECT full_name AS name FROM h UNION SELECT short FROM h) SELECT w.name, coalesce(h.p_size, s.v)::BIGINT AS p_size FROM w LEFT JOIN h ON h.full_name = w.name LEFT JOIN s ON s.short = w.name")
def j13_alt_key(read):
    have = read("part").groupBy(F.col("p_name").alias("full"), F.substring_index("p_name", " ", 1).alias("short")).agg(F.max("p_size").alias("p_size"))
    want = have.select(F.col("full").alias("name")).union(have.select("short")).distinct()
    return relations.by_id_or_short_name(want, have, "name", "full", "short", "p_size")


@query("SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY event_type) + (count(*) OVER (PARTITION BY user_id, event_type) - 1) / 2.0::DOUBLE AS rank FROM events")
def w01_avg_rank(read):
    from tallyloom.operators.stats import average_rank

    return read("events").select("user_id", "event_id", average_rank("event_type", "user_id").alias("rank"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value > 10 DESC, ts DESC, event_id) AS k FROM events) WHERE k = 1")
def w03_keep_best(read):
    return relations.keep(read("events"), ["user_id", "event_type"], F.desc(F.col("value") > 10), F.desc("ts"), F.col("event_id")).select("user_id", "event_type", "event_id")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def w04_first(read):
    return relations.first_values(read("events"), ["user_id"], "event_id", ["event_type"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id")
def w05_last(read):
    return relations.last_values(read("events"), ["user_id"], "event_id", ["event_type", "value"])


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS row_id, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS used FROM conversations")
def w06_row_ids(read):
    rows = read("conversations").withColumn("_l", F.length("text"))
    return rows.select("conv_id", "turn", "role", relations.ordinal_rank("role", F.col("conv_id"), F.col("turn")).alias("row_id"), relations.running_total("conv_id", "turn", "_l").alias("used"))


@query("SELECT event_id, round(value, 6) AS value FROM events ORDER BY value DESC, event_id LIMIT 10")
def o01_topk(read):
    return read("events").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "value")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def d01_union(read):
    return read("nation").select(F.col("n_name").alias("name")).unionByName(read("region").select(F.col("r_name").alias("name")), allowMissingColumns=True)


@query("SELECT DISTINCT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def d02_except(read):
    return relations.difference(read("customer").select(F.col("c_nationkey").alias("k")), read("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), ["k"])


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_row FROM documents GROUP BY 1 HAVING count(*) > 1")
def d03_content_hash(read):
    return relations.duplicate_groups(read("documents"), F.sha2("text", 256), "doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, (count(DISTINCT l_quantity) + (count(*) > count(l_quantity))::INT)::BIGINT AS scores, CASE WHEN count(DISTINCT l_quantity) + (count(*) > count(l_quantity))::INT > 1 THEN 'WARNING' ELSE 'INFO' END AS severity FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def d05_dups(read):
    return relations.duplicates_within(read("lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity")


@query("(SELECT n_regionkey AS k, 'a' AS side FROM nation EXCEPT ALL SELECT r_regionkey, 'a' FROM region)")
def d07_same_rows(read):
    return relations.same_rows(read("nation").select(F.col("n_regionkey").alias("k")), read("region").select(F.col("r_regionkey").alias("k")))


@query("SELECT s AS source, r AS row, sev AS severity, msg AS message FROM (SELECT p_brand AS s, p_partkey AS r, unnest([CASE WHEN p_size = 7 AND p_brand = 'Brand#11' THEN NULL WHEN p_brand = 'Brand#11' THEN 'ERROR' END, CASE WHEN p_size = 0 AND p_brand <> 'Brand#11' THEN 'INFO' END]) AS sev, unnest(['shots wrong', 'zero shots']) AS msg FROM part) WHERE sev IS NOT NULL")
def v02_shots(read):
    return records.shots_issues(read("part"), F.col("p_brand"), F.lit("any"), F.col("p_size"), "p_partkey", {("Brand#11", "any"): 7})


@query("SELECT lang AS source, doc_id AS row, 'INFO' AS severity, 'library version unknown' AS message FROM documents WHERE source = 'src0' UNION ALL SELECT lang, doc_id, 'ERROR', 'library version missing' FROM documents WHERE source = 'src1'")
def v03_library(read):
    version = F.when(F.col("source") == "src0", "unknown").when(F.col("source") != "src1", F.col("source"))
    return records.library_issues(read("documents"), F.col("lang"), F.col("source"), version, "doc_id")


@query("""SELECT source, row, severity, message FROM (SELECT c_mktsegment AS source, c_custkey AS row, unnest(['ERROR', 'ERROR', 'CRITICAL', 'WARNING', 'ERROR']) AS severity, unnest(['score below bound', 'score above bound', 'likely no score', 'score zero', 'score negative']) AS message,
unnest([c_acctbal < 0, c_acctbal > 100, c_acctbal > 100, c_acctbal = 0, c_acctbal < 0]) AS hit FROM customer) WHERE hit""")
def v04_scores(read):
    return records.score_issues(read("customer"), F.col("c_mktsegment"), F.col("c_acctbal"), F.lit(0.0), F.lit(100.0), "c_custkey")


@query("SELECT source, doc_id AS row, 'ERROR' AS severity, 'quality missing' AS message FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def v05_required(read):
    return records.required_issues(labelled(read), F.col("source"), {"quality": F.col("quality"), "text": F.col("text")}, "doc_id")


@query("SELECT p_brand AS source, p_partkey AS row, 'WARNING' AS severity, 'id without developer' AS message FROM part WHERE NOT contains(p_name, '/')")
def v06_identity(read):
    return records.identity_issues(read("part"), F.col("p_brand"), F.col("p_name"), F.col("p_name"), F.col("p_type"), "p_partkey")


@query("SELECT max((c_acctbal > 100 OR c_acctbal < 0)::INT)::BIGINT AS verdict FROM customer")
def v09_verdict(read):
    return records.verdict(records.run_checks(records.score_issues(read("customer"), F.col("c_mktsegment"), F.col("c_acctbal"), F.lit(0.0), F.lit(100.0), "c_custkey")))


@query("SELECT p_partkey, regexp_matches(lower(p_type), 'param|size|flop|latency|throughput|memory') AS metadata, p_retailprice > 100 AS leaked FROM part")
def v13_leaks(read):
    return read("part").select("p_partkey", records.metadata_metric(F.col("p_type")).alias("metadata"), records.out_of_range(F.col("p_retailprice"), F.lit(0.0), F.lit(100.0)).alias("leaked"))


@query("SELECT l_returnflag, l_linestatus, reason, count(*) AS n FROM (SELECT *, CASE WHEN l_quantity <= 10 THEN 'small' WHEN l_discount >= 0.05 THEN 'discount' END AS reason FROM lineitem) GROUP BY ALL")
def p12_reasons(read):
    return coverage.cross_counts(records.reasons(read("lineitem"), {"small": F.col("l_quantity") > 10, "discount": F.col("l_discount") < 0.05}), ["l_returnflag", "l_linestatus", "reason"])


@query("UNPIVOT (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders) ON o_orderstatus, o_orderpriority INTO NAME \"column\" VALUE value")
def p08_unpivot(read):
    return records.long_form(read("orders"), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 6) AS total FROM lineitem GROUP BY l_orderkey")
def p18_nest(read):
    nested = records.nest(read("lineitem"), ["l_orderkey"], ["l_linenumber", "l_quantity"])
    return nested.select("l_orderkey", F.size("results").cast("long").alias("n"), F.aggregate("results", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("total"))


@query("SELECT event_id, key, json_extract_string(props, '$.\"' || key || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def p15_json_rows(read):
    return read("events").select("event_id", F.explode(F.from_json("props", "map<string,string>")))


@query("SELECT conv_id, CASE WHEN count(*) FILTER (role = 'system') > 0 THEN 'agentic' WHEN count(*) FILTER (role = 'assistant') > 1 THEN 'multi_turn' ELSE 'single_turn' END AS kind FROM conversations GROUP BY conv_id")
def f47_interaction_type(read):
    counts = read("conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("a"), F.count_if(F.col("role") == "system").alias("t"))
    return counts.select("conv_id", interaction(F.col("a"), F.col("t")).alias("kind"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '\\s*\\(.*?\\)', '', 'g'), '[^a-z0-9]', '', 'g') AS norm FROM part")
def f09_norm(read):
    return read("part").select("p_partkey", norm_bench(F.col("p_name")).alias("norm"))
