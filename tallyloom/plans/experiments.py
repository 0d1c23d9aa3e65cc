"""Queries of the experiment summaries and lookups: events and orders stand for runs, customers and parts for scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import experiments as x
from tallyloom.plans import query


@query("""SELECT 'l_returnflag' AS factor, l_returnflag AS level, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL
UNION ALL SELECT 'l_linestatus', l_linestatus, count(l_quantity), round(avg(l_quantity), 6) FROM lineitem GROUP BY ALL""")
def g14_level_means(read):
    return x.level_means(read("lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


PAIRED = "p AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM events GROUP BY ALL)"


@query(f"WITH {PAIRED} SELECT user_id, count(*) AS n, round(max(abs(b - a)), 6) AS largest FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL")
def g20_largest_delta(read):
    return x.largest_delta(read("events"), ["user_id"], "event_type", "view", "click", "value", ["user_id"])


@query("SELECT user_id, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END, 6) AS sd FROM events GROUP BY ALL")
def g22_version_report(read):
    return x.version_report(read("events"), "event_type", "value", ["user_id"])


@query("""WITH c AS (SELECT l_returnflag, l_linenumber, l_suppkey, avg(l_extendedprice) AS x FROM lineitem GROUP BY ALL), t AS (SELECT l_returnflag, avg(x) AS g FROM c GROUP BY ALL),
g AS (SELECT l_returnflag, l_linenumber, count(*) AS n, avg(x) AS m FROM c GROUP BY ALL),
b AS (SELECT l_returnflag, sum(n * (m - g) * (m - g)) AS b, count(*) AS groups, sum(n) AS cells FROM g JOIN t USING (l_returnflag) GROUP BY ALL),
w AS (SELECT l_returnflag, sum((x - m) * (x - m)) AS w FROM c JOIN g USING (l_returnflag, l_linenumber) GROUP BY ALL)
SELECT l_returnflag, groups, cells::BIGINT AS cells, round(b / (b + w), 6) AS eta2 FROM b JOIN w USING (l_returnflag)""")
def g31_eta_of_cells(read):
    return x.eta_of_cells(read("lineitem"), "l_returnflag", "l_linenumber", ["l_suppkey"], "l_extendedprice")


@query("""WITH p AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS x FROM orders GROUP BY ALL),
s AS (SELECT o_orderpriority FROM p GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT o_orderstatus) FROM orders))
SELECT o_orderstatus, count(*) AS parts, round(avg(x), 6) AS macro FROM p SEMI JOIN s USING (o_orderpriority) GROUP BY ALL""")
def g32_macro_mean(read):
    return x.macro_mean(read("orders"), "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_quantity + l_linenumber AS s, l_quantity * 2 AS c, l_quantity * 2 + l_tax * 100 AS b FROM lineitem),
g AS (SELECT *, greatest(abs(s - a), abs(c - s), abs(b - c)) AS most FROM v)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(s - a, 6) AS restriction, round(c - s, 6) AS protocol, round(b - c, 6) AS remainder, round(b - a, 6) AS gap, true AS adds_up,
CASE WHEN most <= 1e-9 THEN 'none' WHEN abs(s - a) = most THEN 'restriction' WHEN abs(c - s) = most THEN 'protocol' ELSE 'remainder' END AS outcome FROM g""")
def g41_gap_parts(read):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    parts = x.gap_parts(q, q + n, q * 2, q * 2 + F.col("l_tax") * 100)
    return read("lineitem").select("l_orderkey", "l_linenumber", parts.alias("g")).select("l_orderkey", "l_linenumber", "g.*")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_discount = 0 THEN 'MISSING' WHEN abs(round(l_discount * 100, 2) - round(l_tax * 100, 2)) < 1e-9 THEN 'OK' ELSE 'DIFFERS' END AS verdict FROM lineitem""")
def t20_quoted(read):
    return read("lineitem").select("l_orderkey", "l_linenumber", x.quoted(F.nullif(F.col("l_discount"), F.lit(0.0)), F.round(F.col("l_tax") * 100, 2)).alias("verdict"))


@query("""WITH f AS (SELECT c_nationkey, avg(c_acctbal) AS found FROM customer GROUP BY ALL), p AS (SELECT n_nationkey AS c_nationkey, 4500.0::DOUBLE AS published FROM nation)
SELECT c_nationkey::BIGINT AS c_nationkey, published, round(found, 6) AS found, coalesce(abs(found - published) <= 200, false) AS passes FROM p LEFT JOIN f USING (c_nationkey)""")
def t21_gate(read):
    found = read("customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("found"))
    return x.gate(found, read("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(4500.0).alias("published")), "c_nationkey", 200.0)


@query("WITH m AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL) SELECT user_id, round(max(m) - min(m), 6) AS spread FROM m GROUP BY ALL")
def t22_spread(read):
    return x.spread_and_pooled(read("events"), "user_id", "event_type", "value", "0")[0]


@query(r"""SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_size END, try_cast(nullif(regexp_extract(p_brand, '(\d+)', 1), '') AS INTEGER), 0)::BIGINT AS shots FROM part""")
def p10_settled(read):
    brand = F.nullif(F.regexp_extract("p_brand", r"(\d+)", 1), F.lit("")).try_cast("int")
    return read("part").select("p_partkey", x.settled(F.when(F.col("p_size") > 25, F.col("p_size")), brand, F.lit(0)).alias("shots"))


@query("""WITH l AS (SELECT o_custkey AS k, max(o_orderpriority) AS s FROM orders GROUP BY ALL)
SELECT c_custkey, coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END, s) AS segment FROM customer LEFT JOIN l ON c_custkey = k""")
def p11_filled(read):
    rows = read("customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("").alias("segment"))
    return x.filled(rows, read("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("segment")), "c_custkey", ["segment"])


@query("SELECT p_partkey, p_name, p_type FROM part WHERE regexp_matches(lower(p_type), 'e+l$') AND regexp_matches(lower(p_brand), '#[12]')")
def p21_matching(read):
    return x.matching(read("part"), {"p_type": "e+l$", "p_brand": "#[12]"}).select("p_partkey", "p_name", "p_type")


@query("SELECT o_custkey, count(DISTINCT o_totalprice) AS n, round(max(o_totalprice), 6) AS largest, round(arg_min(o_totalprice, o_orderkey), 6) AS \"first\" FROM orders WHERE o_totalprice BETWEEN 50000 AND 250000 GROUP BY ALL")
def p22_in_range(read):
    return x.in_range(read("orders"), "o_custkey", "o_totalprice", 50000.0, 250000.0, "o_orderkey")


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'low') GROUP BY ALL")
def p23_first_with(read):
    return x.first_with(read("orders"), "o_custkey", "o_orderpriority", "LOW", "o_orderkey", ["o_orderkey", "o_orderpriority"])


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events) SELECT * FROM r WHERE place <= 3")
def w07_newest(read):
    return x.newest(read("events"), ["user_id"], [F.desc("ts"), F.col("event_id")]).select("user_id", "event_id", "place")


@query("SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o07_some(read):
    return x.some(read("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


@query("""WITH s AS (SELECT l_orderkey AS r, {'source': l_returnflag, 'score': l_quantity} AS a, {'source': l_linestatus, 'score': l_linenumber::DOUBLE} AS b FROM lineitem),
k AS (SELECT r, CASE WHEN a <= b THEN a ELSE b END AS x, CASE WHEN a <= b THEN b ELSE a END AS y FROM s)
SELECT x.source AS first_source, y.source AS second_source, count(*) AS n, min(r) AS "row" FROM k GROUP BY x, y""")
def d06_conflict_pairs(read):
    rows = read("lineitem").withColumn("number", F.col("l_linenumber").cast("double"))
    return x.conflict_pairs(rows, ("l_returnflag", "l_linestatus"), ("l_quantity", "number"), "l_orderkey").select(F.col("a.source").alias("first_source"), F.col("b.source").alias("second_source"), "n", "row")


@query("""WITH c AS (SELECT count(*) AS total, count(*) FILTER (quality IS NOT NULL) AS q, count(*) FILTER (toxic = 1) AS t, count(*) FILTER (lang IS NOT NULL AND lower(trim(lang)) NOT IN ('', 'unknown')) AS h FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'quality' AS field, q AS filled, total, round(q / total, 6) AS share FROM c UNION ALL SELECT 'toxic', t, total, round(t / total, 6) FROM c UNION ALL SELECT 'harness', h, total, round(h / total, 6) FROM c""")
def v08_coverage(read):
    rows = read("documents").join(read("labels"), "doc_id", "left")
    return x.metadata_coverage(rows, {"quality": F.col("quality").isNotNull(), "toxic": F.col("toxic") == 1}, F.col("lang"))
