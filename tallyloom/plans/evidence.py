"""Queries of evidence in texts: orders write reports of their lines, in several notations; the lines' own values are what records claim."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import evidence
from tallyloom.plans import query

#: What a report says of a line: the quantity in four notations, one of them wrong; the discount as it is, times a hundred, or not at all.
QUANTITY = "CASE l_linenumber % 4 WHEN 0 THEN CAST(l_quantity AS STRING) WHEN 1 THEN CAST(CAST(l_quantity / 100 AS DECIMAL(9,3)) AS STRING) WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS STRING) ELSE CAST(l_quantity + 100 AS STRING) END"
DISCOUNT = "CASE l_linenumber % 3 WHEN 0 THEN CAST(l_discount AS STRING) WHEN 1 THEN CAST(CAST(l_discount * 100 AS DECIMAL(9,1)) AS STRING) ELSE 'none' END"
LINE = f"'line ' || CAST(l_linenumber AS STRING) || ': ' || {QUANTITY} || ' at ' || {DISCOUNT} || ' for '"
VALUES = {"quantity": "CAST(l_quantity AS STRING)", "discount": "CAST(l_discount AS STRING)", "price": "CAST(l_extendedprice AS STRING)"}

REPORTS = f"""reports AS (SELECT l_orderkey, string_agg({LINE} || format('{{:,.2f}}', l_extendedprice), '; ' ORDER BY l_linenumber) AS report FROM lineitem GROUP BY l_orderkey),
tokens AS (SELECT l_orderkey, list_transform(regexp_extract_all(report, '[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\\.[0-9]+)?\\b|[0-9]+(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')) AS tokens FROM reports),
given AS ({' UNION ALL '.join(f"SELECT l_orderkey, l_linenumber, '{n}' AS kind, {v} AS value FROM lineitem" for n, v in VALUES.items())}),
numbers AS (SELECT *, value::DECIMAL(30,10) AS d FROM given),
forms AS (SELECT l_orderkey, l_linenumber, kind, value, [value, value || '0', value || '00', CASE WHEN d = floor(d) THEN d::DECIMAL(30,0)::VARCHAR END, CASE WHEN d > 0 AND d <= 100 THEN (d * 0.01)::DECIMAL(30,2)::VARCHAR END, CASE WHEN d > 0 AND d <= 100 THEN (d * 0.01)::DECIMAL(30,3)::VARCHAR END,
CASE WHEN d > 0 AND d <= 100 THEN (d * 0.01)::DECIMAL(30,4)::VARCHAR END, CASE WHEN d > 0 AND d < 1 THEN (d * 100)::DECIMAL(30,0)::VARCHAR END, CASE WHEN d > 0 AND d < 1 THEN (d * 100)::DECIMAL(30,1)::VARCHAR END, CASE WHEN d > 0 AND d < 1 THEN (d * 100)::DECIMAL(30,2)::VARCHAR END] AS forms FROM numbers),
judged AS (SELECT kind, l_orderkey, l_linenumber, value, len(list_intersect(list_filter(forms, lambda x: x IS NOT NULL), tokens)) > 0 AS found FROM forms JOIN tokens USING (l_orderkey))"""


def lines(read):
    """Lines dealt by order once, for reports and values alike."""
    return read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice").repartition("l_orderkey")


def reports(read):
    line = F.struct("l_linenumber", F.concat(F.expr(LINE), F.format_number("l_extendedprice", 2)).alias("said"))
    return lines(read).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["said"]), "; ").alias("report"))  # an order's lines


def values(read):
    kinds = F.array(*(F.struct(F.lit(n).alias("kind"), F.expr(v).alias("value")) for n, v in VALUES.items()))
    return lines(read).select("l_orderkey", "l_linenumber", F.explode(kinds).alias("v")).select("l_orderkey", "l_linenumber", "v.*")


@query(f"WITH {REPORTS} SELECT kind, count(*) AS scores, count_if(found) AS correct, round(count_if(found) * 100.0 / count(*), 6)::DOUBLE AS precision FROM judged GROUP BY kind")
def f40_number_evidence(read):
    judged = evidence.number_evidence(values(read), ["l_orderkey", "l_linenumber", "kind"], "l_orderkey", "value", reports(read), "report")
    return evidence.evidence_summary(judged, ["kind"])


@query(f"WITH {REPORTS} SELECT len(wrong) AS wrong, count(*) AS n, min(l_orderkey) AS first, min(array_to_string(wrong, '; ')) AS least FROM (SELECT l_orderkey, coalesce(list_sort(list(kind || ': ' || value) FILTER (WHERE NOT found)), []) AS wrong FROM judged GROUP BY l_orderkey) GROUP BY ALL")
def v16_record_evidence(read):
    named = values(read).withColumn("name", F.col("kind")).withColumn("line", F.col("l_linenumber"))
    lines = evidence.number_evidence(named, ["l_orderkey", "line", "name"], "l_orderkey", "value", reports(read), "report")
    wrong = lines.groupBy("l_orderkey").agg(F.array_sort(F.array_compact(F.collect_list(F.when(~F.col("found"), F.concat_ws(": ", "name", "value"))))).alias("wrong"))
    return wrong.groupBy(F.size("wrong").cast("long").alias("wrong")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"), F.min(F.array_join("wrong", "; ")).alias("least"))


CLAIM = "CASE p_partkey % 8 WHEN 0 THEN p_brand || ' (' || p_type || ')' WHEN 1 THEN p_brand || '-7B' WHEN 2 THEN 'Accuracy' WHEN 3 THEN 'nowhere, ' || p_name WHEN 4 THEN 'nowhere, here' WHEN 5 THEN p_brand || ' (other)' WHEN 6 THEN 'bleu' ELSE replace(p_name, ' ', '_') END"
SAID = "p_name || ' ' || p_brand || ' ' || CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END || CASE WHEN p_partkey % 5 < 3 THEN ' acc.' ELSE ' b@4' END"


@query(f"""WITH r AS (SELECT p_partkey, {CLAIM} AS claim, {SAID} AS said, p_name, p_brand, p_type FROM part)
SELECT p_partkey % 8 AS kind, count(*) AS n, count_if(CASE p_partkey % 8 WHEN 0 THEN contains(lower(said), lower(p_brand)) AND (contains(lower(said), lower(p_type)) OR true) WHEN 1 THEN contains(lower(said), lower(p_brand)) WHEN 2 THEN contains(said, 'acc')
WHEN 3 THEN contains(lower(said), lower(p_name)) WHEN 4 THEN false WHEN 5 THEN contains(lower(said), lower(p_brand)) WHEN 6 THEN contains(said, 'b@4') ELSE contains(lower(said), lower(p_name)) END) AS found,
count_if(contains(lower(said), lower(claim))) AS plain FROM r GROUP BY ALL""")
def f40_name_stages(read):
    r = read("part").select("p_partkey", F.expr(CLAIM).alias("claim"), F.expr(SAID).alias("said"))
    told = r.withColumns({"found": evidence.name_in_text(F.col("claim"), F.col("said")), "plain": F.contains(F.lower("said"), F.lower("claim"))})
    return told.groupBy((F.col("p_partkey") % 8).alias("kind")).agg(F.count("*").alias("n"), F.count_if("found").alias("found"), F.count_if("plain").alias("plain"))
