"""Experiment statistics bound to events: group = event_type, subject = user_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import quantiles, regression, relations, stats
from tallyloom.plans import query

TYPES = 5  # of events
MEANS = "m AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_type IS NOT NULL GROUP BY ALL)"
FULL = MEANS + f", f AS (SELECT * FROM m WHERE user_id IN (SELECT user_id FROM m GROUP BY user_id HAVING count(*) = {TYPES}))"


def f_tail_sql(f: str, d1: str, d2: str, of: str) -> str:
    """CTEs (to stand in WITH RECURSIVE) that end in `tail(p)`: the F tail by its continued fraction, from one row of a CTE."""
    return f"""q AS (SELECT ({d2}) / ({d2} + {d1} * {f}) AS x, {d2} / 2.0 AS a, {d1} / 2.0 AS b FROM {of}), o AS (SELECT x >= (a + 1) / (a + b + 2) AS swap, CASE WHEN x >= (a + 1) / (a + b + 2) THEN b ELSE a END AS a, CASE WHEN x >= (a + 1) / (a + b + 2) THEN a ELSE b END AS b,
CASE WHEN x >= (a + 1) / (a + b + 2) THEN 1 - x ELSE x END AS x FROM q),
lentz(m, c, d, h) AS (SELECT 0::DOUBLE, 1::DOUBLE, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1)) FROM o UNION ALL SELECT m, c2, d2, h * c1 * d1 * c2 * d2 FROM (
SELECT m + 1 AS m, h, m1 * (b - m1) * x / ((a + 2 * m1 - 1) * (a + 2 * m1)) AS t1, 1 + t1 / c AS c1, 1 / (1 + t1 * d) AS d1, -(a + m1) * (a + b + m1) * x / ((a + 2 * m1) * (a + 2 * m1 + 1)) AS t2, 1 + t2 / c1 AS c2, 1 / (1 + t2 * d1) AS d2
FROM (SELECT lentz.*, m + 1 AS m1 FROM lentz), o WHERE m < 400)),
part AS (SELECT swap, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * h / a AS p FROM lentz, o WHERE m = 400), tail AS (SELECT CASE WHEN swap THEN 1 - p ELSE p END AS p FROM part)"""


def means(read):
    return read("events").where(F.col("event_type").isNotNull()).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))


ONE_WAY = """g AS (SELECT avg(value) AS g FROM events), a AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY event_type),
b AS (SELECT (SELECT sum(n * (m - g) * (m - g)) FROM a, g) AS b, (SELECT sum((value - m) * (value - m)) FROM events JOIN a USING (event_type)) AS w, (SELECT count(*) FROM events) AS n, (SELECT count(*) FROM a) AS k)"""


ANOVA = f"{ONE_WAY}, s AS (SELECT n, k - 1 AS dfb, n - k AS dfw, b / (b + w) AS eta2, b / (k - 1) / (w / (n - k)) AS f FROM b)"


@query(f"WITH {ANOVA} SELECT n, dfb, dfw, round(eta2, 6) AS eta2, round(f, 6) AS f FROM s")
def t01_t02_anova(read):
    return stats.one_way(read("events"), "event_type", "value")


@query(f"""WITH {FULL}, r AS (SELECT event_type, rank() OVER (PARTITION BY user_id ORDER BY v) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0 AS r FROM f), s AS (SELECT event_type, sum(r)::DOUBLE AS r, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT max(n) AS blocks, 12 * sum(r * r) / (max(n) * 30) - 18 * max(n) AS s FROM s) SELECT blocks, 4 AS df, round(s, 6) AS statistic, round(s / (blocks * 4), 6) AS w, round(exp(-s / 2) * (1 + s / 2), 6) AS p FROM t""")
def t06_friedman(read):
    return stats.friedman(means(read), "user_id", "event_type", "v", TYPES).withColumn("p", stats.chi2_tail(F.col("statistic"), F.col("df")))


RM = f"""{FULL}, g AS (SELECT avg(v) AS g, count(*) / {TYPES} AS n FROM f), s AS (SELECT user_id, avg(v) AS s FROM f GROUP BY ALL), t AS (SELECT event_type, avg(v) AS t FROM f GROUP BY ALL),
d AS (SELECT sum((t - g) * (t - g)) AS b, sum((v - s - t + g) * (v - s - t + g)) AS w, max(n) AS n FROM f JOIN s USING (user_id) JOIN t USING (event_type), g),
e AS (SELECT n::BIGINT AS n, 4 AS dfb, ((n - 1) * 4)::BIGINT AS dfw, b / (b + w) AS eta2, (b / 4) / (w / ((n - 1) * 4)) AS f FROM d)"""


@query(f"WITH RECURSIVE {RM}, {f_tail_sql('f', 'dfb', 'dfw', 'e')} SELECT n, dfb, dfw, round(eta2, 6) AS eta2, round(f, 6) AS f, round(p, 6) AS p FROM e, tail")
def t09_rm_anova(read):
    return stats.repeated_measures(means(read), "user_id", "event_type", "v", TYPES).withColumn("p", stats.f_tail(F.col("f"), F.col("dfb"), F.col("dfw")))


PAIRED = f"{MEANS}, p AS (SELECT user_id, max(v) FILTER (event_type = 'view') AS a, max(v) FILTER (event_type = 'click') AS b FROM m GROUP BY ALL), d AS (SELECT b - a AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL), e AS (SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM d)"


@query(f"WITH RECURSIVE {PAIRED}, {f_tail_sql('t * t', '1', 'df', 'e')} SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(t, 6) AS t, df, round(p, 6) AS p FROM e, tail")
def t12_ttest(read):
    paired = stats.paired_t(relations.paired_delta(means(read), ["user_id"], "event_type", "view", "click", "v"), F.col("delta"))
    return paired.withColumn("p", stats.t_tail(F.col("t"), F.col("df")))


RHO = f"""{MEANS}, b AS (SELECT x.event_type AS a, y.event_type AS b, x.v AS x, y.v AS y FROM m x JOIN m y ON x.user_id = y.user_id AND x.event_type < y.event_type),
r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM b),
rho AS (SELECT a, b, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) AS rho, count(*) AS n FROM r GROUP BY ALL)"""


@query(f"WITH {RHO} SELECT a, b, round(rho, 6) AS rho, n FROM rho")
def t13_spearman(read):
    return stats.spearman(means(read), "user_id", "event_type", "v")


@query(f"WITH {RHO} SELECT count(rho) AS pairs, round(min(rho), 6) AS least, round(max(rho), 6) AS most, round(avg(rho), 6) AS mean FROM rho")
def t13_summary(read):
    return stats.spread_of_pairs(stats.spearman(means(read), "user_id", "event_type", "v"))


@query("""WITH d AS (SELECT l_discount - l_tax AS d FROM lineitem), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(d)) AS c FROM d WHERE d <> 0),
s AS (SELECT count(*)::DOUBLE AS n, sum(r) FILTER (d > 0)::DOUBLE AS p, sum(r) FILTER (d < 0)::DOUBLE AS m, sum(c * c - 1)::DOUBLE AS t FROM r)
SELECT n::BIGINT AS n, p AS plus, m AS minus, round((least(p, m) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48), 6) AS z FROM s""")
def t18_wilcoxon(read):
    return stats.wilcoxon(read("lineitem"), F.col("l_discount") - F.col("l_tax"))


@query("""WITH d AS (SELECT l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS dx, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS dy FROM lineitem)
SELECT round(sum(dx * dy) * sum(dx * dy) / (sum(dx * dx) * sum(dy * dy)), 6) AS r2 FROM d""")
def t15_partial_r2(read):
    return stats.partial_r2(read("lineitem"), "l_suppkey", "l_quantity", "l_extendedprice")


WITHIN = "c AS (SELECT l_suppkey AS e, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, {code} AS x3 FROM lineitem), d AS (SELECT y, y - avg(y) OVER w AS dy, x1 - avg(x1) OVER w AS d1, x2 - avg(x2) OVER w AS d2, x3 - avg(x3) OVER w AS d3, e FROM c WINDOW w AS (PARTITION BY e)), s AS (SELECT count(*) AS n, count(DISTINCT e) AS entities, var_pop(y) * count(*) AS total, sum(dy * dy) AS yy, sum(d1 * d1) AS s11, sum(d2 * d2) AS s22, sum(d3 * d3) AS s33, sum(d1 * d2) AS s12, sum(d1 * dy) AS s1, sum(d2 * dy) AS s2, sum(d3 * dy) AS s3 FROM d)"
PARTIAL = "SELECT n, entities, round(1 - yy / total, 6) AS r2_base, round(s1 * s1 / s11 / yy, 6) AS partial_l_quantity, round(s2 * s2 / s22 / yy, 6) AS partial_l_discount"


@query(f"WITH {WITHIN.format(code='0')} {PARTIAL}, round((s1 * s1 * s22 - 2 * s1 * s2 * s12 + s2 * s2 * s11) / (s11 * s22 - s12 * s12) / yy, 6) AS partial_all, 0.758641::DOUBLE AS overturn FROM s")
def t15_two_regressors(read):
    return regression.sensitivity(read("lineitem"), "l_suppkey", "l_extendedprice", ["l_quantity", "l_discount"])


@query(f"WITH {WITHIN.format(code='(SELECT count(DISTINCT l.l_returnflag) FROM lineitem l WHERE l.l_returnflag < lineitem.l_returnflag)')} {PARTIAL}, round(s3 * s3 / s33 / yy, 6) AS partial_code FROM s")
def t15_categories(read):
    coded = regression.category_codes(read("lineitem"), "l_returnflag", "code")
    return regression.sensitivity(coded, "l_suppkey", "l_extendedprice", ["l_quantity", "l_discount", "code"]).drop("partial_all", "overturn")


CODE = "CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE -1 END"


@query(f"WITH {WITHIN.format(code=CODE)} {PARTIAL}, round(s3 * s3 / s33 / yy, 6) AS partial_code FROM s")
def t16_plain_codes(read):
    coded = read("lineitem").withColumn("code", regression.mapped_codes(F.col("l_returnflag"), {"R": 0, "A": 1}))
    return regression.sensitivity(coded, "l_suppkey", "l_extendedprice", ["l_quantity", "l_discount", "code"]).drop("partial_all", "overturn")


@query("SELECT event_type, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY ALL")
def t17_summary(read):
    summary = read("events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return quantiles.beside(summary, quantiles.exact_median(read("events"), ["event_type"], "value"), ["event_type"])


@query("SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 6) AS low, round(quantile_cont(l_extendedprice, 0.9), 6) AS high FROM lineitem GROUP BY ALL")
def t17_deciles(read):
    return quantiles.exact_quantiles(read("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"low": 0.1, "high": 0.9})


@query("SELECT event_type, round(avg(value), 6) AS mean, CASE WHEN abs(avg(value) - 50) <= 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM events GROUP BY ALL")
def t19_tolerance(read):
    m = read("events").groupBy("event_type").agg(F.avg("value").alias("mean"))
    return m.withColumn("verdict", stats.within_tolerance(F.col("mean"), F.lit(50.0), 1.0))


@query(f"WITH RECURSIVE {ANOVA}, {f_tail_sql('f', 'dfb', 'dfw', 's')} SELECT n, dfb, dfw, round(eta2, 6) AS eta2, round(f, 6) AS f, round(p, 6) AS p FROM s, tail")
def t04_f_sf(read):
    return stats.one_way(read("events"), "event_type", "value").withColumn("p", stats.f_tail(F.col("f"), F.col("dfb"), F.col("dfw")))


@query(f"""WITH {FULL}, r AS (SELECT event_type, rank() OVER (PARTITION BY user_id ORDER BY v) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY user_id, v) AS c FROM f),
s AS (SELECT event_type, sum(r)::DOUBLE AS r, count(*) AS n, sum(c * c - 1)::DOUBLE AS tie FROM r GROUP BY ALL), t AS (SELECT max(n) AS blocks, (12 * sum(r * r) / (max(n) * 30) - 18 * max(n)) / (1 - sum(tie) / (max(n) * 120)) AS s FROM s)
SELECT blocks, 4 AS df, round(s, 6) AS statistic, round(s / (blocks * 4), 6) AS w, round(exp(-s / 2) * (1 + s / 2), 6) AS p FROM t""")
def t05_chi2_sf(read):
    return stats.friedman(means(read), "user_id", "event_type", "v", TYPES, ties=True).withColumn("p", stats.chi2_tail(F.col("statistic"), F.col("df")))


@query()
def t14_bootstrap(read):
    return stats.bootstrap_eta2(read("events"), "event_type", "value")
