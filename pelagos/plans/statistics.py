"""Statistical queries: intervals, ranks, shrinkage, anomalies, calibration, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos.functions import geo, scalars
from pelagos.operators import aggregate
from pelagos.plans.registry import query
from pelagos.sources import views as v

LENGTHS = [0, 25, 50, 100, 150, 500]


@query(f"""WITH c AS ({v.SQL_CONTACTS}), g AS (SELECT confidence, l_suppkey AS unit, count(*) FILTER (WHERE status = 'matched') AS k, count(*) AS n FROM c GROUP BY ALL)
SELECT confidence, unit, k, n, round({scalars.sql_wilson("k", "n", "-")}, 6) AS low, round({scalars.sql_wilson("k", "n", "+")}, 6) AS high FROM g""")
def wilson_by_group(spark, sf):
    g = v.contacts(spark, sf).groupBy("confidence", F.col("l_suppkey").alias("unit")).agg(F.count(F.when(F.col("status") == "matched", 1)).alias("k"), F.count("*").alias("n"))
    low, high = scalars.wilson(F.col("k"), F.col("n"))
    return g.select("confidence", "unit", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH e AS (SELECT user_id, value, event_id % 97 AS other FROM events), r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2 AS a, rank() OVER (PARTITION BY user_id ORDER BY other) + (count(*) OVER (PARTITION BY user_id, other) - 1) / 2 AS b FROM e)
SELECT user_id, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY user_id""")
def spearman_by_group(spark, sf):
    e = v.table(spark, sf, "events").select("user_id", "value", (F.col("event_id") % 97).alias("other"))
    return aggregate.spearman(e, ["user_id"], "value", "other").select("user_id", "n", F.round("rho", 6).alias("rho"))


@query("""WITH o AS (SELECT c_custkey AS unit, c_nationkey AS grp, (SELECT 1) AS one, count(o_orderkey)::DOUBLE AS k, (c_custkey % 20 + 5)::DOUBLE AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT grp, sum(k) / sum(x) AS m, sum(x) AS t, count(*) AS u FROM o GROUP BY grp), s AS (SELECT o.grp, any_value(m) AS m, greatest(0.0, sum(x * pow(k / x - m, 2)) / any_value(t) - any_value(m) / (any_value(t) / any_value(u))) AS b FROM o JOIN g USING (grp) GROUP BY o.grp)
SELECT unit, grp, round(m + CASE WHEN b > 0 THEN b / (b + m / x) ELSE 0 END * (k / x - m), 6) AS rate FROM o JOIN s USING (grp)""")
def eb_shrink_rates(spark, sf):
    c, o = v.table(spark, sf, "customer"), v.table(spark, sf, "orders")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    units = c.join(n, "c_custkey", "left").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("grp"), F.coalesce("k", F.lit(0)).cast("double").alias("k"), (F.col("c_custkey") % 20 + 5).cast("double").alias("x"))
    return aggregate.shrink_rates(units, "unit", "grp", "k", "x").select("unit", "grp", F.round("rate", 6).alias("rate"))


_POISSON = """WITH o AS (SELECT o_custkey AS unit, o_custkey % 25 AS fam, count(*) AS k FROM orders GROUP BY ALL), e AS (SELECT *, avg(k::DOUBLE) OVER (PARTITION BY fam) AS m FROM o),
t AS (SELECT unit, fam, k, m, least(1.0, list_sum(list_transform(range(0, k + 1), lambda i: exp(i * ln(m) - m - lgamma(i + 1))))) AS cdf, coalesce(least(1.0, list_sum(list_transform(range(0, k), lambda i: exp(i * ln(m) - m - lgamma(i + 1))))), 0) AS below FROM e),
p AS (SELECT *, round(least(1.0, 2 * least(cdf, 1 - below)), 9) AS p FROM t)"""


def _tails(spark, sf):
    from pyspark.sql import Window

    o = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.count("*").alias("k")).withColumn("fam", F.col("unit") % 25)
    e = o.withColumn("m", F.avg(F.col("k").cast("double")).over(Window.partitionBy("fam")))
    cdf, below = scalars.poisson_cdf(F.col("k"), F.col("m")), F.when(F.col("k") > 0, scalars.poisson_cdf(F.greatest(F.col("k") - 1, F.lit(0)), F.col("m"))).otherwise(0.0)
    return e.withColumn("p", F.round(F.least(F.lit(1.0), 2 * F.least(cdf, 1 - below)), 9))


@query(_POISSON + " SELECT unit, k, round(m, 6) AS expected, round((k - m) / sqrt(m), 6) AS z, round(p, 6) AS p FROM p")
def poisson_flags(spark, sf):
    return _tails(spark, sf).select("unit", "k", F.round("m", 6).alias("expected"), F.round((F.col("k") - F.col("m")) / F.sqrt("m"), 6).alias("z"), F.round("p", 6).alias("p"))


@query(_POISSON + """, r AS (SELECT unit, fam, p, row_number() OVER (PARTITION BY fam ORDER BY p, unit) AS i, count(*) OVER (PARTITION BY fam) AS n FROM p)
SELECT unit, fam, round(least(1.0, min(p * n / i) OVER (PARTITION BY fam ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_qvalues(spark, sf):
    return aggregate.false_discovery(_tails(spark, sf), "p", "unit", ["fam"]).select("unit", "fam", F.round("q", 6).alias("q"))


@query("""WITH l AS (SELECT l_suppkey AS g, l_extendedprice AS x, l_quantity AS w, l_orderkey AS a, l_linenumber AS b FROM lineitem), d AS (SELECT g, x, w, least(9, floor((sum(w) OVER (PARTITION BY g ORDER BY x, a, b ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY g) * 10))::INTEGER AS decile FROM l)
SELECT g, decile, count(*) AS n, round(sum(w * x) / sum(w), 4) AS mean_x FROM d GROUP BY ALL""")
def weighted_deciles(spark, sf):
    x = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"))
    d = aggregate.weighted_deciles(x, ["g"], ["x", "a", "b"], "w")
    return d.groupBy("g", "decile").agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("x")) / F.sum("w"), 4).alias("mean_x"))


_GATE = f"""WITH c AS ({v.SQL_CONTACTS}), g AS (SELECT status = 'unmatched' AS unmatched, confidence IN ('high', 'medium') AS confident, cnn >= 0.5 AS network, coalesce(wind < 0.06, true) AS calm, length_m BETWEEN 15 AND 450 AS size FROM c)"""
_NAMES = ["unmatched", "confident", "network", "calm", "size"]


@query(f"""WITH c AS ({v.SQL_CONTACTS}), b AS (SELECT {scalars.sql_bin("length_m", LENGTHS, "right")} AS bin, status FROM c) SELECT bin, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'unmatched') AS unmatched FROM b GROUP BY bin""")
def length_bins(spark, sf):
    return aggregate.crosstab(v.contacts(spark, sf), scalars.length_bin(F.col("length_m"), LENGTHS, "right"), "status", ["matched", "unmatched"])


@query(f"""WITH c AS ({v.SQL_CONTACTS}), n AS (SELECT coalesce(confidence, 'all') AS grp, status AS kind, count(*) AS n FROM c GROUP BY GROUPING SETS ((confidence, status), (status)))
SELECT grp, kind, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY grp), 6) AS share FROM n""")
def grouping_sets_all_row(spark, sf):
    return aggregate.shares_with_total(v.contacts(spark, sf), "confidence", "status").select("grp", "kind", "n", F.round("share", 6).alias("share"))


@query("""WITH d AS (SELECT l.doc_id % 5 AS fold, l.toxic = 1 AS t, l.quality = 0 OR l.doc_id % 7 = 0 AS s FROM labels l), c AS (SELECT fold, count(*) FILTER (WHERE t AND s) AS tp, count(*) FILTER (WHERE NOT t AND s) AS fp, count(*) FILTER (WHERE t AND NOT s) AS fn FROM d GROUP BY fold),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS q FROM c) SELECT fold, tp, fp, fn, round(p, 6) AS "precision", round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) END, 6) AS f1 FROM r""")
def precision_recall(spark, sf):
    d = v.table(spark, sf, "labels").withColumn("fold", F.col("doc_id") % 5)
    out = aggregate.precision_recall(d, ["fold"], F.col("toxic") == 1, (F.col("quality") == 0) | (F.col("doc_id") % 7 == 0))
    return out.select("fold", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""WITH d AS (SELECT quality AS g, doc_id * 37 % 101 AS score, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS pos FROM labels GROUP BY ALL)
SELECT g, score, round((sum(pos) OVER w / sum(n) OVER w)::DOUBLE, 6) AS "precision", round(sum(pos) OVER w / sum(pos) OVER (PARTITION BY g), 6) AS recall FROM d WINDOW w AS (PARTITION BY g ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def pr_curve(spark, sf):
    d = v.table(spark, sf, "labels").select(F.col("quality").alias("g"), (F.col("doc_id") * 37 % 101).alias("score"), "toxic")
    return aggregate.pr_curve(d, ["g"], "score", F.col("toxic") == 1).select("g", "score", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""WITH c AS ({v.SQL_CONTACTS}), x AS (SELECT {geo.SQL_CELL} AS cell, length_m, confidence FROM c), n AS (SELECT cell, confidence, count(*) AS n FROM x GROUP BY ALL),
m AS (SELECT cell, arg_min(confidence, struct_pack(k := -n, c := confidence)) AS label, round(max(n) / sum(n), 6) AS label_share, count(*) AS labels FROM n WHERE cell IS NOT NULL GROUP BY cell),
s AS (SELECT cell, count(length_m) AS n, sum(length_m) AS total, round(avg(length_m), 6) AS mean, round(CASE WHEN count(length_m) > 1 THEN stddev_pop(length_m) END, 6) AS sd, min(length_m) AS low, max(length_m) AS high FROM x WHERE cell IS NOT NULL GROUP BY cell)
SELECT * FROM s JOIN m USING (cell)""")
def cell_statistics(spark, sf):
    x = v.contacts(spark, sf).select(geo.cell_id(F.col("lon"), F.col("lat")).alias("cell"), "length_m", "confidence").where("cell is not null")
    s = aggregate.cell_stats(x, ["cell"], "length_m").withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))
    return s.join(aggregate.modal_label(x, ["cell"], "confidence").withColumn("label_share", F.round("label_share", 6)), "cell")


@query(f"""WITH c AS ({v.SQL_CONTACTS}) SELECT confidence, min(length_m) AS q0, quantile_cont(length_m, 0.25) AS q25, median(length_m) AS q50, quantile_cont(length_m, 0.75) AS q75, max(length_m) AS q100, round(avg(length_m), 6) AS mean FROM c GROUP BY 1""")
def factor_distributions(spark, sf):
    q = F.percentile("length_m", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75))))
    c = v.contacts(spark, sf).groupBy("confidence").agg(F.min("length_m").alias("q0"), q.alias("q"), F.max("length_m").alias("q100"), F.round(F.avg("length_m"), 6).alias("mean"))
    return c.select("confidence", "q0", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "q100", "mean")


@query("""WITH l AS (SELECT l_returnflag AS g, ln(l_extendedprice / (l_quantity * 1000)) AS r, l_orderkey * 8 + l_linenumber AS k FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r, k) AS i, count(*) OVER (PARTITION BY g) AS n FROM l)
SELECT g, round(max(r) FILTER (WHERE i = greatest(1, floor((n + 1) * 0.1::DOUBLE))), 6) AS low, round(max(r) FILTER (WHERE i = least(n, ceil((n + 1) * 0.9::DOUBLE))), 6) AS high, count(*) AS n FROM o GROUP BY g""")
def conformal_quantiles(spark, sf):
    x = v.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.log(F.col("l_extendedprice") / (F.col("l_quantity") * 1000)).alias("r"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    return aggregate.conformal_band(x, ["g"], "r", "k").select("g", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query("""SELECT o_orderstatus AS grp, count(*) AS n, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 3) AS intercept FROM orders GROUP BY 1""")
def linear_fit_by_group(spark, sf):
    y, x = F.col("o_totalprice"), F.col("o_custkey").cast("double")
    return v.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("grp")).agg(F.count("*").alias("n"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"))


@query("""WITH o AS (SELECT o_custkey % 25 AS fam, o_custkey AS unit, count(*)::DOUBLE AS k FROM orders GROUP BY ALL), e AS (SELECT *, avg(k) OVER (PARTITION BY fam) AS m, avg(k) OVER () AS base FROM o)
SELECT fam, round(sum(2 * (CASE WHEN k > 0 THEN k * ln(k / m) ELSE 0 END - (k - m))), 4) AS deviance, round(1 - sum(2 * (CASE WHEN k > 0 THEN k * ln(k / m) ELSE 0 END - (k - m))) / sum(2 * (CASE WHEN k > 0 THEN k * ln(k / base) ELSE 0 END - (k - base))), 6) AS d2 FROM e GROUP BY fam""")
def poisson_deviance(spark, sf):
    o = v.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 25).alias("fam"), F.col("o_custkey").alias("unit")).agg(F.count("*").cast("double").alias("k"))
    g = o.groupBy("fam").agg(F.avg("k").alias("m"))
    e = o.join(g, "fam").crossJoin(F.broadcast(o.agg(F.avg("k").alias("base"))))  # one row on the right
    d, b = scalars.poisson_deviance(F.col("k"), F.col("m")), scalars.poisson_deviance(F.col("k"), F.col("base"))
    return e.groupBy("fam").agg(F.round(F.sum(d), 4).alias("deviance"), F.round(1 - F.sum(d) / F.sum(b), 6).alias("d2"))
