"""Queries on rates and calibration: out-of-fold predictions, explained deviance, importance, model choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos.operators import models as m
from pelagos.plans.registry import query
from pelagos.sources import views as v
from pelagos.storage import materialise

_UNITS = f"u AS (SELECT k, scene_id % 7 AS region, scene_id % 4 AS fold, (k % 6) AS n, (25 + k % 40)::DOUBLE AS x, cnn_score AS f1, wind_ms AS f2 FROM ({v.SQL_OBJECTS}))"


def _units(spark, sf):
    k = F.col("k")
    return v.objects(spark, sf).select("k", (F.col("scene_id") % 7).alias("region"), (F.col("scene_id") % 4).alias("fold"), (k % 6).alias("n"), (F.lit(25) + k % 40).cast("double").alias("x"), F.col("cnn_score").alias("f1"), F.col("wind_ms").alias("f2"))


_DEV = lambda p: f"2 * (CASE WHEN n > 0 THEN n * ln(n / {p}) ELSE 0 END - (n - {p}))"


@query(f"""WITH {_UNITS}, f AS (SELECT DISTINCT fold FROM u), w AS (SELECT f.fold, sum(n) / sum(x) AS r FROM f JOIN u ON u.fold <> f.fold GROUP BY 1), g AS (SELECT f.fold, u.region, sum(n) / sum(x) AS r FROM f JOIN u ON u.fold <> f.fold GROUP BY ALL),
p AS (SELECT u.fold, u.n, w.r * u.x AS a, coalesce(g.r, w.r) * u.x AS b FROM u JOIN w USING (fold) LEFT JOIN g USING (fold, region)), d AS (SELECT fold, count(*) AS n, sum({_DEV('a')}) AS a, sum({_DEV('b')}) AS b FROM p GROUP BY fold)
SELECT fold, 'whole' AS model, n, round(a / n, 6) AS deviance, 0.0::DOUBLE AS d2 FROM d UNION ALL SELECT fold, 'region', n, round(b / n, 6), round(1 - b / a, 6) FROM d""")
def cross_validated_rates(spark, sf):
    """Deviance per fold of the whole's rate and the regions', fitted on the other folds."""
    out = m.out_of_fold(_units(spark, sf), "fold", {"whole": m.global_rate("n", "x"), "region": m.group_rate("region", "n", "x")})
    return m.explained(out, ["fold"], "n", ["whole", "region"], "whole").select("fold", "model", "n", F.round("deviance", 6).alias("deviance"), F.round("d2", 6).alias("d2"))


@query()
def rate_importance(spark, sf):
    """How much the deviance rises when a feature group is dealt out anew."""
    u = materialise(_units(spark, sf), "units")
    return m.importance(u, "fold", "k", m.poisson_regression(["f1", "f2"], "n", "x"), {"network": ["f1"], "weather": ["f2"], "both": ["f1", "f2"]}, "n", 5)


@query()
def rate_dependence(spark, sf):
    u = _units(spark, sf)
    return m.partial_dependence(u, m.poisson_regression(["f1", "f2"], "n", "x")(u), "f2", [0.0, 5.0, 10.0, 15.0])


_LEN = f"l AS (SELECT k, scene_id AS g, length_m AS x, (length_m * (70 + k * 37 % 60) / 100)::DOUBLE AS y FROM ({v.SQL_OBJECTS}))"


def _lengths(spark, sf):
    return v.objects(spark, sf).select("k", F.col("scene_id").alias("g"), F.col("length_m").alias("x"), (F.col("length_m") * (F.lit(70) + F.col("k") * 37 % 60) / 100).alias("y"))


@query(f"""WITH {_LEN}, s AS (SELECT g, count(*) AS n FROM l GROUP BY 1) SELECT g, n FROM s""")
def calibration_groups(spark, sf):
    """Groups never split between folds: each has one fold, and the folds' loads are even."""
    d = m.dealt_folds(_lengths(spark, sf), "g")
    return d.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("f")).where("f = 1").select("g", "n")


@query(f"""WITH {_LEN}, f AS (SELECT *, g % 4 AS fold FROM l), r AS (SELECT a.fold, median(ln(b.y) - ln(b.x)) AS r FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON b.fold <> a.fold GROUP BY 1) SELECT f.k, round(exp(ln(x) + r.r), 5) AS length_cal FROM f JOIN r USING (fold)""")
def calibrated_lengths(spark, sf):
    """Lengths by the median ratio of the other folds."""
    d = _lengths(spark, sf).withColumn("fold", F.col("g") % 4)
    return m.out_of_fold(d, "fold", {"p": m.median_ratio("x", "y")}).select("k", F.round(F.exp("p"), 5).alias("length_cal"))


@query()
def calibration_choice(spark, sf):
    """Which length model is kept, with each one's error out of fold."""
    d = materialise(_lengths(spark, sf).withColumn("fold", F.col("g") % 4), "lengths")
    best, errors = m.select_model(d, "fold", "y", {"ratio": m.median_ratio("x", "y"), "loglinear": m.least_absolute("x", "y", steps=15), "isotonic": m.rising("x", "y", 16)})
    return spark.createDataFrame([(n, e, n == best) for n, e in errors.items()], "model string, error double, kept boolean")
