"""Rates and length calibration: models as expressions whose few parameters come from aggregates, judged out of fold.

A model is a function from training rows to a Column that predicts on any rows, so cross-validation, importance and selection are loops over a few
folds, each a few aggregates; the rows never leave the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions.scalars import poisson_deviance

Model = Callable[[DataFrame], Column]


def global_rate(count: str, exposure: str) -> Model:
    def fit(train: DataFrame) -> Column:
        r = train.agg((F.sum(count) / F.sum(exposure)).alias("r")).first()["r"]
        return F.lit(float(r or 0.0)) * F.col(exposure)

    return fit


def group_rate(group: str, count: str, exposure: str) -> Model:
    """Rate per group, the whole's where a group is new. Groups are few (regions, months)."""

    def fit(train: DataFrame) -> Column:
        rows = train.groupBy(group).agg((F.sum(count) / F.sum(exposure)).alias("r")).where("r is not null").collect()
        whole = train.agg((F.sum(count) / F.sum(exposure)).alias("r")).first()["r"] or 0.0
        out = F.lit(float(whole))
        for row in rows:
            out = F.when(F.col(group).eqNullSafe(F.lit(row[group])), F.lit(float(row["r"]))).otherwise(out)
        return out * F.col(exposure)

    return fit


def poisson_regression(features: list[str], count: str, exposure: str, steps: int = 25) -> Model:
    """Log-linear rate with exposure as offset, by Newton steps whose sums Spark adds up: the documented stand-in for boosted trees. Missing features count as their mean."""

    def fit(train: DataFrame) -> Column:
        stats = train.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        scaled = [F.coalesce((F.col(c) - float(stats[f"m_{i}"] or 0.0)) / float(stats[f"s_{i}"] or 1.0), F.lit(0.0)) for i, c in enumerate(features)]
        x = [F.lit(1.0), *scaled]
        n = len(x)
        rate = train.agg((F.sum(count) / F.sum(exposure)).alias("r")).first()["r"] or 1e-12
        beta = np.zeros(n)
        beta[0] = math.log(max(rate, 1e-12))
        rows = train.where(F.col(exposure) > 0).select(F.col(count).cast("double").alias("_y"), F.col(exposure).cast("double").alias("_e"), *(c.alias(f"_x{i}") for i, c in enumerate(x)))
        for _ in range(steps):
            mu = F.col("_e") * F.exp(F.least(F.lit(30.0), sum((float(b) * F.col(f"_x{i}") for i, b in enumerate(beta)), F.lit(0.0))))
            sums = [F.sum((F.col("_y") - mu) * F.col(f"_x{i}")).alias(f"g{i}") for i in range(n)] + [F.sum(mu * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)]
            got = rows.agg(*sums).first()
            g = np.array([got[f"g{i}"] or 0.0 for i in range(n)])
            h = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
            step = np.linalg.solve(h + 1e-9 * np.eye(n), g)
            beta += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        return F.col(exposure) * F.exp(F.least(F.lit(30.0), sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))))

    return fit


def out_of_fold(df: DataFrame, fold: str, models: dict[str, Model]) -> DataFrame:
    """``df`` with a prediction column per model, each row predicted by models fitted without its fold. Folds are few."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    out = {name: F.lit(None).cast("double") for name in models}
    for f in folds:
        train = df.where(~F.col(fold).eqNullSafe(F.lit(f)))
        for name, model in models.items():
            out[name] = F.when(F.col(fold).eqNullSafe(F.lit(f)), model(train)).otherwise(out[name])
    return df.withColumns(out)


def explained(df: DataFrame, by: list[str], count: str, models: list[str], base: str) -> DataFrame:
    """(by, model, n, deviance, d2): mean Poisson deviance and the share of the base model's that it explains."""
    dev = {m: F.sum(poisson_deviance(F.col(count), F.greatest(F.col(m), F.lit(1e-12)))) for m in {*models, base}}
    g = df.groupBy(*by).agg(F.count("*").alias("n"), *(d.alias(f"_d_{m}") for m, d in dev.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), (F.col(f"_d_{m}") / F.col("n")).alias("deviance"), (1 - F.col(f"_d_{m}") / F.col(f"_d_{base}")).alias("d2")) for m in models)))
    return g.select(*by, "n", rows.alias("r")).select(*by, "r.model", "n", "r.deviance", "r.d2")


def beats(folds: DataFrame, model: str, least_share: float = 0.5) -> bool:
    """Whether a model explains more than the base in more than the share of the folds. Folds are few."""
    rows = [r["d2"] for r in folds.where(F.col("model") == model).collect()]
    return bool(rows) and sum(d > 0 for d in rows) > least_share * len(rows)


def shuffled(df: DataFrame, columns: list[str], by: str, key: str, seed: int) -> DataFrame:
    """``df`` with the columns' values dealt out anew within ``by``, all of a row together, by a seeded order."""
    w = Window.partitionBy(by)
    a = df.withColumn("_i", F.row_number().over(w.orderBy(key)))
    b = df.select(F.col(by).alias("_by"), *(F.col(c).alias(f"_p_{c}") for c in columns), F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), key), key)).alias("_j"))
    out = a.join(b, a[by].eqNullSafe(b["_by"]) & (a["_i"] == b["_j"]))
    return out.withColumns({c: F.col(f"_p_{c}") for c in columns}).drop("_i", "_j", "_by", *(f"_p_{c}" for c in columns))


def importance(df: DataFrame, fold: str, key: str, model: Model, groups: dict[str, list[str]], count: str, seed: int) -> DataFrame:
    """(name, rise): how much the mean deviance out of fold rises when a group of features is dealt out anew in the held-out fold."""
    spark = df.sparkSession
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    fitted = {f: model(df.where(~F.col(fold).eqNullSafe(F.lit(f)))) for f in folds}

    def mean(rows: DataFrame) -> float:
        p = F.lit(None).cast("double")
        for f, c in fitted.items():
            p = F.when(F.col(fold).eqNullSafe(F.lit(f)), c).otherwise(p)
        return float(rows.agg(F.avg(poisson_deviance(F.col(count), F.greatest(p, F.lit(1e-12)))).alias("d")).first()["d"])

    base = mean(df)
    return spark.createDataFrame([(name, mean(shuffled(df, cols, fold, key, seed)) - base) for name, cols in groups.items()], "name string, rise double")


def partial_dependence(df: DataFrame, prediction: Column, feature: str, values: list[float]) -> DataFrame:
    """(value, mean): the mean prediction when the feature has each value in every row."""
    grid = F.explode(F.array(*(F.lit(float(x)) for x in values)))
    return df.withColumn(feature, grid).groupBy(F.col(feature).alias("value")).agg(F.avg(prediction).alias("mean"))


def median_ratio(x: str, y: str) -> Model:
    """log y as log x plus the median log ratio."""

    def fit(train: DataFrame) -> Column:
        m = train.agg(F.median(F.log(y) - F.log(x)).alias("m")).first()["m"]
        return F.log(x) + F.lit(float(m) if m is not None else None).cast("double")

    return fit


def least_absolute(x: str, y: str, covariates: tuple[str, ...] = (), steps: int = 60) -> Model:
    """log y linear in log x and centred covariates by least absolute deviations: weighted least squares, whose weights are the residuals' inverses, by sums that Spark adds up."""

    def fit(train: DataFrame) -> Column:
        centre = train.agg(*(F.median(c).alias(f"c{i}") for i, c in enumerate(covariates))).first() if covariates else {}
        cols = [F.lit(1.0), F.log(x), *(F.col(c) - float(centre[f"c{i}"] or 0.0) for i, c in enumerate(covariates))]
        n = len(cols)
        rows = train.select(F.log(y).alias("_y"), *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(cols))).na.drop()
        beta = np.zeros(n)
        for k in range(steps):
            residual = F.abs(F.col("_y") - sum((float(b) * F.col(f"_x{i}") for i, b in enumerate(beta)), F.lit(0.0)))
            w = F.lit(1.0) if k == 0 else 1 / F.greatest(residual, F.lit(1e-7))
            got = rows.agg(*(F.sum(w * F.col(f"_x{i}") * F.col("_y")).alias(f"g{i}") for i in range(n)), *(F.sum(w * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n))).first()
            if got["g0"] is None:
                break
            h = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
            new = np.linalg.solve(h + 1e-12 * np.eye(n), np.array([got[f"g{i}"] for i in range(n)]))
            done = np.abs(new - beta).max() < 1e-8
            beta = new
            if done:
                break
        return sum((float(b) * c for b, c in zip(beta, cols, strict=True)), F.lit(0.0))

    return fit


def rising(x: str, y: str, knots: int = 64) -> Model:
    """log y as a rising step function of log x: means within quantile bins, pooled until none falls, straight between their middles. Bins bound what comes to the driver."""

    def fit(train: DataFrame) -> Column:
        q = train.agg(F.percentile(F.log(x), F.array(*(F.lit(i / knots) for i in range(1, knots)))).alias("q")).first()["q"] or []
        edges = sorted(set(q))
        b = F.lit(0)
        for e in edges:
            b = b + F.when(F.log(x) > e, 1).otherwise(0)
        rows = train.groupBy(b.alias("b")).agg(F.avg(F.log(x)).alias("u"), F.avg(F.log(y)).alias("v"), F.count("*").alias("n")).orderBy("b").collect()
        pool: list[list[float]] = []
        for r in rows:
            pool.append([r["u"] * r["n"], r["v"] * r["n"], r["n"]])
            while len(pool) > 1 and pool[-2][1] / pool[-2][2] > pool[-1][1] / pool[-1][2]:
                last = pool.pop()
                pool[-1] = [a + c for a, c in zip(pool[-1], last, strict=True)]
        at = [(u / n, v / n) for u, v, n in pool]
        if not at:
            return F.lit(None).cast("double")
        out = F.lit(at[-1][1])
        for (u0, v0), (u1, v1) in reversed(list(zip(at, at[1:], strict=False))):
            out = F.when(F.log(x) < u1, v0 + (F.log(x) - u0) * ((v1 - v0) / (u1 - u0) if u1 > u0 else 0.0)).otherwise(out)
        return F.when(F.log(x) <= at[0][0], F.lit(at[0][1])).otherwise(out)

    return fit


def dealt_folds(df: DataFrame, group: str, most: int = 10) -> DataFrame:
    """``df`` with fold: a fold per group, or, beyond ``most`` groups, groups dealt largest first to the least loaded fold. Groups never split; their sizes come to the driver."""
    sizes = sorted(((r["count"], str(r[group])) for r in df.groupBy(group).count().collect()), key=lambda s: (-s[0], s[1]))
    if len(sizes) <= most:
        of = {g: i for i, g in enumerate(sorted(g for _, g in sizes))}
    else:
        load, of = [0] * most, {}
        for n, g in sizes:
            f = load.index(min(load))
            of[g] = f
            load[f] += n
    table = df.sparkSession.createDataFrame(list(of.items()), "_g string, fold int")
    return df.join(table, F.coalesce(F.col(group).cast("string"), F.lit("None")) == F.col("_g"), "left").drop("_g")


def select_model(df: DataFrame, fold: str, y: str, candidates: dict[str, Model], least_gain: float = 0.02) -> tuple[str, dict[str, float]]:
    """(name, median absolute log error of each): the first candidate unless another's error out of fold is smaller by the least gain."""
    rows = out_of_fold(df, fold, {f"_m_{n}": m for n, m in candidates.items()})
    got = rows.agg(*(F.median(F.abs(F.log(y) - F.col(f"_m_{n}"))).alias(n) for n in candidates)).first()
    errors = {n: float(got[n]) if got[n] is not None else math.inf for n in candidates}
    best = next(iter(candidates))
    for n, e in errors.items():
        if e < errors[best] * (1 - least_gain):
            best = n
    return best, errors


def apply_length(df: DataFrame, prediction: Column, x: str, band: tuple[float, float], seen: tuple[float, float]) -> DataFrame:
    """``df`` with length_cal and its interval, and whether the input lies outside what the model has seen."""
    return df.withColumns({"length_cal": F.exp(prediction), "length_low": F.exp(prediction + band[0]), "length_high": F.exp(prediction + band[1]), "extrapolated": ~F.col(x).between(*seen)})
