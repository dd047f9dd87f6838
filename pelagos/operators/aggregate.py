"""Aggregations and statistics as DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_non_null(df: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """Per key the last value of each column that is not null, by ``order``."""
    return df.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns))


def reach_share(df: DataFrame, cell: Column, ts: Column, entity: str) -> DataFrame:
    """Per cell the share of all recorded hours with a report, and the different entities heard."""
    hourly = df.select(cell.alias("cell"), F.date_trunc("hour", ts).alias("hour"), F.col(entity).alias("entity")).where("cell is not null")
    hours = hourly.select("hour").distinct().agg(F.count("*").alias("n_hours"))
    heard = hourly.select("cell", "hour").distinct().groupBy("cell").agg(F.count("*").alias("hours"))
    who = hourly.select("cell", "entity").distinct().groupBy("cell").agg(F.count("entity").alias("entities"))
    return heard.join(who, "cell").crossJoin(F.broadcast(hours)).select("cell", "hours", "entities", (F.col("hours") / F.col("n_hours")).alias("share"))  # one row on the right


def crosstab(df: DataFrame, row: Column, column: str, values: list[str], name: str = "bin") -> DataFrame:
    """Counts of ``values`` per row, zero where none."""
    return df.groupBy(row.alias(name)).agg(*(F.count(F.when(F.col(column) == v, 1)).alias(v) for v in values))


def shares_with_total(df: DataFrame, group: str, kind: str) -> DataFrame:
    """Count and share of each kind per group, and over all groups as 'all'."""
    counts = df.where(F.col(group).isNotNull() & F.col(kind).isNotNull()).rollup(kind, group).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    counts = counts.where("g in (0, 1)").select(F.coalesce(F.col(group).cast("string"), F.lit("all")).alias("grp"), F.col(kind).alias("kind"), "n")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp")))


def waterfall(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: rows left after each condition in turn, and rows that fail each on its own; unknown fails."""
    left, out = F.lit(True), [F.count("*").alias("n_all")]
    for name, c in conditions.items():
        good = F.coalesce(c, F.lit(False))
        left = left & good
        out += [F.count(F.when(left, 1)).alias(f"left_{name}"), F.count(F.when(~good, 1)).alias(f"fail_{name}")]
    return df.agg(*out)


def average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ranks from 1, ties sharing their mean."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn(name, F.rank().over(w) + (ties - 1) / 2)


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation per group over rows where both are known."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_rank(average_rank(known, by, a, "_ra"), by, b, "_rb")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def shrink_rates(units: DataFrame, unit: str, group: str, count: str, exposure: str) -> DataFrame:
    """Empirical-Bayes rates: each unit's rate is drawn to its group's mean by the share of variance between units."""
    g = units.groupBy(group).agg((F.sum(count) / F.sum(exposure)).alias("mean_rate"), F.sum(exposure).alias("total"), F.count("*").alias("units"))
    x = units.join(g, group)
    v = x.groupBy(group).agg(F.first("mean_rate").alias("mean_rate"), F.first("total").alias("total"), F.first("units").alias("units"), F.sum(F.col(exposure) * F.pow(F.col(count) / F.col(exposure) - F.col("mean_rate"), 2)).alias("ss"))
    between = F.greatest(F.lit(0.0), F.col("ss") / F.col("total") - F.col("mean_rate") / (F.col("total") / F.col("units")))
    v = v.select(group, between.alias("between"))
    y = x.join(v, group)
    weight = F.col("between") / (F.col("between") + F.col("mean_rate") / F.col(exposure))
    weight = F.when(F.col("between") > 0, weight).otherwise(0.0)
    return y.select(unit, group, (F.col("mean_rate") + weight * (F.col(count) / F.col(exposure) - F.col("mean_rate"))).alias("rate"))


def false_discovery(df: DataFrame, p: str, tiebreak: str, by: list[str]) -> DataFrame:
    """``df`` with Benjamini-Hochberg q values within each family."""
    up = Window.partitionBy(*by).orderBy(p, tiebreak)
    n = F.count("*").over(Window.partitionBy(*by))
    x = df.where(F.col(p).isNotNull()).withColumn("_raw", F.col(p) * n / F.row_number().over(up)).withColumn("_k", F.row_number().over(up))
    down = Window.partitionBy(*by).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_raw", "_k")


def weighted_deciles(df: DataFrame, by: list[str], order: list[str], weight: str, n: int = 10) -> DataFrame:
    """``df`` with the bin of its cumulative weight share, 0 to n - 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    share = (F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) / 2) / F.sum(weight).over(Window.partitionBy(*by))
    return df.withColumn("decile", F.least(F.lit(n - 1), F.floor(share * n)).cast("int"))


def precision_recall(df: DataFrame, by: list[str], truth: Column, said: Column) -> DataFrame:
    tp, fp, fn = (F.count(F.when(c, 1)) for c in (truth & said, ~truth & said, truth & ~said))
    out = df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = (F.when(F.col("tp") + F.col(x) > 0, F.col("tp") / (F.col("tp") + F.col(x))) for x in ("fp", "fn"))
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def pr_curve(df: DataFrame, by: list[str], score: str, truth: Column) -> DataFrame:
    """Precision and recall at every distinct score, rows at or above it said to be true."""
    at = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.count(F.when(truth, 1)).alias("pos"))
    w = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    all_pos = F.sum("pos").over(Window.partitionBy(*by))
    return at.select(*by, score, (F.sum("pos").over(w) / F.sum("n").over(w)).alias("precision"), (F.sum("pos").over(w) / all_pos).alias("recall"))


def modal_label(df: DataFrame, by: list[str], label: str, name: str = "label") -> DataFrame:
    """The most common label per group, the smallest on ties; its share and the different labels."""
    n = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(name), (F.max("n") / F.sum("n")).alias("label_share"), F.count("*").alias("labels"))


def cell_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sum, count, mean, population deviation (two values or more) and extremes of the known values."""
    sd = F.when(F.count(value) > 1, F.stddev_pop(value))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), sd.alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def conformal_band(df: DataFrame, by: list[str], residual: str, tiebreak: str, level: float = 0.8) -> DataFrame:
    """Finite-sample residual quantiles at ranks floor((n + 1) a) and ceil((n + 1)(1 - a))."""
    a = (1 - level) / 2
    w = Window.partitionBy(*by).orderBy(residual, tiebreak)
    x = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    lo, hi = F.greatest(F.lit(1), F.floor((F.col("_n") + 1) * a)), F.least(F.col("_n"), F.ceil((F.col("_n") + 1) * (1 - a)))
    return x.groupBy(*by).agg(F.max(F.when(F.col("_i") == lo, F.col(residual))).alias("low"), F.max(F.when(F.col("_i") == hi, F.col(residual))).alias("high"), F.count("*").alias("n"))


def recall_by_bin(found: DataFrame, missed: DataFrame, bin_: Column) -> DataFrame:
    """(bin, found, missed, recall) over the bins of either table."""
    a, b = (df.groupBy(bin_.alias("bin")).agg(F.count("*").alias(n)) for df, n in ((found, "found"), (missed, "missed")))
    out = a.join(b, "bin", "full").na.fill(0, ["found", "missed"]).where("bin is not null")
    return out.withColumn("recall", F.col("found") / (F.col("found") + F.col("missed")))


def within_budget(df: DataFrame, by: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows in order while their running size stays within the budget of their group; what comes after the first that does not fit is dropped."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_total", F.sum(size).over(w)).where(F.col("_total") <= budget).drop("_total")
