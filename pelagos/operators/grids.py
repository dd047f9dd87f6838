"""Fields as tables of cells (row, col, value): sampling, regridding, gradients, fronts and seas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions.geo import KM_PER_DEGREE
from pelagos.operators.graph import connected_components


def sample_cells(points: DataFrame, cells: DataFrame, west: float, north: float, res: float, name: str = "value") -> DataFrame:
    """``points`` (lon, lat) with the value of the cell that holds each; null outside or without value."""
    at = {"_row": F.floor((north - F.col("lat")) / res), "_col": F.floor((F.col("lon") - west) / res)}
    c = cells.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("value").alias(name))
    return points.withColumns(at).join(c, ["_row", "_col"], "left").drop("_row", "_col")


def bilinear(points: DataFrame, cells: DataFrame, key: str, west: float, north: float, res: float, columns: int | None = None, name: str = "value") -> DataFrame:
    """``points`` with the bilinear value of the four cell centres around each; cells without a value drop out and the weights of the rest are scaled up. ``columns`` wraps a global grid."""
    x, y = (F.col("lon") - west) / res - 0.5, (north - F.col("lat")) / res - 0.5
    base = points.select(key, F.floor(y).alias("_r"), F.floor(x).alias("_c"), (y - F.floor(y)).alias("_fy"), (x - F.floor(x)).alias("_fx"))
    corner = lambda dy, dx: F.struct((F.col("_r") + dy).alias("row"), (F.col("_c") + dx).alias("col"), ((F.col("_fy") if dy else 1 - F.col("_fy")) * (F.col("_fx") if dx else 1 - F.col("_fx"))).alias("w"))
    each = base.select(key, F.explode(F.array(*(corner(a, b) for a in (0, 1) for b in (0, 1)))).alias("k")).select(key, "k.*")
    if columns:
        each = each.withColumn("col", F.pmod("col", F.lit(columns)))
    got = each.join(cells.select("row", "col", "value").where("value is not null"), ["row", "col"]).where("w > 0")
    mean = got.groupBy(key).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias(name))
    return points.join(mean, key, "left")


def regrid(cells: DataFrame, factor: int) -> DataFrame:
    """Mean, population deviation and count of the fine cells within each coarse cell of ``factor`` by ``factor``; the deviation is null below two."""
    g = cells.where("value is not null").groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col"))
    return g.agg(F.avg("value").alias("value"), F.when(F.count("*") > 1, F.stddev_pop("value")).alias("sd"), F.count("*").alias("n"))


def share_of(cells: DataFrame, factor: int, hit: Column) -> DataFrame:
    """(row, col, share): the share of the fine cells with a value, within each coarse cell, that ``hit``."""
    x = cells.where("value is not null").select(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col"), F.when(hit, 1.0).otherwise(0.0).alias("_h"))
    return x.groupBy("row", "col").agg(F.avg("_h").alias("share"), F.count("*").alias("n"))


def neighbours(cells: DataFrame, reach: int = 1) -> DataFrame:
    """(row, col, dr, dc, other): each cell with its neighbours' values."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    out = cells.select("row", "col", "value").withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    return out.select((F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), "dr", "dc", F.col("value").alias("other"))


def median_filter(cells: DataFrame) -> DataFrame:
    """3 x 3 median of each cell whose nine values are known; the rest drop out."""
    return neighbours(cells.where("value is not null")).groupBy("row", "col").agg(F.median("other").alias("value"), F.count("*").alias("_n")).where("_n = 9").drop("_n")


def gradient(cells: DataFrame, north: float, res: float) -> DataFrame:
    """(row, col, value): magnitude of the central difference, per km; cells that lack a neighbour to a side drop out. The width of a cell shrinks with the cosine of its latitude."""
    near = neighbours(cells.where("value is not null")).where("abs(dr) + abs(dc) = 1")
    side = lambda r, c: F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("other")))
    g = near.groupBy("row", "col").agg(side(1, 0).alias("s"), side(-1, 0).alias("n"), side(0, 1).alias("e"), side(0, -1).alias("w")).where("s is not null and n is not null and e is not null and w is not null")
    dy = res * KM_PER_DEGREE
    dx = dy * F.cos(F.radians(F.lit(north) - (F.col("row") + 0.5) * res))
    own = cells.select("row", "col")
    return g.join(own, ["row", "col"], "left_semi").select("row", "col", F.sqrt(F.pow((F.col("s") - F.col("n")) / (2 * dy), 2) + F.pow((F.col("e") - F.col("w")) / (2 * dx), 2)).alias("value"))


def _components(cells: DataFrame, width: int, corners: bool) -> DataFrame:
    """(row, col, root): connected cells by sides, or by corners too; every cell has a root."""
    own = cells.select("row", "col", (F.col("row") * width + F.col("col")).alias("id"))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if corners else [])]
    moved = own.select(F.explode(F.array(*(F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col"), F.col("id").alias("a")) for a, b in steps))).alias("m")).select("m.*")
    edges = moved.join(own.select("row", "col", F.col("id").alias("b")), ["row", "col"]).select("a", "b")
    roots = connected_components(edges)
    return own.join(roots, own["id"] == roots["node"], "left").select("row", "col", F.coalesce("root", "id").alias("root"))


def front_cells(grad: DataFrame, low: float, high: float, width: int, least: int = 3) -> DataFrame:
    """Cells above ``low`` whose connected group reaches above ``high`` and has at least ``least`` cells."""
    c = grad.where(F.col("value") > low)
    r = c.join(_components(c, width, corners=True), ["row", "col"])
    good = r.groupBy("root").agg(F.max("value").alias("top"), F.count("*").alias("n")).where((F.col("top") > high) & (F.col("n") >= least))
    return r.join(good, "root", "left_semi").select("row", "col")


def connected_sea(cells: DataFrame, seed: DataFrame, width: int) -> DataFrame:
    """Sea cells (value true) that a walk by sides from the seed cells reaches."""
    r = _components(cells.where("value"), width, corners=False)
    roots = r.join(seed.select("row", "col"), ["row", "col"], "left_semi").select("root").distinct()
    return r.join(roots, "root", "left_semi").select("row", "col")


def quantile_limits(grad: DataFrame, low: float = 0.90, high: float = 0.97) -> tuple[float, float]:
    """The two limits of a front mask as quantiles of all gradient values."""
    q = grad.agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("q")).first()["q"]
    return (math.inf, math.inf) if q is None else (float(q[0]), float(q[1]))
