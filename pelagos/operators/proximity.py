"""Spatial joins on the sphere through a grid of cells.

Points fall into cells of ``res`` degrees. One side is copied to the cells that its search circle touches, the
other keeps its own, and an equi-join on the cell finds every pair within the radius; the exact distance
decides. The columns a circle spans grow with latitude, so the copies cover the radius wherever the point lies.
A dense cell becomes a large join partition, which adaptive execution splits; null coordinates match nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions.geo import EARTH_M, KM_PER_DEGREE, centre_key, haversine_m


def _grid_res(radius_m: float) -> float:
    """Cells of about the radius, so a circle touches three rows."""
    return max(0.01, radius_m / 1000 / KM_PER_DEGREE)


def _covering(lon: Column, lat: Column, radius_m: float, res: float) -> tuple[Column, Column]:
    """Arrays of the rows and columns that the circle may touch."""
    d_lat = radius_m / 1000 / KM_PER_DEGREE * 1.0001
    widest = F.least(F.abs(lat) + d_lat, F.lit(89.0))
    d_lon = d_lat / F.cos(F.radians(widest))
    rows = F.sequence(F.floor((lat - d_lat) / res), F.floor((lat + d_lat) / res))
    cols = F.sequence(F.floor((lon - d_lon) / res), F.floor((lon + d_lon) / res))
    return rows, cols


def within(left: DataFrame, right: DataFrame, radius_m: float, prefix: str = "r_", earth_m: float = EARTH_M, extra: tuple[str, ...] = ()) -> DataFrame:
    """All pairs at most ``radius_m`` apart: the left columns, the right ones with ``prefix``, and dist_m. ``extra`` names columns that must be equal."""
    res = _grid_res(radius_m)
    rows, cols = _covering(F.col("lon"), F.col("lat"), radius_m, res)
    a = left.where("lon is not null and lat is not null").withColumn("_row", F.explode(rows)).withColumn("_col", F.explode(cols))
    b = right.where("lon is not null and lat is not null").select(*(F.col(c).alias(prefix + c) for c in right.columns), F.floor(F.col("lat") / res).alias("_row"), F.floor(F.col("lon") / res).alias("_col"))
    on = (a["_row"] == b["_row"]) & (a["_col"] == b["_col"])
    for c in extra:
        on = on & (a[c] == b[prefix + c])
    pairs = a.join(b, on).drop("_row", "_col")
    dist = haversine_m(F.col("lon"), F.col("lat"), F.col(f"{prefix}lon"), F.col(f"{prefix}lat"), earth_m)
    return pairs.withColumn("dist_m", dist).where(F.col("dist_m") <= radius_m)


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, radius_m: float, prefix: str = "r_") -> DataFrame:
    """``left`` with the id of the nearest right point within the radius and its distance, ties to the smaller id; nulls if none."""
    pairs = within(left.select(key, "lon", "lat"), right.select(right_key, "lon", "lat"), radius_m, prefix)
    best = pairs.groupBy(key).agg(F.min(F.struct("dist_m", F.col(prefix + right_key).alias("id"))).alias("b"))
    return left.join(best.select(key, F.col("b.id").alias("nearest_id"), F.col("b.dist_m").alias("nearest_m")), key, "left")


def count_within(left: DataFrame, right: DataFrame, key: str, counted: str, radius_m: float, prefix: str = "r_") -> DataFrame:
    """``left`` with n_within: different values of ``counted`` within the radius."""
    pairs = within(left.select(key, "lon", "lat"), right.select(counted, "lon", "lat"), radius_m, prefix)
    # Different pairs first, so that the count needs no set per key in memory.
    n = pairs.select(key, prefix + counted).distinct().groupBy(key).agg(F.count("*").alias("n"))
    return left.join(n, key, "left").withColumn("n_within", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def heard(left: DataFrame, right: DataFrame, key: str, radius_m: float) -> DataFrame:
    """Keys of the left points with any right point within the radius (a semi-join)."""
    return within(left.select(key, "lon", "lat"), right.select("lon", "lat"), radius_m).select(key).distinct()


def block_join(left: DataFrame, right: DataFrame, res: float, keys: tuple[str, ...] = (), prefix: str = "r_") -> DataFrame:
    """Pairs in the same or a neighbouring cell of the centre-anchored grid, equal in ``keys``, with dist_m."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    a = left.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    a = a.withColumn("_cx", centre_key(F.col("lon"), res) + F.col("_dx")).withColumn("_cy", centre_key(F.col("lat"), res) + F.col("_dy")).drop("_dx", "_dy")
    b = right.select(*(F.col(c).alias(prefix + c) for c in right.columns), centre_key(F.col("lon"), res).alias("_cx"), centre_key(F.col("lat"), res).alias("_cy"))
    on = (a["_cx"] == b["_cx"]) & (a["_cy"] == b["_cy"])
    for k in keys:
        on = on & (a[k] == b[prefix + k])
    return a.join(b, on).drop("_cx", "_cy").withColumn("dist_m", haversine_m(F.col("lon"), F.col("lat"), F.col(f"{prefix}lon"), F.col(f"{prefix}lat")))


def block_counts(left: DataFrame, right: DataFrame, key: str, entity: str, res: float) -> DataFrame:
    """(key, n, entities): right rows, and different values of ``entity``, in the 3 x 3 cells around each left row; rows without any are left out.

    The right side is counted per cell first and only these counts go to the neighbouring cells.
    """
    cell = lambda df: df.withColumns({"_cx": centre_key(F.col("lon"), res), "_cy": centre_key(F.col("lat"), res)})
    steps = F.sequence(F.lit(-1), F.lit(1))
    own = cell(right).groupBy("_cx", "_cy", F.col(entity).alias("_e")).agg(F.count("*").alias("_n"))
    around = own.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumns({"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")})
    sums = around.groupBy("_cx", "_cy", "_e").agg(F.sum("_n").alias("_n")).groupBy("_cx", "_cy").agg(F.sum("_n").alias("n"), F.count("_e").alias("entities"))
    return cell(left.select(key, "lon", "lat")).join(sums, ["_cx", "_cy"]).groupBy(key).agg(F.sum("n").alias("n"), F.max("entities").alias("entities"))


def self_space_time(df: DataFrame, key: str, radius_m: float, seconds: int, ts: str, prefix: str = "r_") -> DataFrame:
    """Each unordered pair of rows within the radius and ``seconds`` once, the earlier row (then the smaller key) on the left."""
    bucket = F.floor(F.unix_micros(ts) / (seconds * 1_000_000))
    a = df.withColumn("_slot", F.explode(F.sequence(bucket, bucket + 1)))
    pairs = within(a, df.withColumn("_slot", bucket), radius_m, prefix, extra=("_slot",)).drop("_slot", f"{prefix}_slot")
    dt = (F.unix_micros(F.col(prefix + ts)) - F.unix_micros(F.col(ts))) / 1_000_000
    first = (F.col(ts) < F.col(prefix + ts)) | ((F.col(ts) == F.col(prefix + ts)) & (F.col(key) < F.col(prefix + key)))
    return pairs.where(first).withColumn("dt_s", dt).where(F.col("dt_s") <= seconds)


def space_time(left: DataFrame, right: DataFrame, radius_m: float, seconds: int, left_ts: str, right_ts: str, prefix: str = "r_") -> DataFrame:
    """Pairs within the radius and within ``seconds``: the join key is the cell and a time bucket of that length, so neither side is scanned against all of the other."""
    bucket = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    a = left.withColumn("_slot", F.explode(F.sequence(bucket(F.col(left_ts)) - 1, bucket(F.col(left_ts)) + 1)))
    b = right.withColumn("_slot", bucket(F.col(right_ts)))
    pairs = within(a, b, radius_m, prefix, extra=("_slot",)).drop("_slot", f"{prefix}_slot")
    dt = (F.unix_micros(F.col(prefix + right_ts)) - F.unix_micros(F.col(left_ts))) / 1_000_000
    return pairs.withColumn("dt_s", dt).where(F.abs("dt_s") <= seconds)


def ring_for(radius_m: float, res: float, max_lat: float) -> int:
    """Neighbour cells to each side that a circle reaches at ``max_lat``."""
    return math.ceil(radius_m / 1000 / (res * KM_PER_DEGREE * math.cos(math.radians(max_lat))))
