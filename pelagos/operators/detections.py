"""Rules on detected objects: classes, clutter zones, fixed structures, persistence, earlier scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.operators import proximity


def confidence(vv: Column, vh: Column, scr_vv_db: Column, n_pixels: Column, length_m: Column, strong_db: float = 12.0, least_px: int = 3, longest_m: float = 450.0) -> tuple[Column, Column]:
    """(class, reason): too long is low; both channels high; VH alone, or VV alone and strong, medium; else low."""
    long = F.coalesce(length_m > longest_m, F.lit(False))
    one = (vh & ~vv) | (vv & ~vh & F.coalesce((scr_vv_db >= strong_db) & (n_pixels >= least_px), F.lit(False)))
    kind = F.when(long, "low").when(vv & vh, "high").when(one, "medium").otherwise("low")
    return kind, F.when(long, "oversized").when(kind == "low", "weak_vv_only").otherwise("")


def clutter_zone(df: DataFrame, radius_m: float = 1000.0, least: int = 5, group: str = "scene_id") -> DataFrame:
    """``df`` (det_id, lon, lat, confidence) with n_low, the low objects of the same scene within the radius, and clutter for high and medium ones among at least ``least``."""
    low = df.where("confidence = 'low'").select("lon", "lat", group)
    n = proximity.within(df.select("det_id", "lon", "lat", group), low, radius_m, extra=(group,)).groupBy("det_id").agg(F.count("*").alias("n_low"))
    out = df.drop("n_low").join(n, "det_id", "left").na.fill(0, ["n_low"])
    return out.withColumn("clutter", F.col("confidence").isin("high", "medium") & (F.col("n_low") >= least))


def near_fixed(df: DataFrame, radius_m: float = 250.0, group: str = "scene_id", reach_m: float = 1000.0) -> DataFrame:
    """``df`` with fixed_m, the distance to the nearest other fixed object of the scene within reach, and near_fixed for high and medium ones within the radius."""
    fixed = df.where("confidence = 'fixed'").select("det_id", "lon", "lat", group)
    d = proximity.within(df.select("det_id", "lon", "lat", group), fixed, reach_m, extra=(group,)).where("det_id <> r_det_id").groupBy("det_id").agg(F.min("dist_m").alias("fixed_m"))
    out = df.join(d, "det_id", "left")
    return out.withColumn("near_fixed", F.col("confidence").isin("high", "medium") & F.coalesce(F.col("fixed_m") <= radius_m, F.lit(False)))


def persistence(main: DataFrame, others: DataFrame, date: str, radius_m: float = 50.0) -> DataFrame:
    """``main`` with persist_dates, the other dates with any object within the radius, and fixed where all dates checked have one; class 'fixed' then."""
    checked = others.select(date).distinct().agg(F.count("*").alias("checked"))
    hit = proximity.within(main.select("det_id", "lon", "lat"), others.select("lon", "lat", date), radius_m).groupBy("det_id").agg(F.count_distinct(f"r_{date}").alias("persist_dates"))
    out = main.join(hit, "det_id", "left").na.fill(0, ["persist_dates"]).crossJoin(F.broadcast(checked))  # one row on the right
    fixed = (F.col("checked") > 0) & (F.col("persist_dates") >= F.col("checked")) & F.col("confidence").isin("high", "medium")
    return out.withColumn("confidence", F.when(fixed, "fixed").otherwise(F.col("confidence")))


def earlier_scenes(scenes: DataFrame, most: int = 2, least_days: float = 1.0, most_days: float = 30.0) -> DataFrame:
    """(scene_id, earlier_id): the latest earlier scenes (scene_id, orbit, direction, start, box) of the same track, within the days, whose box holds the scene's centre."""
    a = scenes.select("scene_id", "orbit", "direction", F.col("start").alias("_t"), ((F.col("west") + F.col("east")) / 2).alias("_x"), ((F.col("south") + F.col("north")) / 2).alias("_y"))
    b = scenes.select(F.col("scene_id").alias("earlier_id"), "orbit", "direction", "start", "west", "south", "east", "north")
    age = (F.unix_micros("_t") - F.unix_micros("start")) / 86_400_000_000
    inside = (F.col("_x") >= F.col("west")) & (F.col("_x") <= F.col("east")) & (F.col("_y") >= F.col("south")) & (F.col("_y") <= F.col("north"))
    pairs = a.join(b, ["orbit", "direction"]).where((age >= least_days) & (age <= most_days) & inside)
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("start"), F.desc("earlier_id")))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= most).select("scene_id", "earlier_id", F.col("_r").alias("rank"))
