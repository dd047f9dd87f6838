"""Passes, plans and hourly tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import geo
from pelagos.operators import around, claims
from pelagos.storage import materialise


def _micros(c) -> Column:
    return F.unix_micros(c)


def hourly_tracks(presence: DataFrame, key: str) -> DataFrame:
    """(key, t, lon, lat, n_points, speed_kmh): one point per vessel and hour (presence: key, ts, lon, lat), at the hour's middle, with the track's largest speed between consecutive points (null with one)."""
    mid = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 3600) * 3600 + 1800)
    points = presence.withColumn("t", mid).groupBy(key, "t").agg(F.min_by(F.struct("lon", "lat"), F.struct("ts", "lon", "lat")).alias("p")).select(key, "t", "p.lon", "p.lat")
    w = Window.partitionBy(key).orderBy("t")
    step = geo.haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")) / 1000
    hours = (F.unix_seconds("t") - F.unix_seconds(F.lag("t").over(w))) / 3600
    whole = Window.partitionBy(key)
    return points.withColumn("_v", step / hours).withColumns({"speed_kmh": F.max("_v").over(whole), "n_points": F.count("*").over(whole)}).drop("_v")


def track_position(tracks: DataFrame, at: DataFrame, key: str, target: str, within_h: int) -> DataFrame:
    """``at`` (with key and a target time) and the track's place then: linear between points, held at the ends; dh is the whole-hour offset of the nearest point. Only points within the hours are looked at."""
    unit = within_h * 3600
    slot = lambda c: F.floor(F.unix_seconds(c) / unit)
    a = at.withColumn("_s", F.explode(F.sequence(slot(target) - 1, slot(target) + 1)))
    p = tracks.select(F.col(key).alias("_k"), "t", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), slot("t").alias("_p"))
    dt = (F.unix_seconds("t") - F.unix_seconds(target)).cast("double")
    x = a.join(p, (a[key] == p["_k"]) & (a["_s"] == p["_p"])).withColumn("_dt", dt).where(F.abs("_dt") <= unit)
    row = F.struct(F.abs("_dt").alias("g"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), F.col("_dt").alias("dt"))
    best = x.groupBy(*at.columns).agg(F.min(F.when(F.col("_dt") <= 0, row)).alias("b"), F.min(F.when(F.col("_dt") > 0, row)).alias("f"), F.min(F.struct(F.abs("_dt").alias("g"), F.col("_dt").alias("dt"))).alias("n"))
    share = F.col("b.g") / (F.col("b.g") + F.col("f.g"))
    mix = lambda c: F.when(F.col("b").isNull(), F.col(f"f.{c}")).when(F.col("f").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"b.{c}") + share * (F.col(f"f.{c}") - F.col(f"b.{c}")))
    return best.select(*at.columns, mix("lon").alias("lon"), mix("lat").alias("lat"), F.rint(F.col("n.dt") / 3600).cast("int").alias("dh"))


def pair_presence(contacts: DataFrame, presence: DataFrame, max_dh: int = 1, cand_m: float = 6000.0, keep_m: float = 3000.0, most_kmh: float = 10.0) -> DataFrame:
    """(det_id, vessel, dist_m, speed_kmh, cost): contacts (det_id, ia, lon, lat, acq) and vessels (vessel, ib, ts, lon, lat) heard in an hour nearby whose track passes close enough and slowly enough at the scene's time, one to one by km plus a tenth of the speed."""
    hour = lambda c: F.floor(F.unix_seconds(c) / 3600)
    hours = lambda: F.explode(F.sequence(hour("acq") - max_dh, hour("acq") + max_dh))
    tracks = materialise(hourly_tracks(presence.select("vessel", "ts", "lon", "lat"), "vessel"), "tracks")
    slow = tracks.where(F.col("speed_kmh").isNull() | (F.col("speed_kmh") <= most_kmh)).groupBy("vessel").agg(F.first("speed_kmh").alias("speed_kmh"))
    heard = presence.select("vessel", "ib", hour("ts").alias("_h"), "lon", "lat")
    # A vessel's place at a scene's time is the same for all the scene's contacts: it is worked out once, and only close pairs are made.
    moments = contacts.select("acq").distinct().withColumn("_h", hours())
    known = heard.join(slow, "vessel").select("vessel", "ib", "speed_kmh", "_h").distinct().join(moments, "_h").select("vessel", "ib", "speed_kmh", "acq").distinct()
    placed = materialise(track_position(tracks, known, "vessel", "acq", 24).select("vessel", "ib", "speed_kmh", "acq", "lon", "lat"), "placed")
    # Of the reports of the hours only those matter from which some contact of the circle may have been heard.
    own = heard.where("lon is not null and lat is not null").withColumn("_own", F.struct("lon", "lat")).select(F.col("vessel").alias("_v"), F.col("ib").alias("_ib"), F.col("_h").alias("_hour"), "_own")
    hourly = placed.where("lon is not null and lat is not null and ib is not null").withColumn("_h", hours())
    near = geo.haversine_m(F.col("_own.lon"), F.col("_own.lat"), F.col("lon"), F.col("lat")) <= keep_m + cand_m + 1.0
    joined = hourly.join(own, (F.col("vessel") == F.col("_v")) & (F.col("ib") == F.col("_ib")) & (F.col("_h") == F.col("_hour")) & near)
    sides = joined.groupBy("vessel", "ib", "speed_kmh", "acq", "lon", "lat").agg(F.collect_set("_own").alias("own")).withColumn("slow", F.coalesce("speed_kmh", F.lit(0.0)) / 10)
    sides = materialise(sides, "sides")
    won = claims.cheapest_first(contacts, sides, keep_m, cand_m)
    # The pairs' rows, a few more where an id has several.
    c = contacts.select("det_id", "ia", "acq", F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"))
    x = won.select("ia", "ib").join(c, "ia").join(sides, ["ib", "acq"]).withColumn("dist_m", geo.haversine_m(F.col("c_lon"), F.col("c_lat"), F.col("lon"), F.col("lat")))
    close = F.exists("own", lambda p: geo.haversine_m(F.col("c_lon"), F.col("c_lat"), p["lon"], p["lat"]) <= cand_m)
    x = x.where((F.col("dist_m") <= keep_m) & close).withColumn("cost", F.col("dist_m") / 1000 + F.col("slow"))
    return x.select("det_id", "vessel", "dist_m", "speed_kmh", "cost").distinct()


def nearest_presence(contacts: DataFrame, presence: DataFrame, reach_m: float, max_dh: int = 1, count_m: float = 10_000.0) -> DataFrame:
    """``contacts`` (det_id, lon, lat, acq) with the nearest vessel of the hours around (the earlier offset of equals), its distance and offset in hours, and the vessels within ``count_m`` in the same hour."""
    return around.heard_by_hour(contacts, presence, "vessel", "acq", "ts", reach_m, count_m, max_dh).withColumnRenamed("n_near", "n_10km")


def repeat_drift(passes: DataFrame, keys: list[str], start: str, cycle_days: int = 12) -> DataFrame:
    """(keys, start, cycles, drift_s) of consecutive passes at least one cycle apart: how far they are from a whole number of cycles."""
    w = Window.partitionBy(*keys).orderBy(start)
    d = (_micros(start) - _micros(F.lag(start).over(w))) / 1_000_000
    unit = cycle_days * 86400
    out = passes.withColumn("_d", d).withColumn("cycles", F.rint(F.col("_d") / unit).cast("long"))
    return out.where("cycles >= 1").select(*keys, start, "cycles", (F.col("_d") - F.col("cycles") * unit).alias("drift_s"))


def newest_plan(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Segments (mission, file, begin) that no newer file of the mission covers: files (mission, file, t0, t1) are newer by their start, then by name. Files are few per mission."""
    own = files.select("mission", "file", F.struct("t0", "file").alias("_rank"))
    newer = files.select("mission", F.col("t0").alias("_a"), F.col("t1").alias("_b"), F.struct("t0", "file").alias("_newer"))
    s = segments.where(F.col("begin").isNotNull()).join(own, ["mission", "file"])
    covered = s.join(newer, "mission").where("_newer > _rank and begin between _a and _b").select("mission", "file", "begin").distinct()
    return s.drop("_rank").join(covered, ["mission", "file", "begin"], "left_anti")


def merge_slices(slices: DataFrame, key: str) -> DataFrame:
    """Slices of one data take as one footprint: least start, last stop, the first slice's attributes, the union's box."""
    first = F.struct("start", "slice_id")
    return slices.groupBy(key).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("mission", first).alias("mission"), F.count("*").alias("slices"), *(F.min(c).alias(c) for c in ("west", "south")), *(F.max(c).alias(c) for c in ("east", "north")))


def blank_conflicts(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row per key, the first in order; a column that has different values within the key is null."""
    one = rows.groupBy(key).agg(*(F.min_by(c, F.struct(*order)).alias(c) for c in columns), *(F.count_distinct(c).alias(f"_n_{c}") for c in columns))
    return one.select(key, *(F.when(F.col(f"_n_{c}") <= 1, F.col(c)).alias(c) for c in columns))


def pass_counts(footprints: DataFrame, res: float) -> DataFrame:
    """(cx, cy, passes): footprint boxes over the centre of each corner-anchored cell of ``res`` degrees; cells without any are left out."""
    span = lambda a, b: F.explode(F.sequence(F.ceil(F.col(a) / res - 0.5), F.ceil(F.col(b) / res - 0.5) - 1))
    some = footprints.where(F.ceil(F.col("west") / res - 0.5) < F.ceil(F.col("east") / res - 0.5)).where(F.ceil(F.col("south") / res - 0.5) < F.ceil(F.col("north") / res - 0.5))
    return some.withColumn("cx", span("west", "east")).withColumn("cy", span("south", "north")).groupBy("cx", "cy").agg(F.count("*").alias("passes"))


def coverage_stats(counts: DataFrame, res: float, least: tuple[int, ...] = (1, 2, 4), days: float = 90.0) -> DataFrame:
    """One row: area, shares of it imaged at least so often, the mean number of passes by area, and the mean days between them."""
    area = geo.cell_area_km2(F.col("cy") * res, res)
    x = counts.withColumn("_a", area)
    total = F.sum("_a")
    return x.agg(F.round(total, 3).alias("area_km2"), *(F.round(F.sum(F.when(F.col("passes") >= k, F.col("_a")).otherwise(0)) / total, 6).alias(f"share_{k}") for k in least), F.round(F.sum(F.col("passes") * F.col("_a")) / total, 6).alias("mean_passes"), F.round(days / (F.sum(F.col("passes") * F.col("_a")) / total), 6).alias("revisit_days"))


def block_hours(contacts: DataFrame, daily: DataFrame, res: float) -> DataFrame:
    """``contacts`` (det_id, lon, lat, date) with hours_day and hours_window: presence hours of daily cells (lon, lat, date, hours) in the 3 x 3 cells around, on the date and over all dates."""
    cell = lambda df: df.withColumns({"_cx": geo.centre_key(F.col("lon"), res), "_cy": geo.centre_key(F.col("lat"), res)})
    steps = F.sequence(F.lit(-1), F.lit(1))
    sums = cell(daily).groupBy("_cx", "_cy", "date").agg(F.sum("hours").alias("h"))
    around = sums.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).groupBy((F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_cy") + F.col("_dy")).alias("_cy"), "date").agg(F.sum("h").alias("h"))
    c = cell(contacts)
    out = c.join(around.withColumnRenamed("h", "hours_day"), ["_cx", "_cy", "date"], "left").join(around.groupBy("_cx", "_cy").agg(F.sum("h").alias("hours_window")), ["_cx", "_cy"], "left")
    return out.drop("_cx", "_cy").na.fill(0.0, ["hours_day", "hours_window"])


def reach_by_days(contacts: DataFrame, daily: DataFrame, n_days: int, res: float) -> DataFrame:
    """``contacts`` with reach: the share of the window's days with presence in the contact's cell; null without days."""
    cell = lambda df: df.withColumns({"_cx": geo.centre_key(F.col("lon"), res), "_cy": geo.centre_key(F.col("lat"), res)})
    days = cell(daily).where("hours > 0").select("_cx", "_cy", "date").distinct().groupBy("_cx", "_cy").agg(F.count("*").alias("_d"))
    share = F.coalesce("_d", F.lit(0)) / n_days if n_days > 0 else F.lit(None).cast("double")
    return cell(contacts).join(days, ["_cx", "_cy"], "left").withColumn("reach", share).drop("_cx", "_cy", "_d")


def review_samples(df: DataFrame, seed: int, n_leads: int, n_ambiguous: int, n_other: int, box: float = 0.05) -> DataFrame:
    """(kind, det_id) for review: the highest-scored unmatched contacts, a seeded sample of the ambiguous ones, and one per box of those without coverage."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), "det_id"), 256)
    a = df.where("ais_status = 'unmatched' and not coalesce(match_ambiguous, false)").orderBy(F.desc_nulls_last("cnn_score"), "det_id").limit(n_leads).select(F.lit("lead").alias("kind"), "det_id")
    b = df.where("coalesce(match_ambiguous, false)").orderBy(key, "det_id").limit(n_ambiguous).select(F.lit("ambiguous").alias("kind"), "det_id")
    one = df.where("ais_status = 'no_coverage'").groupBy(F.floor(F.col("lon") / box).alias("bx"), F.floor(F.col("lat") / box).alias("by")).agg(F.min("det_id").alias("det_id"))
    return a.unionByName(b).unionByName(one.orderBy("det_id").limit(n_other).select(F.lit("no_coverage").alias("kind"), "det_id"))
