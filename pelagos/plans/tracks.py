"""Queries on passes, plans and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos.functions import geo
from pelagos.operators import temporal, tracks
from pelagos.plans.registry import query
from pelagos.sources import views as v

_POINTS = f"pts AS (SELECT mmsi AS vessel, floor(epoch_us(ts) / 3600000000) * 3600 + 1800 AS t, arg_min(struct_pack(lon := lon, lat := lat), struct_pack(a := ts, b := lon, c := lat)) AS p FROM ({v.SQL_REPORTS}) GROUP BY 1, 2), tr AS (SELECT vessel, t, p.lon AS lon, p.lat AS lat FROM pts), sp AS (SELECT *, {geo.sql_haversine_m('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} / 1000 / ((t - lag(t) OVER w) / 3600) AS sv FROM tr WINDOW w AS (PARTITION BY vessel ORDER BY t)), tracks AS (SELECT vessel, t, lon, lat, max(sv) OVER (PARTITION BY vessel) AS speed_kmh, count(*) OVER (PARTITION BY vessel) AS n_points FROM sp)"


@query(f"WITH {_POINTS} SELECT vessel, t::BIGINT AS t, round(lon, 6) AS lon, round(lat, 6) AS lat, round(speed_kmh, 4) AS speed_kmh, n_points FROM tracks")
def hourly_tracks(spark, sf):
    r = v.reports(spark, sf).withColumnRenamed("mmsi", "vessel")
    return tracks.hourly_tracks(r, "vessel").select("vessel", F.unix_seconds("t").alias("t"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("speed_kmh", 4).alias("speed_kmh"), "n_points")


@query(f"""WITH {_POINTS}, s AS (SELECT scene_id, epoch_us(acq) // 1000000 AS a FROM ({v.SQL_OBJECT_SCENES})), x AS (SELECT s.scene_id, k.vessel, k.lon, k.lat, k.t - s.a AS dt FROM s, tracks k WHERE abs(k.t - s.a) <= 21600),
b AS (SELECT scene_id, vessel, min(struct_pack(g := abs(dt), lon := lon, lat := lat, d := dt)) FILTER (WHERE dt <= 0) AS b, min(struct_pack(g := abs(dt), lon := lon, lat := lat, d := dt)) FILTER (WHERE dt > 0) AS f, min(struct_pack(g := abs(dt), d := dt)) AS n FROM x GROUP BY ALL)
SELECT scene_id, vessel, round(CASE WHEN b IS NULL THEN f.lon WHEN f IS NULL THEN b.lon ELSE b.lon + b.g / (b.g + f.g) * (f.lon - b.lon) END, 7) AS lon, round(CASE WHEN b IS NULL THEN f.lat WHEN f IS NULL THEN b.lat ELSE b.lat + b.g / (b.g + f.g) * (f.lat - b.lat) END, 7) AS lat, round_even(n.d / 3600, 0)::INTEGER AS dh FROM b""")
def track_positions(spark, sf):
    """Where each vessel's hourly track is at the scenes' times."""
    r = v.reports(spark, sf).withColumnRenamed("mmsi", "vessel")
    t = tracks.hourly_tracks(r, "vessel")
    at = v.object_scenes(spark, sf).select("scene_id", "acq").crossJoin(t.select("vessel").distinct())  # forty scenes
    return tracks.track_position(t, at, "vessel", "acq", 6).select("scene_id", "vessel", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), "dh")


@query()
def presence_pairs(spark, sf):
    """Contacts and vessels of the hour, paired one to one by distance and speed."""
    o = v.objects(spark, sf).withColumn("ia", F.col("k"))
    p = v.reports(spark, sf).select(F.col("mmsi").alias("vessel"), F.col("mmsi").alias("ib"), "ts", "lon", "lat")
    return tracks.pair_presence(o, p, most_kmh=100.0).select("det_id", "vessel", F.round("dist_m", 2).alias("dist_m"), F.round("cost", 4).alias("cost"))


@query(f"""WITH o AS (SELECT det_id, lon, lat, floor(epoch_us(acq) / 3600000000)::BIGINT AS h FROM ({v.SQL_OBJECTS}) WHERE k % 20 = 0), r AS (SELECT mmsi, lon, lat, floor(epoch_us(ts) / 3600000000)::BIGINT AS h FROM ({v.SQL_REPORTS})), p AS (SELECT o.det_id, r.mmsi, r.h - o.h AS dh, {geo.sql_haversine_m('o.lon', 'o.lat', 'r.lon', 'r.lat')} AS d FROM o JOIN r ON r.h BETWEEN o.h - 1 AND o.h + 1),
b AS (SELECT det_id, min(struct_pack(d := d, h := dh, v := mmsi)) FILTER (WHERE d <= 5000) AS b, count(DISTINCT mmsi) FILTER (WHERE dh = 0 AND d <= 10000) AS n FROM p GROUP BY 1)
SELECT o.det_id, b.b.v AS near_vessel, round(b.b.d, 2) AS near_m, b.b.h::INTEGER AS near_dh, coalesce(b.n, 0) AS n_10km FROM o LEFT JOIN b USING (det_id)""")
def nearest_presence(spark, sf):
    o = v.objects(spark, sf).where("k % 20 = 0")
    out = tracks.nearest_presence(o, v.reports(spark, sf).withColumnRenamed("mmsi", "vessel"), 5000.0)
    return out.select("det_id", "near_vessel", F.round("near_m", 2).alias("near_m"), "near_dh", "n_10km")


@query(f"""WITH s AS (SELECT mission, orbit, start FROM ({v.SQL_SCENES})), d AS (SELECT mission, orbit, start, (epoch_us(start) - epoch_us(lag(start) OVER (PARTITION BY mission, orbit ORDER BY start))) / 1000000 AS d FROM s), c AS (SELECT *, round_even(d / 1036800, 0)::BIGINT AS cycles FROM d)
SELECT mission, orbit, epoch_us(start) AS start, cycles, d - cycles * 1036800 AS drift_s FROM c WHERE cycles >= 1""")
def repeat_drift(spark, sf):
    return tracks.repeat_drift(v.scenes(spark, sf).select("mission", "orbit", "start"), ["mission", "orbit"], "start").withColumn("start", F.unix_micros("start"))


_FILES = "SELECT n_regionkey::BIGINT AS mission, 'f' || n_nationkey AS file, n_nationkey * 5 AS t0, n_nationkey * 5 + 60 AS t1 FROM nation"
_SEGMENTS = "SELECT n.n_regionkey::BIGINT AS mission, 'f' || n.n_nationkey AS file, (o.o_orderkey * 7 % 180)::BIGINT AS b, o.o_orderkey FROM orders o JOIN nation n ON n.n_nationkey = o.o_custkey % 25"


@query(f"""WITH f AS ({_FILES}), s AS ({_SEGMENTS}) SELECT s.mission, s.file, s.o_orderkey AS id FROM s JOIN f USING (mission, file) WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.mission = s.mission AND (g.t0 > f.t0 OR (g.t0 = f.t0 AND g.file > f.file)) AND s.b BETWEEN g.t0 AND g.t1)""")
def newest_plan(spark, sf):
    """Planned segments that no newer file of the mission covers."""
    n = v.table(spark, sf, "nation")
    day = lambda c: F.timestamp_seconds(c * 86400)
    files = n.select(F.col("n_regionkey").cast("long").alias("mission"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("file"), day(F.col("n_nationkey") * 5).alias("t0"), day(F.col("n_nationkey") * 5 + 60).alias("t1"))
    o = v.table(spark, sf, "orders").withColumn("n", (F.col("o_custkey") % 25).cast("int"))
    s = o.join(n, o["n"] == n["n_nationkey"]).select(F.col("n_regionkey").cast("long").alias("mission"), F.concat(F.lit("f"), F.col("n").cast("string")).alias("file"), day(F.col("o_orderkey") * 7 % 180).alias("begin"), "o_orderkey")
    return tracks.newest_plan(s, files).select("mission", "file", F.col("o_orderkey").alias("id"))


_SLICES = f"SELECT scene_id AS slice_id, scene_id // 3 AS take, mission, start, stop, (scene_id * 13 % 700)::DOUBLE / 100 AS west, (scene_id * 13 % 700)::DOUBLE / 100 + 0.63::DOUBLE AS east, (scene_id * 29 % 500)::DOUBLE / 100 AS south, (scene_id * 29 % 500)::DOUBLE / 100 + 0.41::DOUBLE AS north FROM ({v.SQL_SCENES})"


def _slices(spark, sf):
    w, s = (F.col("scene_id") * 13 % 700) / F.lit(100.0), (F.col("scene_id") * 29 % 500) / F.lit(100.0)
    return v.scenes(spark, sf).select(F.col("scene_id").alias("slice_id"), F.expr("scene_id div 3").alias("take"), "mission", "start", "stop", w.alias("west"), (w + 0.63).alias("east"), s.alias("south"), (s + 0.41).alias("north"))


@query(f"WITH s AS ({_SLICES}) SELECT take, epoch_us(min(start)) AS start, epoch_us(max(stop)) AS stop, arg_min(mission, struct_pack(a := start, b := slice_id)) AS mission, count(*) AS slices, round(min(west), 4) AS west, round(min(south), 4) AS south, round(max(east), 4) AS east, round(max(north), 4) AS north FROM s GROUP BY take")
def merged_slices(spark, sf):
    out = tracks.merge_slices(_slices(spark, sf), "take")
    return out.select("take", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "mission", "slices", *(F.round(c, 4).alias(c) for c in ("west", "south", "east", "north")))


_COUNTS = f"c AS (SELECT x AS cx, y AS cy, count(*) AS passes FROM ({_SLICES}) s, generate_series(ceil(west / 0.25 - 0.5)::BIGINT, ceil(east / 0.25 - 0.5)::BIGINT - 1) g(x), generate_series(ceil(south / 0.25 - 0.5)::BIGINT, ceil(north / 0.25 - 0.5)::BIGINT - 1) h(y) GROUP BY ALL)"


@query(f"WITH {_COUNTS} SELECT * FROM c")
def pass_counts(spark, sf):
    """Footprints over each cell's centre."""
    return tracks.pass_counts(_slices(spark, sf), 0.25)


@query(f"""WITH {_COUNTS}, a AS (SELECT passes, power(6371.0088, 2) * radians(0.25) * (sin(radians(cy * 0.25 + 0.25)) - sin(radians(cy * 0.25))) AS a FROM c)
SELECT round(sum(a), 3) AS area_km2, round(sum(CASE WHEN passes >= 1 THEN a ELSE 0 END) / sum(a), 6) AS share_1, round(sum(CASE WHEN passes >= 2 THEN a ELSE 0 END) / sum(a), 6) AS share_2, round(sum(CASE WHEN passes >= 4 THEN a ELSE 0 END) / sum(a), 6) AS share_4, round(sum(passes * a) / sum(a), 6) AS mean_passes, round(90 / (sum(passes * a) / sum(a)), 6) AS revisit_days FROM a""")
def coverage_summary(spark, sf):
    return tracks.coverage_stats(tracks.pass_counts(_slices(spark, sf), 0.25), 0.25)


@query("""WITH r AS (SELECT o_custkey AS id, o_orderkey AS k, o_orderstatus AS a, o_orderpriority AS b FROM orders), f AS (SELECT id, arg_min(a, k) AS a, count(DISTINCT a) AS na, arg_min(b, k) AS b, count(DISTINCT b) AS nb FROM r GROUP BY id)
SELECT id, CASE WHEN na <= 1 THEN a END AS status, CASE WHEN nb <= 1 THEN b END AS priority FROM f""")
def blanked_conflicts(spark, sf):
    """One row per key; a field with conflicting values is blank."""
    o = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return tracks.blank_conflicts(o, "id", ["k"], ["status", "priority"])


@query(f"""WITH s AS (SELECT mission, start, scene_id, CASE WHEN epoch_us(start) - epoch_us(lag(start) OVER (PARTITION BY mission ORDER BY start, scene_id)) > 1200000000 THEN 1 ELSE 0 END AS n FROM ({v.SQL_SCENES})), p AS (SELECT mission, sum(n) OVER (PARTITION BY mission ORDER BY start, scene_id ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS pass_no FROM s) SELECT mission, count(DISTINCT pass_no) AS passes, count(*) AS scenes FROM p GROUP BY mission""")
def satellite_passes(spark, sf):
    """Passes per satellite: a gap of more than twenty minutes begins the next."""
    s = temporal.sessionise(v.scenes(spark, sf), ["mission"], "start", 1200, "scene_id", "pass_no")
    return s.groupBy("mission").agg(F.count_distinct("pass_no").alias("passes"), F.count("*").alias("scenes"))


_DAILY = f"SELECT lon, lat, (k % 9)::BIGINT AS date, (k % 4)::DOUBLE AS hours FROM ({v.SQL_LIGHTS})"


@query(f"""WITH d AS (SELECT floor(lon / 0.01 + 0.5)::BIGINT AS cx, floor(lat / 0.01 + 0.5)::BIGINT AS cy, date, hours FROM ({_DAILY})), o AS (SELECT det_id, floor(lon / 0.01 + 0.5)::BIGINT AS cx, floor(lat / 0.01 + 0.5)::BIGINT AS cy, k % 9 AS date FROM ({v.SQL_OBJECTS}))
SELECT o.det_id, coalesce(sum(hours) FILTER (WHERE d.date = o.date), 0) AS hours_day, coalesce(sum(hours), 0) AS hours_window, coalesce(count(DISTINCT d.date) FILTER (WHERE d.cx = o.cx AND d.cy = o.cy AND hours > 0), 0)::DOUBLE / 9 AS reach FROM o LEFT JOIN d ON d.cx BETWEEN o.cx - 1 AND o.cx + 1 AND d.cy BETWEEN o.cy - 1 AND o.cy + 1 GROUP BY o.det_id""")
def presence_hours(spark, sf):
    """Presence hours around each contact, and the share of days with presence in its cell."""
    daily = v.lights(spark, sf).select("lon", "lat", (F.col("k") % 9).alias("date"), (F.col("k") % 4).cast("double").alias("hours"))
    o = v.objects(spark, sf).select("det_id", "lon", "lat", (F.col("k") % 9).alias("date"))
    return tracks.reach_by_days(tracks.block_hours(o, daily, 0.01), daily, 9, 0.01).select("det_id", "hours_day", "hours_window", "reach")


@query(f"""WITH o AS ({v.SQL_OBJECTS}), a AS (SELECT 'lead' AS kind, det_id FROM o WHERE ais_status = 'unmatched' AND NOT coalesce(match_ambiguous, false) ORDER BY cnn_score DESC NULLS LAST, det_id LIMIT 20), b AS (SELECT 'ambiguous' AS kind, det_id FROM o WHERE coalesce(match_ambiguous, false) ORDER BY sha256('7:' || det_id), det_id LIMIT 10),
c AS (SELECT 'no_coverage' AS kind, min(det_id) AS det_id FROM o WHERE ais_status = 'no_coverage' GROUP BY floor(lon / 0.05), floor(lat / 0.05) ORDER BY det_id LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def review_samples(spark, sf):
    return tracks.review_samples(v.objects(spark, sf), 7, 20, 10, 10)


@query(f"""WITH s AS (SELECT *, scene_id % 3 AS direction FROM (SELECT scene_id, mission, orbit % 9 AS orbit, start, (scene_id * 13 % 300)::DOUBLE / 100 AS west, (scene_id * 13 % 300)::DOUBLE / 100 + 2 AS east, (scene_id * 29 % 200)::DOUBLE / 100 AS south, (scene_id * 29 % 200)::DOUBLE / 100 + 2 AS north FROM ({v.SQL_SCENES}) WHERE scene_id % 5 = 0)),
p AS (SELECT a.scene_id, b.scene_id AS earlier_id, row_number() OVER (PARTITION BY a.scene_id ORDER BY b.start DESC, b.scene_id DESC) AS rank FROM s a JOIN s b ON a.orbit = b.orbit AND a.direction = b.direction AND (epoch_us(a.start) - epoch_us(b.start)) / 86400000000 BETWEEN 1 AND 30 AND (a.west + a.east) / 2 BETWEEN b.west AND b.east AND (a.south + a.north) / 2 BETWEEN b.south AND b.north) SELECT scene_id, earlier_id, rank::INTEGER AS rank FROM p WHERE rank <= 2""")
def earlier_scenes(spark, sf):
    """The two latest earlier scenes of the same track over each scene."""
    from pelagos.operators import detections

    w, s = (F.col("scene_id") * 13 % 300) / F.lit(100.0), (F.col("scene_id") * 29 % 200) / F.lit(100.0)
    x = v.scenes(spark, sf).where("scene_id % 5 = 0").select("scene_id", (F.col("orbit") % 9).alias("orbit"), (F.col("scene_id") % 3).alias("direction"), "start", w.alias("west"), (w + 2).alias("east"), s.alias("south"), (s + 2).alias("north"))
    return detections.earlier_scenes(x)


@query(f"""WITH o AS ({v.SQL_OBJECTS}), m AS (SELECT * FROM o WHERE scene_id < 4), q AS (SELECT lon, lat, scene_id AS date FROM o WHERE scene_id >= 36), h AS (SELECT m.det_id, count(DISTINCT q.date) AS n FROM m JOIN q ON abs(m.lat - q.lat) < 0.006 WHERE {geo.sql_haversine_m('m.lon', 'm.lat', 'q.lon', 'q.lat')} <= 600 GROUP BY 1)
SELECT m.det_id, coalesce(h.n, 0) AS persist_dates, (SELECT count(DISTINCT date) FROM q) AS checked, CASE WHEN coalesce(h.n, 0) >= (SELECT count(DISTINCT date) FROM q) AND (SELECT count(DISTINCT date) FROM q) > 0 AND confidence IN ('high', 'medium') THEN 'fixed' ELSE confidence END AS confidence FROM m LEFT JOIN h USING (det_id)""")
def structure_persistence(spark, sf):
    """Objects that recur on all checked dates are fixed; the radius is wide here, as these objects are spread wide."""
    from pelagos.operators import detections

    o = v.objects(spark, sf)
    others = o.where("scene_id >= 36").select("lon", "lat", F.col("scene_id").alias("date"))
    return detections.persistence(o.where("scene_id < 4"), others, "date", 600.0).select("det_id", "persist_dates", "checked", "confidence")


@query(f"""WITH o AS (SELECT *, k % 2 = 0 AS vv, k % 3 = 0 AS vh, (k % 30)::DOUBLE AS scr, k % 9 AS px, length_m * 2 AS len2 FROM ({v.SQL_OBJECTS}))
SELECT det_id, CASE WHEN len2 > 450 THEN 'low' WHEN vv AND vh THEN 'high' WHEN (vh AND NOT vv) OR (vv AND NOT vh AND scr >= 12 AND px >= 3) THEN 'medium' ELSE 'low' END AS class, CASE WHEN len2 > 450 THEN 'oversized' WHEN (vv AND vh) OR (vh AND NOT vv) OR (vv AND NOT vh AND scr >= 12 AND px >= 3) THEN '' ELSE 'weak_vv_only' END AS reason FROM o""")
def detection_classes(spark, sf):
    from pelagos.operators import detections

    k = F.col("k")
    kind, reason = detections.confidence(k % 2 == 0, k % 3 == 0, (k % 30).cast("double"), k % 9, F.col("length_m") * 2)
    return v.objects(spark, sf).select("det_id", kind.alias("class"), reason.alias("reason"))
