"""Queries on time: sessions, gaps, as-of joins, tracks, look windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pelagos.functions import geo, scalars
from pelagos.operators import aggregate, temporal
from pelagos.plans.registry import query
from pelagos.sources import views as v


def _sql_sessions(source: str, keys: str, ts: str, tie: str, gap: int, out: str) -> str:
    return f"""WITH e AS ({source}), f AS (SELECT *, CASE WHEN epoch_us({ts}) - epoch_us(lag({ts}) OVER w) > {gap * 1_000_000} THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY {keys} ORDER BY {ts}, {tie})),
s AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY {ts}, {tie} ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS session FROM f) {out}"""


@query(_sql_sessions(v.SQL_AIS, "mmsi", "ts", "event_id", 1800, "SELECT mmsi, session, count(*) AS n, epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1 FROM s GROUP BY mmsi, session"))
def sessionise_gap_30m(spark, sf):
    s = temporal.sessionise(v.ais(spark, sf), ["mmsi"], "ts", 1800, "event_id")
    return s.groupBy("mmsi", "session").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("t0"), F.unix_micros(F.max("ts")).alias("t1"))


@query(_sql_sessions(v.SQL_SCENES, "mission, orbit", "start", "scene_id", 43200, "SELECT mission, orbit, session AS pass_no, count(*) AS scenes, min(scene_id) AS first_scene FROM s GROUP BY ALL"))
def passes_by_orbit(spark, sf):
    s = temporal.sessionise(v.scenes(spark, sf), ["mission", "orbit"], "start", 43200, "scene_id", "pass_no")
    return s.groupBy("mission", "orbit", "pass_no").agg(F.count("*").alias("scenes"), F.min("scene_id").alias("first_scene"))


@query(f"""WITH e AS ({v.SQL_SCENES}), f AS (SELECT *, CASE WHEN epoch_us(start) > epoch_us(max(stop) OVER (PARTITION BY mission, orbit ORDER BY start, stop, scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) + 600000000 THEN 1 ELSE 0 END AS n FROM e),
g AS (SELECT *, sum(n) OVER (PARTITION BY mission, orbit ORDER BY start, stop, scene_id ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS group_no FROM f)
SELECT mission, orbit, group_no, count(*) AS n, epoch_us(min(start)) AS t0, epoch_us(max(stop)) AS t1 FROM g GROUP BY ALL""")
def interval_merge(spark, sf):
    g = temporal.merge_intervals(v.scenes(spark, sf), ["mission", "orbit"], "start", "stop", 600, "scene_id")
    return g.groupBy("mission", "orbit", "group_no").agg(F.count("*").alias("n"), F.unix_micros(F.min("start")).alias("t0"), F.unix_micros(F.max("stop")).alias("t1"))


@query(f"""WITH e AS ({v.SQL_AIS}), g AS (SELECT mmsi, epoch_us(ts) AS gap_start, epoch_us(lead(ts) OVER (PARTITION BY mmsi ORDER BY ts, event_id)) AS gap_end FROM e)
SELECT mmsi, gap_start, gap_end, (gap_end - gap_start) / 1000000 AS gap_s, CASE WHEN gap_end - gap_start < 43200000000 THEN 'silence' WHEN gap_end - gap_start <= 259200000000 THEN 'extended' ELSE 'prolonged' END AS grade FROM g WHERE gap_end - gap_start > 21600000000""")
def vessel_silences(spark, sf):
    g = temporal.gaps(v.ais(spark, sf), ["mmsi"], "ts", 21600, "event_id")
    return g.select("mmsi", F.unix_micros("gap_start").alias("gap_start"), F.unix_micros("gap_end").alias("gap_end"), "gap_s", scalars.silence_grade(F.col("gap_s") / 3600).alias("grade"))


@query(f"""WITH e AS ({v.SQL_AIS}), s AS (SELECT *, {geo.sql_haversine_m("lag(lon) OVER w", "lag(lat) OVER w", "lon", "lat")} AS m, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000 AS dt FROM e WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id))
SELECT event_id, mmsi, round(m, 1) AS step_m, round(CASE WHEN dt > 0 THEN m / dt / 0.514444::DOUBLE END, 3) AS step_kn FROM s WHERE m IS NULL OR dt <= 0 OR m / dt / 0.514444::DOUBLE <= 60""")
def jump_filter(spark, sf):
    s = temporal.speed_from_previous(v.ais(spark, sf), "mmsi", "ts", "event_id", geo.haversine_m)
    return s.where("step_kn is null or step_kn <= 60").select("event_id", "mmsi", F.round("step_m", 1).alias("step_m"), F.round("step_kn", 3).alias("step_kn"))


@query(f"""WITH e AS ({v.SQL_AIS}), d AS (SELECT DISTINCT mmsi, ts::DATE AS day, true AS seen FROM e), c AS (SELECT mmsi, day FROM (SELECT DISTINCT mmsi FROM e), (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM e), (SELECT max(ts)::DATE FROM e), INTERVAL 1 DAY))::DATE AS day)),
x AS (SELECT c.mmsi, c.day, CASE WHEN d.seen THEN 1.0::DOUBLE ELSE 0 END AS seen FROM c LEFT JOIN d ON d.mmsi = c.mmsi AND d.day = c.day),
w AS (SELECT mmsi, count(*) OVER p AS n, row_number() OVER o AS i, max(seen) OVER (PARTITION BY mmsi ORDER BY day ROWS BETWEEN CURRENT ROW AND CURRENT ROW) AS k1, max(seen) OVER (PARTITION BY mmsi ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k3, max(seen) OVER (PARTITION BY mmsi ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS k7 FROM x WINDOW p AS (PARTITION BY mmsi), o AS (PARTITION BY mmsi ORDER BY day))
SELECT mmsi, round(avg(k1), 6) AS p_1d, round(avg(k3) FILTER (WHERE i <= n - 2), 6) AS p_3d, round(avg(k7) FILTER (WHERE i <= n - 6), 6) AS p_7d FROM w GROUP BY mmsi""")
def look_probability_7d(spark, sf):
    a = v.ais(spark, sf).select("mmsi", F.to_date("ts").alias("day"))
    seen = a.distinct().withColumn("seen", F.lit(1.0))
    span = a.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))  # days of the recording
    dense = a.select("mmsi").distinct().join(F.broadcast(span)).join(seen, ["mmsi", "day"], "left").na.fill(0.0, ["seen"])
    p = temporal.look_probability(dense, ["mmsi"], "day", "seen", (1, 3, 7))
    return p.select("mmsi", *(F.round(c, 6).alias(c) for c in ("p_1d", "p_3d", "p_7d")))


@query(f"""WITH a AS ({v.SQL_AIS}), s AS (SELECT event_id AS at_id, ts AS at FROM a WHERE msg_type = 'purchase'),
p AS (SELECT s.at_id, a.mmsi, (epoch_us(a.ts) - epoch_us(s.at)) / 1000000 AS dt, a.event_id, a.lon, a.lat FROM s JOIN a ON abs(epoch_us(a.ts) - epoch_us(s.at)) <= 1800000000),
b AS (SELECT at_id, mmsi, min(struct_pack(gap := abs(dt), tie := event_id, lon := lon, lat := lat)) FILTER (WHERE dt <= 0) AS b, min(struct_pack(gap := abs(dt), tie := event_id, lon := lon, lat := lat)) FILTER (WHERE dt > 0) AS a FROM p GROUP BY ALL)
SELECT at_id, mmsi, round(CASE WHEN both_near THEN b.lon + b.gap / (b.gap + a.gap) * (a.lon - b.lon) WHEN first THEN b.lon ELSE a.lon END, 4) AS lon, round(CASE WHEN both_near THEN b.lat + b.gap / (b.gap + a.gap) * (a.lat - b.lat) WHEN first THEN b.lat ELSE a.lat END, 4) AS lat, CASE WHEN both_near THEN 'interpolated' ELSE 'nearest' END AS method
FROM (SELECT *, coalesce(b.gap <= 1800 AND a.gap <= 1800, false) AS both_near, coalesce(a IS NULL OR b.gap <= a.gap, false) AS first FROM b)""")
def bracket_interpolate(spark, sf):
    a = v.ais(spark, sf)
    at = a.where("msg_type = 'purchase'").select(F.col("event_id").alias("at_id"), F.col("ts").alias("at"))
    out = temporal.bracket(a.select("event_id", "mmsi", "ts", "lon", "lat"), at, "mmsi", "ts", "at", "event_id", 1800, 1800.0)
    return out.select("at_id", "mmsi", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), "method")


@query(f"""WITH a AS ({v.SQL_AIS}), e AS (SELECT event_id, ts, floor(epoch_us(ts) / 7200000000)::BIGINT AS slot FROM a WHERE msg_type = 'error'), p AS (SELECT event_id AS near, ts, floor(epoch_us(ts) / 7200000000)::BIGINT AS slot FROM a WHERE msg_type = 'signup'),
j AS (SELECT e.event_id, min(struct_pack(d := abs(epoch_us(p.ts) - epoch_us(e.ts)), n := p.near)) AS b FROM e, generate_series(-1, 1) g(k) JOIN p ON p.slot = e.slot + g.k WHERE abs(epoch_us(p.ts) - epoch_us(e.ts)) <= 7200000000 GROUP BY e.event_id)
SELECT e.event_id, j.b.n AS near_id, round(j.b.d / 1000000, 6) AS near_dt_s FROM e LEFT JOIN j USING (event_id)""")
def nearest_in_time(spark, sf):
    a = v.ais(spark, sf)
    out = temporal.nearest_in_time(a.where("msg_type = 'error'").select("event_id", "ts"), a.where("msg_type = 'signup'").select("event_id", "ts"), "ts", "ts", "event_id", 7200)
    return out.select("event_id", "near_id", F.round("near_dt_s", 6).alias("near_dt_s"))


@query(f"WITH a AS ({v.SQL_AIS}) SELECT (ts - INTERVAL 5 HOUR)::DATE::VARCHAR AS night, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first_seen, count(*) AS n, count(*) FILTER (WHERE strftime(ts, '%H:%M:%S') >= '22:00:00' OR strftime(ts, '%H:%M:%S') <= '02:30:00') AS in_window FROM a GROUP BY 1")
def nights_and_windows(spark, sf):
    a = v.ais(spark, sf)
    hit = scalars.in_utc_windows(F.col("ts"), [("22:00:00", "02:30:00")])
    return a.groupBy(scalars.night_of(F.col("ts")).cast("string").alias("night")).agg(scalars.iso_z(F.min("ts")).alias("first_seen"), F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("in_window"))


@query(f"WITH a AS ({v.SQL_AIS}) SELECT ts::DATE::VARCHAR AS day, " + ", ".join(f"count(*) FILTER (WHERE msg_type = '{t}') AS n_{t}" for t in ("view", "signup", "purchase", "error", "click")) + " FROM a GROUP BY 1")
def timeline_day_pivot(spark, sf):
    a = v.ais(spark, sf)
    return a.groupBy(F.to_date("ts").cast("string").alias("day")).agg(*(F.count(F.when(F.col("msg_type") == t, 1)).alias(f"n_{t}") for t in ("view", "signup", "purchase", "error", "click")))


@query(f"""WITH a AS ({v.SQL_AIS}), n AS (SELECT *, count(*) OVER (PARTITION BY mmsi) AS n, row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) - 1 AS i FROM a)
SELECT event_id, mmsi FROM n WHERE n <= 20 OR floor(round(i::DOUBLE * 19 / (n - 1)) * (n - 1) / 19 + 0.5) = i""")
def track_downsample(spark, sf):
    return temporal.downsample(v.ais(spark, sf), "mmsi", "ts", "event_id", 20).select("event_id", "mmsi")


@query(f"""WITH s AS ({v.SQL_SCENES}), l AS (SELECT *, row_number() OVER (PARTITION BY orbit ORDER BY start DESC, scene_id DESC) AS r FROM s)
SELECT orbit, scene_id, k, epoch_us(start) + k * 12 * 86400 * 1000000 AS predicted FROM l, generate_series(1, 3) g(k) WHERE r = 1""")
def predict_passes(spark, sf):
    latest = aggregate.top_n(v.scenes(spark, sf), ["orbit"], [F.desc("start"), F.desc("scene_id")], 1)
    return latest.select("orbit", "scene_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("k"), "start").select("orbit", "scene_id", "k", (F.unix_micros("start") + F.col("k") * 12 * 86400 * 1000000).alias("predicted"))


@query(f"""WITH a AS ({v.SQL_AIS}), h AS (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM a WHERE msg_type = 'error'), g AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour)
SELECT epoch_us(hour) AS silent_hour FROM g WHERE hour NOT IN (SELECT hour FROM h)""")
def silent_hours(spark, sf):
    h = v.ais(spark, sf).where("msg_type = 'error'").select(F.date_trunc("hour", "ts").alias("hour")).distinct()
    span = h.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return span.join(h, "hour", "left_anti").select(F.unix_micros("hour").alias("silent_hour"))


@query("""WITH l AS (SELECT user_id AS lead_id, event_type AS state, event_id FROM events) SELECT lead_id, arg_max(state, event_id) AS state, count(*) AS n_entries FROM l GROUP BY lead_id""")
def last_decision_state(spark, sf):
    log = v.table(spark, sf, "events").select(F.col("user_id").alias("lead_id"), F.col("event_type").alias("state"), "event_id")
    return temporal.latest_state(log, "lead_id", ["event_id"], "state")


@query("""SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_type IS NOT NULL) AS event_type, arg_max(CASE WHEN value > 50 THEN value END, event_id) FILTER (WHERE value > 50) AS big_value, arg_max(CASE WHEN event_type = 'error' THEN props END, event_id) FILTER (WHERE event_type = 'error') AS error_props FROM events GROUP BY user_id""")
def latest_non_null(spark, sf):
    e = v.table(spark, sf, "events").withColumn("big_value", F.when(F.col("value") > 50, F.col("value"))).withColumn("error_props", F.when(F.col("event_type") == "error", F.col("props")))
    return aggregate.latest_non_null(e, "user_id", F.col("event_id"), ["event_type", "big_value", "error_props"])


@query(f"""WITH a AS ({v.SQL_AIS}), d AS (SELECT *, row_number() OVER (PARTITION BY mmsi, date_trunc('hour', ts), msg_type ORDER BY ts, event_id) AS r FROM a) SELECT event_id, mmsi, msg_type FROM d WHERE r = 1""")
def content_dedupe(spark, sf):
    w = Window.partitionBy("mmsi", F.date_trunc("hour", "ts"), "msg_type").orderBy("ts", "event_id")
    return v.ais(spark, sf).withColumn("r", F.row_number().over(w)).where("r = 1").select("event_id", "mmsi", "msg_type")
