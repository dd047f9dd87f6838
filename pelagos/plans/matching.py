"""Queries of live matching: placed vessels, feasible pairs, ambiguity, quality, expected radar positions."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from pelagos.functions import geo
from pelagos.operators import matching as m
from pelagos.operators import rivals
from pelagos.plans.registry import query
from pelagos.sources import views as v

KN = "0.514444::DOUBLE"
METRE = f"{180 / (math.pi * geo.EARTH_M)!r}::DOUBLE"

_PLACED = f"""r AS ({v.SQL_REPORTS}), s AS ({v.SQL_OBJECT_SCENES}),
near AS (SELECT s.scene_id, r.*, epoch_us(r.ts) AS t, (epoch_us(r.ts) - epoch_us(s.acq)) / 1000000 AS dt FROM s JOIN r ON abs(epoch_us(r.ts) - epoch_us(s.acq)) <= 1800000000),
sides AS (SELECT scene_id, mmsi, max(struct_pack(t := t, e := event_id, dt := dt, lon := lon, lat := lat)) FILTER (WHERE dt <= 0) AS b, min(struct_pack(t := t, e := event_id, dt := dt, lon := lon, lat := lat)) FILTER (WHERE dt > 0) AS f,
    min(struct_pack(gap := abs(dt), t := t, e := event_id, dt := dt, lon := lon, lat := lat, sog := sog_kn, cog := cog_deg)) AS n, count(*) AS n_reports, arg_max(length_m, struct_pack(t := t, e := event_id)) FILTER (WHERE length_m IS NOT NULL) AS length_m FROM near GROUP BY ALL),
w AS (SELECT *, coalesce(-b.dt <= 1800 AND f.dt <= 1800, false) AS two, n.sog IS NOT NULL AND n.cog IS NOT NULL AS moving FROM sides),
placed AS (SELECT scene_id, mmsi, CASE WHEN two THEN 'interp' WHEN moving THEN 'extrap' ELSE 'nearest' END AS method, CASE WHEN two THEN least(-b.dt, f.dt) ELSE n.gap END AS dt_s, n.sog AS sog_kn, n_reports, length_m,
    CASE WHEN two THEN b.lon + -b.dt / (f.dt - b.dt) * (f.lon - b.lon) WHEN moving THEN n.lon + n.sog * {KN} * -n.dt * sin(radians(n.cog)) * {METRE} / cos(radians(n.lat)) ELSE n.lon END AS lon,
    CASE WHEN two THEN b.lat + -b.dt / (f.dt - b.dt) * (f.lat - b.lat) WHEN moving THEN n.lat + n.sog * {KN} * -n.dt * cos(radians(n.cog)) * {METRE} ELSE n.lat END AS lat,
    CASE WHEN moving AND n.gap <= 600 THEN n.sog WHEN two THEN sqrt(pow((f.lon - b.lon) * cos(radians(b.lat)) / {METRE} / (f.dt - b.dt), 2) + pow((f.lat - b.lat) / {METRE} / (f.dt - b.dt), 2)) / {KN} END AS speed_kn FROM w WHERE two OR n.gap <= 600)"""


@query(f"WITH {_PLACED} SELECT scene_id, mmsi, method, round(dt_s, 3) AS dt_s, sog_kn, n_reports, length_m, round(lon, 7) AS lon, round(lat, 7) AS lat, round(speed_kn, 3) AS speed_kn FROM placed")
def placed_vessels(spark, sf):
    """Every vessel that can be placed at a scene's time: interpolated, dead-reckoned or its nearest report."""
    p = m.positions_at(v.reports(spark, sf), v.object_scenes(spark, sf))
    return p.select("scene_id", "mmsi", "method", F.round("dt_s", 3).alias("dt_s"), "sog_kn", "n_reports", "length_m", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), F.round("speed_kn", 3).alias("speed_kn"))


_PAIRS = f"""{_PLACED}, o AS ({v.SQL_OBJECTS}), x AS (SELECT o.scene_id, o.det_id, p.mmsi, {geo.sql_haversine_m("o.lon", "o.lat", "p.lon", "p.lat")} AS dist_m, o.length_m, p.length_m AS length_ais, o.confidence, coalesce(p.sog_kn, p.speed_kn) AS speed_kn, p.dt_s FROM o JOIN placed p ON o.scene_id = p.scene_id AND abs(o.lat - p.lat) < 0.02),
g AS (SELECT *, CASE WHEN speed_kn IS NULL THEN 2000::DOUBLE ELSE least(500 + 125 * abs(speed_kn) * {KN}, 2000) END AS gate_m FROM x),
pairs AS (SELECT * FROM g WHERE dist_m <= gate_m AND NOT coalesce(CASE WHEN length_ais > 0 THEN length_m / length_ais END < 0.25, false) AND NOT (confidence = 'fixed' AND coalesce(speed_kn, 0) >= 2))"""


def _pairs(spark, sf):
    return m.candidate_pairs(v.objects(spark, sf), m.positions_at(v.reports(spark, sf), v.object_scenes(spark, sf)))


@query(f"WITH {_PAIRS} SELECT scene_id, det_id, mmsi, round(dist_m, 3) AS dist_m, round(gate_m, 3) AS gate_m FROM pairs")
def feasible_pairs(spark, sf):
    """Contacts and placed vessels within the speed-aware gate and through the pairing rules."""
    return _pairs(spark, sf).select("scene_id", "det_id", "mmsi", F.round("dist_m", 3).alias("dist_m"), F.round("gate_m", 3).alias("gate_m"))


_TAKEN = f"""{_PAIRS}, taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, det_id ORDER BY dist_m, mmsi) AS a, row_number() OVER (PARTITION BY scene_id, mmsi ORDER BY dist_m, det_id) AS b FROM pairs) WHERE a = 1 AND b = 1)"""


def _mutual(pairs):
    """Pairs that are nearest for both ends."""
    a = F.row_number().over(Window.partitionBy("scene_id", "det_id").orderBy("dist_m", "mmsi"))
    b = F.row_number().over(Window.partitionBy("scene_id", "mmsi").orderBy("dist_m", "det_id"))
    return pairs.withColumn("_a", a).withColumn("_b", b).where("_a = 1 and _b = 1").drop("_a", "_b")


@query(f"""WITH {_TAKEN}, y AS (SELECT p.scene_id, p.det_id, p.mmsi, p.dist_m, c.dist_m AS cd, t.dist_m AS vd FROM pairs p LEFT JOIN taken c ON p.scene_id = c.scene_id AND p.det_id = c.det_id LEFT JOIN taken t ON p.scene_id = t.scene_id AND p.mmsi = t.mmsi WHERE c.mmsi IS DISTINCT FROM p.mmsi),
fc AS (SELECT scene_id, det_id, min(dist_m) AS a, list(DISTINCT mmsi::VARCHAR) AS ms FROM y WHERE cd IS NOT NULL AND dist_m < greatest(cd + 100, 1.5 * cd) AND (vd IS NULL OR dist_m < greatest(vd + 100, 1.5 * vd)) GROUP BY ALL),
fv AS (SELECT scene_id, mmsi, min(dist_m) AS b FROM y WHERE vd IS NOT NULL AND dist_m < greatest(vd + 100, 1.5 * vd) AND (cd IS NULL OR dist_m < greatest(cd + 100, 1.5 * cd)) GROUP BY ALL)
SELECT t.scene_id, t.det_id, t.mmsi, fc.a IS NOT NULL OR fv.b IS NOT NULL AS ambiguous, round(least(fc.a, fv.b), 3) AS alt_dist_m, CASE WHEN fc.a IS NOT NULL OR fv.b IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_append(coalesce(ms, []), t.mmsi::VARCHAR))), ';') END AS candidates FROM taken t LEFT JOIN fc USING (scene_id, det_id) LEFT JOIN fv USING (scene_id, mmsi)""")
def pair_ambiguity(spark, sf):
    """Mutually nearest pairs that another vessel or contact could as well explain."""
    out = rivals.ambiguous_pairs(v.objects(spark, sf), m.positions_at(v.reports(spark, sf), v.object_scenes(spark, sf)))
    return out.select("scene_id", "det_id", "mmsi", "ambiguous", F.round("alt_dist_m", 3).alias("alt_dist_m"), "candidates")


@query(f"""WITH {_TAKEN}, q AS (SELECT *, CASE WHEN length_ais > 0 THEN length_m / length_ais END AS ratio, abs(speed_kn) * {KN} * abs(dt_s) AS track FROM taken)
SELECT scene_id, det_id, mmsi, CASE WHEN dist_m <= 200 AND coalesce(track <= 1000, abs(dt_s) <= 300) AND (ratio IS NULL OR ratio BETWEEN 0.4 AND 3.0) THEN 'high' WHEN dist_m <= 500 AND coalesce(track <= 3000, abs(dt_s) <= 900) AND (ratio IS NULL OR ratio BETWEEN 0.25 AND 4.0) THEN 'medium' ELSE 'low' END AS live,
CASE WHEN dist_m <= 500 AND dt_s <= 300 AND (ratio IS NULL OR ratio BETWEEN 0.4 AND 3.0) THEN 'high' WHEN dist_m <= 1000 AND dt_s <= 900 AND (ratio IS NULL OR ratio BETWEEN 0.25 AND 4.0) THEN 'medium' ELSE 'low' END AS plain FROM q""")
def match_quality(spark, sf):
    """Grades of mutually nearest pairs by the live rule and by the plain one, with the true time differences."""
    from pelagos.functions import scalars

    t = _mutual(_pairs(spark, sf))
    ratio = F.when(F.col("length_ais") > 0, F.col("length_m") / F.col("length_ais"))
    live = m.live_quality(F.col("dist_m"), F.col("dt_s"), F.col("speed_kn"), F.col("length_m"), F.col("length_ais"))
    return t.select("scene_id", "det_id", "mmsi", live.alias("live"), scalars.match_grade(F.col("dist_m"), F.col("dt_s"), ratio).alias("plain"))


@query(f"WITH {_TAKEN} SELECT p.scene_id, p.mmsi FROM placed p WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.scene_id = p.scene_id AND t.mmsi = p.mmsi)")
def leftover_vessels(spark, sf):
    placed = m.positions_at(v.reports(spark, sf), v.object_scenes(spark, sf))
    return m.leftover(placed, _mutual(_pairs(spark, sf))).select("scene_id", "mmsi")


@query()
def match_scenes(spark, sf):
    """Every contact with its vessel by least total cost per scene; ambiguous pairs are held back."""
    out = m.match_scene(v.objects(spark, sf).select("scene_id", "det_id", "lon", "lat", "length_m", "confidence"), v.reports(spark, sf), v.object_scenes(spark, sf))
    return out.select("scene_id", "det_id", "ais_status", "ambiguous", "mmsi", F.round("dist_m", 3).alias("dist_m"), "match_quality")


_SLANT = "(800000 + k % 97 * 1000)::DOUBLE"
_E, _N = "(cog % 7 - 3)::DOUBLE", "(cog % 5 - 2)::DOUBLE"


@query(f"""WITH o AS ({v.SQL_OBJECTS}), g AS (SELECT *, k * 37 % 360 AS cog FROM o), s AS (SELECT *, -{_SLANT} / 7598.0::DOUBLE * (({_E} * 0.98::DOUBLE + {_N} * -0.2::DOUBLE) * sin(radians((30 + k % 15)::DOUBLE))) AS shift FROM g)
SELECT det_id, round(shift, 3) AS shift_m, round(lon + ({_E} * (k % 60) + shift * 0.2::DOUBLE) * {METRE} / cos(radians(lat)), 6) AS exp_lon, round(lat + ({_N} * (k % 60) + shift * 0.98::DOUBLE) * {METRE}, 6) AS exp_lat FROM s""")
def expected_positions(spark, sf):
    """Where moving vessels should show on the radar: the azimuth shift by their velocity towards it."""
    o = v.objects(spark, sf).withColumn("cog", F.col("k") * 37 % 360)
    e, n = (F.col("cog") % 7 - 3).cast("double"), (F.col("cog") % 5 - 2).cast("double")
    shift = m.azimuth_shift((F.lit(800000) + F.col("k") % 97 * 1000).cast("double"), (F.lit(30) + F.col("k") % 15).cast("double"), F.lit(0.98), F.lit(-0.2), e, n)
    o = o.withColumn("shift", shift)
    lon, lat = m.expected_place(F.col("lon"), F.col("lat"), e, n, F.col("k") % 60, F.col("shift"), F.lit(0.2), F.lit(0.98))
    return o.select("det_id", F.round("shift", 3).alias("shift_m"), F.round(lon, 6).alias("exp_lon"), F.round(lat, 6).alias("exp_lat"))


@query(f"""WITH r AS ({v.SQL_REPORTS}), s AS (SELECT c_custkey % 150 + 201000000 AS mmsi, max((c_custkey % 300)::DOUBLE) AS s FROM customer GROUP BY 1) SELECT event_id, coalesce(r.length_m, s.s) AS length_m FROM r LEFT JOIN s USING (mmsi)""")
def reports_with_static(spark, sf):
    static = v.table(spark, sf, "customer").select((F.col("c_custkey") % 150 + 201000000).alias("mmsi"), (F.col("c_custkey") % 300).cast("double").alias("length_m"))
    return m.with_static(v.reports(spark, sf), static).select("event_id", "length_m")


@query("""WITH e AS (SELECT user_id, max(CASE WHEN event_id % 3 = 0 THEN event_type END) AS a, max(CASE WHEN event_id % 2 = 0 THEN event_type || ';view' END) AS b FROM events GROUP BY user_id)
SELECT user_id, nullif(array_to_string(list_sort(list_distinct(list_filter(string_split(coalesce(a, ''), ';') || string_split(coalesce(b, ''), ';'), lambda x: x <> ''))), ';'), '') AS merged FROM e""")
def merged_id_sets(spark, sf):
    e = v.table(spark, sf, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("a"), F.max(F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit(";view")))).alias("b"))
    return e.select("user_id", m.merge_id_sets(F.col("a"), F.col("b")).alias("merged"))
