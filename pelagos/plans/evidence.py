"""Queries of the evidence joins: lights, events and contacts near a contact, weather, static layers, other sensors' cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos.functions import geo, scalars
from pelagos.operators import evidence as e
from pelagos.operators import around, proximity
from pelagos.plans.registry import query
from pelagos.sources import views as v


def _hav(a: str, b: str, lon: str = "lon", lat: str = "lat") -> str:
    return geo.sql_haversine_m(f"{a}.{lon}", f"{a}.{lat}", f"{b}.{lon}", f"{b}.{lat}")


@query(f"""WITH o AS ({v.SQL_OBJECTS}), p AS ({v.SQL_PLAN}), h AS (SELECT o.det_id, min(struct_pack(t := epoch_us(p.start), g := p.pass_group)) AS b FROM o JOIN p ON p.status <> 'past' AND p.start > make_timestamp({v._DAY} + 3600000000) AND p.start > o.acq AND o.lon > west AND o.lon < east AND o.lat > south AND o.lat < north GROUP BY 1)
SELECT o.det_id, h.b.t AS next_start, h.b.g AS next_pass FROM o LEFT JOIN h USING (det_id)""")
def next_look(spark, sf):
    """The first planned pass after the contact, and after the plan was made, whose box holds it."""
    out = e.next_look(v.objects(spark, sf).select("det_id", "lon", "lat", "acq"), v.plan(spark, sf), "det_id", "acq", F.timestamp_micros(F.lit(v._DAY + 3_600_000_000)))
    return out.select("det_id", F.unix_micros("next_start").alias("next_start"), "next_pass")


@query(f"""WITH o AS ({v.SQL_OBJECTS}), l AS ({v.SQL_LIGHTS}), h AS (SELECT o.det_id, string_agg(l.light_id, ';' ORDER BY l.light_id) AS ids, count(*) AS n FROM o JOIN l ON abs(o.lat - l.lat) < 0.02 AND abs(epoch_us(o.acq) - epoch_us(l.ts)) <= 10800000000 AND {_hav('o', 'l')} <= 2000 GROUP BY 1)
SELECT o.det_id, coalesce(h.n, 0) AS n_lights, coalesce(h.ids, '') AS light_ids FROM o LEFT JOIN h USING (det_id)""")
def lights_near(spark, sf):
    out = e.near_in_span(v.objects(spark, sf).select("det_id", "lon", "lat", "acq"), v.lights(spark, sf), "acq", "light_id", "ts", "ts", 2.0, 3.0, "ids")
    return out.select("det_id", F.size("ids").cast("long").alias("n_lights"), F.array_join("ids", ";").alias("light_ids"))


@query(f"""WITH o AS ({v.SQL_OBJECTS}), b AS ({v.SQL_BEHAVIOUR}), h AS (SELECT o.det_id, string_agg(b.event_key, ';' ORDER BY b.event_key) AS ids, count(*) AS n FROM o JOIN b ON abs(o.lat - b.lat) < 0.02 AND epoch_us(o.acq) BETWEEN epoch_us(b.start) - 10800000000 AND epoch_us(b.stop) + 10800000000 AND {_hav('o', 'b')} <= 2000 GROUP BY 1)
SELECT o.det_id, coalesce(h.n, 0) AS n_events, coalesce(h.ids, '') AS event_keys FROM o LEFT JOIN h USING (det_id)""")
def events_near(spark, sf):
    out = e.near_in_span(v.objects(spark, sf).select("det_id", "lon", "lat", "acq"), v.behaviour(spark, sf), "acq", "event_key", "start", "stop", 2.0, 3.0, "ids")
    return out.select("det_id", F.size("ids").cast("long").alias("n_events"), F.array_join("ids", ";").alias("event_keys"))


@query(f"""WITH o AS ({v.SQL_OBJECTS}), u AS (SELECT * FROM o WHERE ais_status = 'unmatched' AND k % 5 = 0), h AS (SELECT l.det_id, count(*) AS n, min(u.det_id) AS first FROM o l JOIN u ON l.k % 5 = 1 AND abs(l.lat - u.lat) < 0.02 AND l.det_id <> u.det_id AND l.pass_id <> u.pass_id AND abs(epoch_us(l.acq) - epoch_us(u.acq)) BETWEEN 600000001 AND 259200000000 AND {_hav('l', 'u')} <= 2000 GROUP BY 1)
SELECT o.det_id, coalesce(h.n, 0) AS n_persist, h.first AS first_other FROM o LEFT JOIN h USING (det_id) WHERE o.k % 5 = 1""")
def persistence_pairs(spark, sf):
    """Unmatched contacts of other passes around the contacts of one fifth."""
    o = v.objects(spark, sf)
    out = e.persistence_pairs(o.where("k % 5 = 1"), o.where("k % 5 = 0 and ais_status = 'unmatched'"))
    return out.select("det_id", F.size("persist").cast("long").alias("n_persist"), F.try_element_at("persist", F.lit(1)).alias("first_other"))


@query(f"""WITH o AS ({v.SQL_OBJECTS}), w AS (SELECT 'K' || (l_orderkey % 4000) AS det_id, arg_min(l_tax * 100, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_tax)) AS wind FROM lineitem GROUP BY 1)
SELECT o.det_id, round(coalesce(o.wind_ms, w.wind), 6) AS wind_ms FROM o LEFT JOIN w USING (det_id)""")
def weather_filled(spark, sf):
    """Wind from the contact's own row, else from the first row of the weather table."""
    x = v.table(spark, sf, "lineitem")
    w = x.select(F.concat(F.lit("K"), (F.col("l_orderkey") % 4000).cast("string")).alias("det_id"), (F.col("l_tax") * 100).alias("wind_ms"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax")
    out = e.fill_from(v.objects(spark, sf), w, ["det_id"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax"], ["wind_ms"])
    return out.select("det_id", F.round("wind_ms", 6).alias("wind_ms"))


BOXES = (("west", 105.0, 10.0, 105.36, 10.84), ("north", 105.0, 10.42, 105.72, 10.84))
_BOX = "(VALUES ('All', -180, -90, 181, 91), " + ", ".join(f"('{n}', {w}, {s}, {x}, {t})" for n, w, s, x, t in BOXES) + ") q(box, w, s, e, n)"


def _sql_agree(a: str, b: str, name: str) -> str:
    return f"""SELECT x.box, '{name}' AS direction, x.id, min(CASE WHEN abs(x.lat - y.lat) < 0.0092 THEN {_hav('x', 'y')} END) AS d FROM (SELECT id, lon, lat, box FROM {a}, {_BOX} WHERE lon >= q.w AND lon < q.e AND lat >= q.s AND lat < q.n) x LEFT JOIN (SELECT id, lon, lat, box FROM {b}, {_BOX} WHERE lon >= q.w AND lon < q.e AND lat >= q.s AND lat < q.n) y ON x.box = y.box AND floor(x.lat / 0.0092) BETWEEN floor(y.lat / 0.0092) - 1 AND floor(y.lat / 0.0092) + 1 GROUP BY ALL"""


@query(f"""WITH a AS (SELECT light_id AS id, lon, lat FROM ({v.SQL_LIGHTS})), b AS (SELECT event_key AS id, lon, lat FROM ({v.SQL_BEHAVIOUR})), d AS ({_sql_agree('a', 'b', 'lights_near_events')} UNION ALL {_sql_agree('b', 'a', 'events_near_lights')}),
k AS (SELECT box, direction, r.radius_m::DOUBLE AS radius_m, count(*) FILTER (WHERE d <= r.radius_m) AS k, count(*) AS n FROM d, (VALUES (500), (1000)) r(radius_m) GROUP BY ALL)
SELECT box, direction, radius_m, k, n, round(k::DOUBLE / n, 6) AS share, round({scalars.sql_wilson('k', 'n', '-')}, 6) AS low, round({scalars.sql_wilson('k', 'n', '+')}, 6) AS high FROM k""")
def agreement_by_box(spark, sf):
    """How many lights have an event near, and the reverse, per box, with score intervals."""
    a = v.lights(spark, sf).select(F.col("light_id").alias("id"), "lon", "lat")
    b = v.behaviour(spark, sf).select(F.col("event_key").alias("id"), "lon", "lat")
    out = e.agreement(a, b, (500.0, 1000.0), BOXES, ("lights", "events"))
    return out.select("box", "direction", "radius_m", "k", "n", *(F.round(c, 6).alias(c) for c in ("share", "low", "high")))


_CELLS = f"SELECT lon, lat, k % 9 AS night, CASE k % 4 WHEN 0 THEN 'fishing' WHEN 1 THEN 'cargo' WHEN 2 THEN 'fishing' END AS type, k % 3 AS detections FROM ({v.SQL_LIGHTS})"


def _type_cells(spark, sf):
    return v.lights(spark, sf).select("lon", "lat", "night", F.when(F.col("k") % 4 == 0, "fishing").when(F.col("k") % 4 == 1, "cargo").when(F.col("k") % 4 == 2, "fishing").alias("type"), (F.col("k") % 3).alias("detections"))


@query(f"""WITH c AS (SELECT det_id, lon, lat, k % 9 AS night FROM ({v.SQL_OBJECTS})), t AS ({_CELLS}), p AS (SELECT c.det_id, t.type, t.detections, {_hav('c', 't')} AS d FROM c JOIN t ON c.night = t.night AND abs(c.lat - t.lat) < 0.01 WHERE {_hav('c', 't')} <= 1000),
g AS (SELECT det_id, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'mixed' END AS type, count(*) AS n_cells, sum(detections)::BIGINT AS n_detections, min(d) AS m FROM p GROUP BY 1)
SELECT c.det_id, g.type, coalesce(n_cells, 0) AS n_cells, coalesce(n_detections, 0) AS n_detections, round(m, 2) AS nearest_m, coalesce(n_detections, 0) = 1 AS single FROM c LEFT JOIN g USING (det_id)""")
def cell_types(spark, sf):
    c = v.objects(spark, sf).select("det_id", "lon", "lat", (F.col("k") % 9).alias("night"))
    return e.cell_type(c, _type_cells(spark, sf), "det_id", "night").select("det_id", "type", "n_cells", "n_detections", F.round("nearest_m", 2).alias("nearest_m"), "single")


@query(f"""WITH c AS (SELECT det_id, lon, lat, k % 9 AS night FROM ({v.SQL_OBJECTS})), l AS ({v.SQL_LIGHTS}) SELECT det_id, EXISTS (SELECT 1 FROM l WHERE l.night = c.night AND abs(c.lat - l.lat) < 0.01 AND {_hav('c', 'l')} <= 1000) AS lit FROM c""")
def lit_colocation(spark, sf):
    c = v.objects(spark, sf).select("det_id", "lon", "lat", (F.col("k") % 9).alias("night"))
    return e.lit_same_night(c, v.lights(spark, sf), "det_id", "night").select("det_id", "lit")


@query(f"""WITH c AS (SELECT det_id AS id, lon, lat FROM ({v.SQL_OBJECTS}) WHERE k % 4 = 0), l AS (SELECT light_id AS id, lon, lat, (k % 400)::DOUBLE AS length_m FROM ({v.SQL_LIGHTS})), p AS (SELECT c.id, l.id AS other, {_hav('c', 'l')} AS d, l.length_m FROM c JOIN l ON abs(c.lat - l.lat) < 0.004 WHERE {_hav('c', 'l')} <= 400),
n AS (SELECT id, min(struct_pack(d := d, o := other, l := length_m)) AS b FROM p GROUP BY id), r AS (SELECT other AS id, min(d) AS d FROM p GROUP BY 1)
SELECT 'candidate' AS side, c.id, round(n.b.d, 2) AS nearest_m, CASE WHEN n.b.d <= 50 THEN 'vessel' WHEN n.b.d <= greatest(150, 0.75 * n.b.l) THEN 'ambiguous' ELSE 'clutter' END AS class FROM c LEFT JOIN n USING (id) UNION ALL SELECT 'label', l.id, round(r.d, 2), NULL FROM l LEFT JOIN r USING (id)""")
def point_classes(spark, sf):
    """Candidates by their nearest label, and each label's nearest candidate."""
    c = v.objects(spark, sf).where("k % 4 = 0").select(F.col("det_id").alias("id"), "lon", "lat")
    l = v.lights(spark, sf).select(F.col("light_id").alias("id"), "lon", "lat", (F.col("k") % 400).cast("double").alias("length_m"))  # noqa: E741
    a, b = e.mutual_distances(c, l.select("id", "lon", "lat"), 400.0)
    a = a.join(l.select(F.col("id").alias("nearest_id"), "length_m"), "nearest_id", "left")
    a = a.select(F.lit("candidate").alias("side"), "id", F.round("nearest_m", 2).alias("nearest_m"), e.point_class(F.col("nearest_m"), F.col("length_m")).alias("class"))
    return a.unionByName(b.select(F.lit("label").alias("side"), "id", F.round("nearest_m", 2).alias("nearest_m"), F.lit(None).cast("string").alias("class")))


def _sql_px(rest: int) -> str:
    return f"SELECT scene_id AS scene, k AS id, (k * 7919 % 800)::DOUBLE / 4 AS row, (k * 104729 % 800)::DOUBLE / 4 AS col, length_m FROM ({v.SQL_OBJECTS}) WHERE k % 2 = {rest}"


def _px(spark, sf, rest):
    return v.objects(spark, sf).where(F.col("k") % 2 == rest).select(F.col("scene_id").alias("scene"), F.col("k").alias("id"), ((F.col("k") * 7919 % 800) / F.lit(4.0)).alias("row"), ((F.col("k") * 104729 % 800) / F.lit(4.0)).alias("col"), "length_m")


@query(f"""WITH a AS ({_sql_px(1)}), b AS (SELECT scene + 1 AS scene, id, row, col, length_m FROM ({_sql_px(0)})), p AS (SELECT a.scene, a.id, b.id AS h, b.length_m AS hl, sqrt(pow(a.row - b.row, 2) + pow(a.col - b.col, 2)) AS d FROM a JOIN b ON a.scene = b.scene),
n AS (SELECT scene, id, min(struct_pack(d := d, h := h, hl := hl)) AS b FROM p WHERE d < 3 GROUP BY ALL), w AS (SELECT scene, id, b.h AS h, b.hl AS hl FROM (SELECT *, row_number() OVER (PARTITION BY scene, b.h ORDER BY id) AS r FROM n) WHERE r = 1)
SELECT a.scene, a.id AS v_id, w.h AS h_id, a.row, a.col, greatest(a.length_m, w.hl) AS length_m, CASE WHEN w.h IS NOT NULL THEN 'VV+VH' ELSE 'VV only' END AS pol_class FROM a LEFT JOIN w USING (scene, id)
UNION ALL SELECT scene, NULL, id, row, col, length_m, 'VH only' FROM b WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.scene = b.scene AND w.h = b.id)""")
def fused_channels(spark, sf):
    out = e.fuse_channels(_px(spark, sf, 1), _px(spark, sf, 0).withColumn("scene", F.col("scene") + 1), "scene")
    return out.withColumnRenamed("id", "v_id")


@query(f"""WITH o AS ({v.SQL_OBJECTS}), low AS (SELECT x.det_id, count(*) AS n FROM o x JOIN o y ON x.scene_id = y.scene_id AND y.confidence = 'low' AND abs(x.lat - y.lat) < 0.01 WHERE {_hav('x', 'y')} <= 1000 GROUP BY 1),
fix AS (SELECT x.det_id, min({_hav('x', 'y')}) AS m FROM o x JOIN o y ON x.scene_id = y.scene_id AND y.confidence = 'fixed' AND x.det_id <> y.det_id AND abs(x.lat - y.lat) < 0.01 WHERE {_hav('x', 'y')} <= 1000 GROUP BY 1)
SELECT o.det_id, coalesce(low.n, 0) AS n_low, o.confidence IN ('high', 'medium') AND coalesce(low.n, 0) >= 5 AS clutter, round(fix.m, 2) AS fixed_m, o.confidence IN ('high', 'medium') AND coalesce(fix.m <= 250, false) AS near_fixed FROM o LEFT JOIN low USING (det_id) LEFT JOIN fix USING (det_id)""")
def clutter_zone(spark, sf):
    """Low objects within 1 km (five make a clutter zone) and the nearest other fixed object (250 m) of the same scene."""
    from pelagos.operators import detections

    out = detections.near_fixed(detections.clutter_zone(v.objects(spark, sf)))
    return out.select("det_id", "n_low", "clutter", F.round("fixed_m", 2).alias("fixed_m"), "near_fixed")


@query(f"""WITH l AS ({v.SQL_LIGHTS}), n AS (SELECT x.light_id, count(DISTINCT y.night) AS n FROM l x JOIN l y ON abs(x.lat - y.lat) < 0.005 WHERE {_hav('x', 'y')} <= 500 GROUP BY 1)
SELECT l.light_id, n.n AS nights_seen, CASE WHEN n.n >= greatest(3, ceil(0.3::DOUBLE * (k % 14))) THEN 'persistent_light' ELSE 'lit_vessel_candidate' END AS light_class FROM l JOIN n USING (light_id)""")
def recurring_lights(spark, sf):
    return e.recurring(v.lights(spark, sf).drop("class"), F.col("k") % 14).select("light_id", "nights_seen", "light_class")


@query(f"""WITH o AS (SELECT det_id AS id, lon, lat, floor((epoch_us(acq) / 1000000 + 1800) / 3600) * 3600 AS h FROM ({v.SQL_OBJECTS})), l AS (SELECT light_id AS other, lon, lat, epoch_us(ts) / 1000000 AS t FROM ({v.SQL_LIGHTS})), b AS (SELECT o.id, min(struct_pack(d := {_hav('o', 'l')}, o := l.other)) AS b FROM o JOIN l ON abs(o.lat - l.lat) < 0.005 AND abs(l.t - o.h) <= 3600 WHERE {_hav('o', 'l')} <= 500 GROUP BY 1)
SELECT o.id, b.b.o AS near_id, round(b.b.d, 2) AS near_m, b.b IS NOT NULL AS within FROM o LEFT JOIN b USING (id)""")
def compare_points(spark, sf):
    """Our objects against another provider's detections of the hour."""
    ours = v.objects(spark, sf).select(F.col("det_id").alias("id"), "lon", "lat", "acq")
    out = e.compare_points(ours, v.lights(spark, sf).select(F.col("light_id").alias("other"), "lon", "lat", "ts"))
    return out.select("id", "near_id", F.round("near_m", 2).alias("near_m"), "within")


_HOURLY = f"SELECT floor(lon / 0.01)::BIGINT AS cx, floor(lat / 0.01)::BIGINT AS cy, ts::DATE AS day, hour(ts) AS h, k % 5 AS detections, CASE WHEN k % 3 <> 0 THEN k % 2 = 0 END AS matched, CASE k % 4 WHEN 0 THEN 'fishing' WHEN 1 THEN 'cargo' END AS type FROM ({v.SQL_LIGHTS})"


@query(f"""WITH o AS (SELECT det_id AS id, floor(lon / 0.01)::BIGINT AS cx, floor(lat / 0.01)::BIGINT AS cy, acq::DATE AS day, hour(acq) + minute(acq) / 60 AS h FROM ({v.SQL_OBJECTS})), y AS ({_HOURLY}),
s AS (SELECT o.id, sum(detections)::BIGINT AS detections, sum(CASE WHEN coalesce(matched, true) THEN 0 ELSE detections END)::BIGINT AS unmatched, bool_or(coalesce(matched, false)) AS any_matched FROM o JOIN y ON o.cx = y.cx AND o.cy = y.cy AND o.day = y.day AND abs(o.h - y.h) <= 1 GROUP BY 1),
t AS (SELECT cx, cy, day, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'mixed' END AS day_type FROM y WHERE type IS NOT NULL GROUP BY ALL)
SELECT o.id, coalesce(s.detections, 0) AS detections, coalesce(s.unmatched, 0) AS unmatched, s.any_matched, t.day_type FROM o LEFT JOIN s USING (id) LEFT JOIN t USING (cx, cy, day)""")
def cells_at_objects(spark, sf):
    """Another provider's hourly cells at our objects."""
    ours = v.objects(spark, sf).select(F.col("det_id").alias("id"), "lon", "lat", "acq")
    k = F.col("k")
    hourly = v.lights(spark, sf).select("lon", "lat", "ts", (k % 5).alias("detections"), F.when(k % 3 != 0, k % 2 == 0).alias("matched"), F.when(k % 4 == 0, "fishing").when(k % 4 == 1, "cargo").alias("type"))
    return e.cells_at_objects(ours, hourly).select("id", "detections", "unmatched", "any_matched", "day_type")


_PRIOR = f"SELECT 'K' || (k * 2 % 3001) AS det_id, (k * 2 % 3001) % 40 AS scene_id, (k * 2 % 3001) % 17 AS row, CASE WHEN k % 5 = 0 THEN NULL ELSE (k % 100)::DOUBLE / 100 END AS score FROM (SELECT p_partkey AS k FROM part)"


@query(f"""WITH o AS (SELECT det_id, scene_id, k % 34 AS row FROM ({v.SQL_OBJECTS})), p AS (SELECT * FROM ({_PRIOR}) QUALIFY count(*) OVER (PARTITION BY det_id) = 1)
SELECT o.det_id, CASE WHEN p.score IS NOT NULL AND o.scene_id = p.scene_id AND o.row = p.row THEN 'match' WHEN p.score IS NOT NULL THEN 'position_differs' ELSE 'none' END AS prior_status, CASE WHEN o.scene_id = p.scene_id AND o.row = p.row THEN p.score END AS prior_value FROM o LEFT JOIN p USING (det_id)""")
def prior_aligned(spark, sf):
    """Scores of an earlier run, taken over only where id, scene and place agree."""
    o = v.objects(spark, sf).select("det_id", "scene_id", (F.col("k") % 34).alias("row"))
    p = v.table(spark, sf, "part").select((F.col("p_partkey") * 2 % 3001).alias("n"), F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 100) / 100).alias("score"))
    p = p.select(F.concat(F.lit("K"), F.col("n").cast("string")).alias("det_id"), (F.col("n") % 40).alias("scene_id"), (F.col("n") % 17).alias("row"), "score")
    return e.align_prior(o, p, "det_id", ["scene_id", "row"], "score").select("det_id", "prior_status", "prior_value")


@query("SELECT c.c_custkey AS id, c.c_name AS name, o.n AS orders FROM customer c JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def checked_merge(spark, sf):
    """A merge that fails if either side repeats a key."""
    c = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    o = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"))
    return e.one_to_one(c, o, "id")


_FLAT = "6371000::DOUBLE * sqrt(pow(radians(s.lon - l.lon) * cos(radians(10::DOUBLE)), 2) + pow(radians(s.lat - l.lat), 2))"


@query(f"""WITH l AS ({v.SQL_LIGHTS}), s AS (SELECT event_key AS site_id, lon, lat FROM ({v.SQL_BEHAVIOUR}) WHERE kind = 'gap'), b AS (SELECT l.light_id, min(struct_pack(d := {_FLAT}, i := s.site_id)) AS b FROM l JOIN s ON abs(s.lat - l.lat) < 0.005 WHERE {_FLAT} <= 500 GROUP BY 1)
SELECT l.light_id, b.b.i AS site_id, round(b.b.d, 2) AS site_m FROM l LEFT JOIN b USING (light_id)""")
def nearest_sites(spark, sf):
    sites = v.behaviour(spark, sf).where("kind = 'gap'").select(F.col("event_key").alias("site_id"), "lon", "lat")
    return e.nearest_site(v.lights(spark, sf), sites, "light_id").select("light_id", "site_id", F.round("site_m", 2).alias("site_m"))


_CITED = "SELECT DISTINCT 'L' || (o_orderkey % 900) AS light_id FROM orders WHERE o_orderkey % 3 = 0"


@query(f"WITH l AS ({v.SQL_LIGHTS}) SELECT light_id, round(radiance, 3) AS radiance FROM l WHERE light_id IN ({_CITED}) AND light_id NOT IN (SELECT light_id FROM l WHERE quality = 'clear')")
def cited_lights(spark, sf):
    """Lights that leads cite and the lean table lacks."""
    lights = v.lights(spark, sf)
    cited = v.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("L"), (F.col("o_orderkey") % 900).cast("string")).alias("light_id"))
    return e.cited_rows(lights, lights.where("quality = 'clear'"), cited, "light_id").select("light_id", F.round("radiance", 3).alias("radiance"))


@query("""WITH c AS (SELECT o_custkey AS lead, 'K' || o_orderkey AS id, 'contact' AS type FROM orders UNION ALL SELECT o_custkey, 'E' || (o_orderkey % 700), 'event' FROM orders) SELECT id, string_agg(DISTINCT lead::VARCHAR, ';' ORDER BY lead::VARCHAR) AS leads FROM c WHERE type = 'event' GROUP BY id""")
def evidence_index(spark, sf):
    """Which leads cite each event."""
    o = v.table(spark, sf, "orders")
    cite = lambda kind, prefix, key: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(prefix), key.cast("string")).alias("id"))
    leads = o.groupBy(F.col("o_custkey").cast("string").alias("lead")).agg(F.flatten(F.collect_list(F.array(cite("contact", "K", F.col("o_orderkey")), cite("event", "E", F.col("o_orderkey") % 700)))).alias("evidence"))
    return e.inverted_index(leads, "lead", "evidence", "event").select("id", F.array_join("leads", ";").alias("leads"))


@query("""WITH a AS (SELECT s_suppkey AS id, s_name AS name, 'table0' AS origin FROM supplier), b AS (SELECT c_custkey AS id, c_name AS name, 'table1' AS origin FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT id FROM a)), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT * FROM u UNION ALL SELECT DISTINCT o_custkey, NULL, 'stub' FROM orders WHERE o_custkey NOT IN (SELECT id FROM u)""")
def identities_with_stubs(spark, sf):
    a = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = v.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return e.with_stubs([a, b], v.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id")


@query(f"""WITH o AS (SELECT det_id, lon, lat FROM ({v.SQL_OBJECTS})), g AS (SELECT k AS cell_no, lon, lat FROM ({v.SQL_LIGHTS}) WHERE k % 7 = 0), b AS (SELECT o.det_id, min(struct_pack(d := {_hav('o', 'g')}, c := g.cell_no)) AS b FROM o JOIN g ON abs(o.lat - g.lat) < 0.01 WHERE {_hav('o', 'g')} <= 1000 GROUP BY 1)
SELECT o.det_id, coalesce(b.b.c, -1) AS cell_no FROM o LEFT JOIN b USING (det_id)""")
def nearest_valid_cells(spark, sf):
    cells = v.lights(spark, sf).select(F.col("k").alias("cell_no"), "lon", "lat", (F.col("k") % 7 == 0).alias("valid"))
    return e.nearest_valid_cell(v.objects(spark, sf).select("det_id", "lon", "lat"), cells, "det_id", 1.0).select("det_id", "cell_no")


@query(f"""WITH b AS ({v.SQL_BEHAVIOUR}), o AS ({v.SQL_OBJECTS}) SELECT event_key, kind FROM b WHERE EXISTS (SELECT 1 FROM o WHERE o.k % 50 = 0 AND abs(o.lat - b.lat) < 0.01 AND epoch_us(o.acq) BETWEEN epoch_us(b.start) - 1800000000 AND epoch_us(b.stop) + 1800000000 AND {_hav('b', 'o')} <= 1000)""")
def events_with_contacts(spark, sf):
    return e.events_with_contacts(v.behaviour(spark, sf), v.objects(spark, sf).where("k % 50 = 0"), 1.0, 0.5).select("event_key", "kind")


@query(f"""WITH r AS ({v.SQL_REPORTS}), p AS ({v.SQL_PLAN}), h AS (SELECT r.event_id, min(struct_pack(a := epoch_us(p.start), g := p.pass_group)) AS b FROM r JOIN p ON epoch_us(r.ts) BETWEEN epoch_us(p.start) - 180000000 AND epoch_us(p.start) + 780000000 GROUP BY 1)
SELECT r.event_id, h.b.g AS interval_id FROM r LEFT JOIN h USING (event_id)""")
def interval_lookup(spark, sf):
    """The planned segment (ten minutes) of each report, with three minutes of slack."""
    p = v.plan(spark, sf).select(F.col("pass_group").alias("interval_id"), F.col("start").alias("t0"), (F.col("start") + F.expr("interval 10 minutes")).alias("t1"))
    return e.in_interval(v.reports(spark, sf), p, "ts", 180.0, "event_id").select("event_id", "interval_id")


@query(f"""WITH s AS (SELECT epoch_us(acq) AS t, scene_id FROM ({v.SQL_OBJECT_SCENES})), p AS (SELECT epoch_us(start) AS t, pass_group FROM ({v.SQL_PLAN})), b AS (SELECT s.scene_id, min(struct_pack(d := abs(p.t - s.t), g := p.pass_group)) AS b FROM s JOIN p ON abs(p.t - s.t) <= 1800000000 GROUP BY 1)
SELECT s.scene_id, b.b.g AS near_id, round(b.b.d / 1000000, 3) AS near_dt_s FROM s LEFT JOIN b USING (scene_id)""")
def prediction_to_segment(spark, sf):
    """The planned segment nearest to each pass, within half an hour."""
    from pelagos.operators import temporal

    out = temporal.nearest_in_time(v.object_scenes(spark, sf).select("scene_id", "acq"), v.plan(spark, sf), "acq", "start", "pass_group", 1800)
    return out.select("scene_id", "near_id", F.round("near_dt_s", 3).alias("near_dt_s"))


_GAPS = f"SELECT event_key, lon AS off_lon, lat AS off_lat, start, lon + 0.03::DOUBLE AS on_lon, lat - 0.02::DOUBLE AS on_lat, stop FROM ({v.SQL_BEHAVIOUR}) WHERE kind = 'gap'"


@query(f"""WITH g AS ({_GAPS}), c AS (SELECT det_id, lon, lat, epoch_us(acq) AS t FROM ({v.SQL_OBJECTS}) WHERE k % 10 = 0), x AS (SELECT g.event_key, {geo.sql_haversine_m('c.lon', 'c.lat', 'off_lon', 'off_lat')} <= 3000 AND abs(c.t - epoch_us(start)) <= 3600000000 AS a, {geo.sql_haversine_m('c.lon', 'c.lat', 'on_lon', 'on_lat')} <= 3000 AND abs(c.t - epoch_us(stop)) <= 3600000000 AS b,
{geo.sql_haversine_m('c.lon', 'c.lat', '(off_lon + on_lon) / 2', '(off_lat + on_lat) / 2')} <= {geo.sql_haversine_m('off_lon', 'off_lat', 'on_lon', 'on_lat')} / 2 + 3000 AND c.t BETWEEN epoch_us(start) AND epoch_us(stop) AS m FROM g, c)
SELECT event_key, count(*) FILTER (WHERE a) AS n_off, count(*) FILTER (WHERE b) AS n_on, count(*) FILTER (WHERE m) AS n_between FROM x GROUP BY 1""")
def gap_proximity(spark, sf):
    """Contacts around the places where a vessel fell silent and was heard again, and between them."""
    g = v.behaviour(spark, sf).where("kind = 'gap'").select("event_key", F.col("lon").alias("off_lon"), F.col("lat").alias("off_lat"), "start", (F.col("lon") + 0.03).alias("on_lon"), (F.col("lat") - 0.02).alias("on_lat"), "stop")
    return e.gap_sides(v.objects(spark, sf).where("k % 10 = 0"), g, 3.0, 1.0)


@query(f"""WITH s AS (SELECT pass_id, list(DISTINCT scene_id) AS scenes FROM ({v.SQL_OBJECTS}) GROUP BY 1), x AS (SELECT pass_id, unnest(scenes) AS scene_id FROM s) SELECT o.det_id, x.pass_id FROM ({v.SQL_OBJECTS}) o JOIN x USING (scene_id)""")
def pass_lookup(spark, sf):
    """Passes list their scenes; each contact finds its pass through the exploded lists."""
    o = v.objects(spark, sf)
    passes = o.groupBy("pass_id").agg(F.collect_set("scene_id").alias("scenes"))
    return o.select("det_id", "scene_id").join(passes.select("pass_id", F.explode("scenes").alias("scene_id")), "scene_id").select("det_id", "pass_id")


_SHIFT = "0.005::DOUBLE"


@query(f"""WITH c AS (SELECT det_id, lon, lat FROM ({v.SQL_OBJECTS})), s AS (SELECT light_id, floor(lon / 0.01 + 0.5) * 0.01 AS lon, floor(lat / 0.01 + 0.5) * 0.01 AS lat FROM ({v.SQL_LIGHTS})), r AS (SELECT 'centre' AS reading, light_id, lon, lat FROM s UNION ALL SELECT 'corner', light_id, lon + {_SHIFT}, lat + {_SHIFT} FROM s),
p AS (SELECT r.reading, {_hav('c', 'r')} AS d FROM c JOIN r ON abs(c.lat - r.lat) < 0.01 WHERE {_hav('c', 'r')} <= 556), g AS (SELECT reading, count(*) AS n_pairs, round(median(d), 3) AS median_m FROM p GROUP BY 1) SELECT *, row_number() OVER (ORDER BY n_pairs DESC, median_m, reading) = 1 AS kept FROM g""")
def alignment_check(spark, sf):
    """Cells read by their centre or by their corner: the reading with more pairs within half a cell is kept."""
    c = v.objects(spark, sf).select("det_id", "lon", "lat")
    snap = lambda x: F.floor(F.col(x) / 0.01 + 0.5) * 0.01
    s = v.lights(spark, sf).select("light_id", snap("lon").alias("lon"), snap("lat").alias("lat"))
    r = s.withColumn("reading", F.lit("centre")).unionByName(s.select("light_id", (F.col("lon") + 0.005).alias("lon"), (F.col("lat") + 0.005).alias("lat"), F.lit("corner").alias("reading")))
    g = proximity.within(c, r, 556.0).groupBy(F.col("r_reading").alias("reading")).agg(F.count("*").alias("n_pairs"), F.round(F.median("dist_m"), 3).alias("median_m"))
    best = g.agg(F.min(F.struct((-F.col("n_pairs")).alias("a"), "median_m", "reading")).alias("b")).select(F.col("b.reading").alias("best"))
    return g.crossJoin(F.broadcast(best)).withColumn("kept", F.col("reading") == F.col("best")).drop("best")  # one row on the right


@query(f"""WITH l AS ({v.SQL_LIGHTS}), m AS (SELECT event_key, lon, lat, (hash_k % 4) AS cloud FROM (SELECT event_key, lon, lat, substr(event_key, 2)::BIGINT AS hash_k FROM ({v.SQL_BEHAVIOUR}))), b AS (SELECT l.light_id, min(struct_pack(d := {_hav('l', 'm')}, e := m.event_key, c := m.cloud)) AS b FROM l JOIN m ON abs(l.lat - m.lat) < 0.02 WHERE {_hav('l', 'm')} <= 2000 GROUP BY 1)
SELECT l.light_id, CASE WHEN b.b IS NULL THEN 'unknown' WHEN b.b.c <= 1 THEN 'clear' ELSE 'cloudy' END AS sky FROM l LEFT JOIN b USING (light_id) WHERE l.radiance > 1""")
def sky_at_lights(spark, sf):
    """Quality of each bright light from the nearest pixel of the cloud mask within 2 km."""
    m = v.behaviour(spark, sf).select("event_key", "lon", "lat", (F.substring("event_key", 2, 20).cast("long") % 4).alias("cloud"))
    x = around.nearest(v.lights(spark, sf).where("radiance > 1").select("light_id", "lon", "lat"), m, "event_key", 2000, also=("cloud",))
    return x.select("light_id", F.when(F.col("near_cloud").isNull(), "unknown").when(F.col("near_cloud") <= 1, "clear").otherwise("cloudy").alias("sky"))
