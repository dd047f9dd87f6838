"""Queries on parsers, reasons and payloads, over texts made from ids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pelagos.functions import geo, parsers, scalars
from pelagos.operators import assign, dedupe, proximity, temporal
from pelagos.plans.registry import query
from pelagos.sources import views as v


@query("""WITH e AS (SELECT event_id, event_id * 7919 * 104729 % 1100000000 AS m, CASE event_id % 6 WHEN 0 THEN 'NET-8-84%' WHEN 1 THEN 'BUOY A' WHEN 2 THEN 'NETHERLANDS' WHEN 3 THEN NULL ELSE 'OCEAN STAR' END AS name FROM events)
SELECT event_id, CASE WHEN m BETWEEN 201000000 AND 775999999 THEN m // 1000000 END AS mid, coalesce(regexp_matches(upper(name), '%$|\\b(NET|BUOY|BOUY)\\b'), false) OR NOT m BETWEEN 100000000 AND 999999999 AS gear, m BETWEEN 201000000 AND 775999999 AS ship FROM e""")
def stations_and_gear(spark, sf):
    """Ship stations by their number, and what looks like fishing gear."""
    k = F.col("event_id")
    e = v.table(spark, sf, "events").select("event_id", (k * 7919 * 104729 % 1100000000).alias("m"), F.when(k % 6 == 0, "NET-8-84%").when(k % 6 == 1, "BUOY A").when(k % 6 == 2, "NETHERLANDS").when(k % 6 == 3, None).otherwise("OCEAN STAR").alias("name"))
    return e.select("event_id", scalars.mid_of(F.col("m")).alias("mid"), parsers.gear_beacon_like(F.col("name"), F.col("m")).alias("gear"), F.col("m").between(201000000, 775999999).alias("ship"))


@query(f"""WITH m AS (SELECT event_id, (event_id * 37 % 600 + 200) * 1000000 + event_id % 1000000 AS m FROM events) SELECT event_id, CASE {' '.join(f"WHEN m // 1000000 = {k} THEN '{x}'" for k, x in parsers.MID.items())} END AS flag FROM m""")
def flags_by_number(spark, sf):
    k = F.col("event_id")
    return v.table(spark, sf, "events").select("event_id", parsers.flag_of((k * 37 % 600 + 200) * 1000000 + k % 1000000).alias("flag"))


@query("""WITH d AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'dataset' ELSE 'article' END AS kind, p_partkey % 11 = 0 AS paratext, 2010 + p_partkey % 20 AS year, p_partkey % 3 <> 0 AS themed FROM part)
SELECT k, CASE WHEN kind NOT IN ('article', 'conference-paper', 'review', 'preprint') THEN 'type' WHEN paratext THEN 'paratext' WHEN year NOT BETWEEN 2015 AND 2026 THEN 'year' WHEN NOT themed THEN 'no_strict_theme' END AS reason FROM d""")
def eligibility(spark, sf):
    """Why a work may not enter the corpus; the first reason counts."""
    k = F.col("p_partkey")
    kind, year = F.when(k % 5 == 0, "dataset").otherwise("article"), F.lit(2010) + k % 20
    reason = scalars.first_reason(("type", ~kind.isin("article", "conference-paper", "review", "preprint")), ("paratext", k % 11 == 0), ("year", ~year.between(2015, 2026)), ("no_strict_theme", ~(k % 3 != 0)))
    return v.table(spark, sf, "part").select(k.alias("k"), reason.alias("reason"))


@query(f"""SELECT det_id, CASE WHEN confidence NOT IN ('high', 'medium') THEN 'quality' WHEN coalesce(k % 7 = 0, false) THEN 'review_doubtful' WHEN (k % 90)::DOUBLE / 100 < 0.25 THEN 'ratio_below_feasible' WHEN length_m <= 20.05 THEN 'radar_at_pixel_floor' END AS reason FROM ({v.SQL_OBJECTS})""")
def calibration_selection(spark, sf):
    k = F.col("k")
    note = F.when(k % 7 == 0, "Doubtful, blurred")
    reason = scalars.first_reason(("quality", ~F.col("confidence").isin("high", "medium")), ("review_doubtful", F.lower(F.coalesce(note, F.lit(""))).startswith("doubtful")), ("ratio_below_feasible", (k % 90) / 100 < 0.25), ("radar_at_pixel_floor", F.col("length_m") <= 20.05))
    return v.objects(spark, sf).select("det_id", reason.alias("reason"))


@query(r"""WITH t AS (SELECT event_id, (event_id % 60) AS d, (event_id * 7 % 60) AS m, (event_id * 13 % 60) AS s, CASE event_id % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE 'W' END AS h FROM events) SELECT event_id, round(CASE WHEN h IN ('S', 'W') THEN -1 ELSE 1 END * (d + m / 60 + s / 3600), 8) AS degrees FROM t""")
def degrees_from_text(spark, sf):
    k = F.col("event_id")
    h = F.when(k % 4 == 0, "N").when(k % 4 == 1, "S").when(k % 4 == 2, "E").otherwise("W")
    text = F.format_string("%d°%d'%d\"%s", k % 60, k * 7 % 60, k * 13 % 60, h)
    return v.table(spark, sf, "events").select("event_id", F.round(parsers.dms_to_degrees(text), 8).alias("degrees"))


@query("""SELECT event_id, epoch_us(ts) // 1000000 * 1000000 + 123456 - CASE WHEN event_id % 3 = 0 THEN 25200000000 ELSE 0 END AS t FROM events""")
def times_from_text(spark, sf):
    """Times with nanoseconds, with an offset of seven hours or in UTC."""
    e = v.table(spark, sf, "events")
    base = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    text = F.concat(base, F.lit(".123456789"), F.when(F.col("event_id") % 3 == 0, "+07:00").otherwise(" UTC"))
    return e.select("event_id", F.unix_micros(parsers.utc_time(text)).alias("t"))


@query("""SELECT o_orderkey AS k, 'S1' || substr('ABCD', (o_orderkey % 4 + 1)::INTEGER, 1) AS mission, (o_orderkey % 900)::INTEGER AS orbit, epoch_us(date_trunc('second', o_orderdate)) + 25000000 AS stop FROM orders""")
def product_names(spark, sf):
    """Fields of satellite product names."""
    o, k = v.table(spark, sf, "orders"), F.col("o_orderkey")
    t = F.col("o_orderdate").cast("timestamp")
    stamp = lambda x: F.date_format(x, "yyyyMMdd'T'HHmmss")
    name = F.concat(F.lit("S1"), F.substring(F.lit("ABCD"), (k % 4 + 1).cast("int"), F.lit(1)), F.lit("_IW_GRDH_1SDV_"), stamp(t), F.lit("_"), stamp(t + F.expr("interval 25 seconds")), F.lit("_"), F.lpad((k % 900).cast("string"), 6, "0"), F.lit("_03F1A2_9C1D"))
    p = parsers.product_fields(name)
    return o.select(k.alias("k"), p["mission"].alias("mission"), p["orbit"].alias("orbit"), F.unix_micros(p["stop"]).alias("stop"))


@query("""SELECT p_partkey AS k, 'alpha beta ' || p_partkey || ' beta' AS text, 'Name ' || (p_partkey % 7) AS first_name, 'Q' || (p_partkey % 4 + 1) AS quartile FROM part""")
def nested_texts(spark, sf):
    """Abstracts of inverted indexes and categories with quartiles."""
    k = F.col("p_partkey")
    index = F.concat(F.lit('{"beta": [1, 3], "'), k.cast("string"), F.lit('": [2, -5], "alpha": [0]}'))
    cats = F.concat(F.lit("Name "), (k % 7).cast("string"), F.lit(" (Q"), (k % 4 + 1).cast("string"), F.lit("); Other (Q1); "))
    c = F.get(parsers.categories(cats), 0)
    return v.table(spark, sf, "part").select(k.alias("k"), parsers.abstract_of(index).alias("text"), c["name"].alias("first_name"), c["quartile"].alias("quartile"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'v' || (event_id % 50) END AS vessel_id, round(round((event_id % 300)::DOUBLE / 100 / 0.01) * 0.01, 6) AS lat, round(round((10000 + event_id % 700)::DOUBLE / 100 / 0.01) * 0.01, 6) AS lon, event_id % 9 AS detections FROM events""")
def report_payloads(spark, sf):
    """Cells of gridded reports from their JSON, snapped and with empty texts as null."""
    k = F.col("event_id")
    cell = F.format_string('{"entries": [{"set:%d": [{"date": "2024-01-01", "hour": "", "lat": %s, "lon": %s, "detections": %d, "vesselId": "%s"}]}]}', k, ((k % 300) / 100 + 1e-9).cast("string"), ((F.lit(10000) + k % 700) / 100 - 1e-9).cast("string"), k % 9, F.when(k % 3 == 0, F.concat(F.lit("v"), (k % 50).cast("string"))).otherwise(""))
    out = parsers.report_cells(v.table(spark, sf, "events").select(cell.alias("j")), "j", 0.01)
    return out.select(F.substring_index("dataset", ":", -1).cast("long").alias("event_id"), "vessel_id", "lat", "lon", "detections")


@query("""SELECT 'e' || event_id AS event_id, event_type AS type, round((event_id % 50)::DOUBLE / 2, 6) AS duration_h, 'v' || user_id AS vessel_id, CASE WHEN event_type = 'error' THEN 'w' || user_id END AS other_id FROM events""")
def event_payloads(spark, sf):
    """Events of an API payload as wide rows."""
    e = v.table(spark, sf, "events")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    stop = F.timestamp_seconds(F.unix_seconds(start) + F.col("event_id") % 50 * 1800)
    iso = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    j = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("type"), iso(start).alias("start"), iso(stop).alias("end"), F.struct(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("id")).alias("vessel"), F.when(F.col("event_type") == "error", F.struct(F.struct(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("id")).alias("vessel"))).alias("encounter"))).alias("entries")))
    out = parsers.event_rows(e.select(j.alias("j")), "j")
    return out.select("event_id", "type", F.round("duration_h", 6).alias("duration_h"), "vessel_id", "other_id")


@query(f"""SELECT night, floor(date_diff('day', DATE '2024-01-01', DATE '2024-01-01' + night::INTEGER * 5) / 7)::BIGINT AS fold, count(*) AS n FROM ({v.SQL_LIGHTS}) GROUP BY ALL""")
def week_folds(spark, sf):
    first = F.lit("2024-01-01").cast("date")
    day = F.date_add(first, (F.col("night") * 5).cast("int"))
    return v.lights(spark, sf).groupBy("night", scalars.week_fold(day, first).alias("fold")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT x.i AS row, y.j AS col FROM generate_series(0, 7) x(i), generate_series(0, 11) y(j)) SELECT row, col, round(power(6371.0088, 2) * radians(0.25) * (sin(radians(10 - row * 0.25)) - sin(radians(10 - row * 0.25 - 0.25))), 4) AS km2 FROM r""")
def covering_grid(spark, sf):
    """The cells that cover a box, with their areas."""
    return geo.covering_cells(spark, (105.0, 8.0, 108.0, 10.0), 0.25).select("row", "col", F.round("km2", 4).alias("km2"))


_CLEAN = "trim(regexp_replace(replace(replace(t, '–', '-'), '—', '-'), '\\s+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT p_partkey AS k, 'a' || chr(8211) || 'b   c' || chr(10) || (p_partkey % 9) || chr(8212) || 'x ' AS t, CASE p_partkey % 4 WHEN 0 THEN 'https://doi.org/10.1/A' || p_partkey WHEN 1 THEN ' doi:10.1/B' WHEN 2 THEN '' END AS doi FROM part) SELECT k, {_CLEAN} AS t, nullif(regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', ''), '') AS doi FROM d""")
def clean_texts(spark, sf):
    k = F.col("p_partkey")
    t = F.concat(F.lit("a–b   c\n"), (k % 9).cast("string"), F.lit("—x "))
    doi = F.when(k % 4 == 0, F.concat(F.lit("https://doi.org/10.1/A"), k.cast("string"))).when(k % 4 == 1, " doi:10.1/B").when(k % 4 == 2, "")
    return v.table(spark, sf, "part").select(k.alias("k"), scalars.normalise_text(t).alias("t"), scalars.normalise_doi(doi).alias("doi"))


_POOL = ("Night lights of the southern sea and their fishing fleets", "Night lights of the southern sea and their fishing fleets and ports", "Radar detection of small vessels in coastal waters", "Radar detection of small vessels in coastal waters today", "A short one")
_WORKS = f"""w AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '10.1/' || (p_partkey % 35) END AS doi, {v._sql_pick('(p_partkey * 3 % 7)', 5, *_POOL)} || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || chr((97 + p_partkey % 26)::INTEGER) || chr((97 + p_partkey % 19)::INTEGER) || ' volume' END AS title, 2015 + p_partkey % 8 AS year, CASE WHEN p_partkey % 4 = 0 THEN 'preprint' ELSE 'article' END AS kind, CASE WHEN p_partkey % 3 <> 1 THEN 'Sea ' || (p_partkey % 2) END AS venue, CASE WHEN p_partkey % 9 = 0 THEN 'repository' END AS source_type, {v._sql_pick('p_partkey', 5, 'Nguyen An', 'Garcia M', None, 'An Nguyen')} AS author, p_partkey % 13 AS cited FROM part)"""
_TOKENS = lambda c: f"list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) >= 3))"
_KIN = "(len(a.tok) = 0 OR len(b.tok) = 0 OR list_has_any(a.tok, b.tok))"
_PRE = "(kind = 'preprint')"


@query(f"""WITH RECURSIVE {_WORKS}, r AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, trim(regexp_replace(lower(coalesce(venue, '')), '[^a-z0-9]+', ' ', 'g')) AS v, {_TOKENS('author')} AS tok, doi IS NULL AND venue IS NULL AS weak, {_PRE} OR coalesce(source_type = 'repository', false) OR (doi IS NULL AND venue IS NULL) AS sec FROM w),
e AS (SELECT a.id AS a, b.id AS b, 0 AS p FROM r a JOIN r b ON a.doi = b.doi AND a.id <> b.id UNION ALL SELECT a.id, b.id, 1 FROM r a JOIN r b ON a.t = b.t AND a.year = b.year AND a.id <> b.id AND len(a.t) >= 25
UNION ALL SELECT a.id, b.id, 2 FROM r a JOIN r b ON a.t = b.t AND len(a.t) >= 25 AND a.id <> b.id AND a.sec <> b.sec AND ((abs(a.year - b.year) <= 1 AND {_KIN}) OR (abs(a.year - b.year) <= 3 AND list_has_any(a.tok, b.tok)))
UNION ALL SELECT a.id, b.id, 3 FROM r a JOIN r b ON a.id <> b.id AND (a.weak OR b.weak) AND len(a.t) >= 25 AND len(b.t) >= 25 AND (contains(a.t, b.t) OR contains(b.t, a.t)) AND least(len(a.t), len(b.t)) >= 0.6 * greatest(len(a.t), len(b.t)) AND abs(a.year - b.year) <= 1 AND {_KIN}
UNION ALL SELECT a.id, b.id, 4 FROM r a JOIN r b ON a.t = b.t AND a.v = b.v AND a.v <> '' AND len(a.t) >= 25 AND a.id <> b.id AND abs(a.year - b.year) <= 1 AND {_KIN}),
d AS (SELECT DISTINCT a, b FROM e), c(id, root) AS (SELECT id, id FROM r UNION SELECT d.b, c.root FROM c JOIN d ON d.a = c.id), k AS (SELECT id, min(root) AS root FROM c GROUP BY id),
s AS (SELECT root, arg_min(r.id, struct_pack(a := CASE WHEN {_PRE} THEN 1 ELSE 0 END, b := CASE WHEN source_type = 'repository' THEN 1 ELSE 0 END, c := CASE WHEN doi IS NULL THEN 1 ELSE 0 END, d := CASE WHEN venue IS NULL THEN 1 ELSE 0 END, e := -cited, f := year, g := r.id)) AS survivor FROM k JOIN r USING (id) GROUP BY root), y AS (SELECT a AS id, min(p) AS p FROM e GROUP BY 1)
SELECT k.id, s.survivor, CASE WHEN k.id <> s.survivor THEN ['same_doi', 'same_title_year', 'secondary_of_title', 'weak_record_title_variant', 'same_title_venue'][y.p + 1] END AS reason FROM k JOIN s USING (root) LEFT JOIN y USING (id)""")
def dedupe_by_passes(spark, sf):
    """Works merged by DOI, title and year, secondary copies, weak variants, title and venue."""
    k = F.col("p_partkey")
    p = v.table(spark, sf, "part").withColumn("k3", k * 3 % 7)
    letter = lambda n: F.expr(f"char(97 + p_partkey % {n})")
    w = p.select(k.alias("id"), F.when(k % 5 == 0, F.concat(F.lit("10.1/"), (k % 35).cast("string"))).alias("doi"), F.concat(v._pick("k3", 5, *_POOL), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" "), letter(26), letter(19), F.lit(" volume")))).alias("title"), (F.lit(2015) + k % 8).alias("year"), F.when(k % 4 == 0, "preprint").otherwise("article").alias("kind"), F.when(k % 3 != 1, F.concat(F.lit("Sea "), (k % 2).cast("string"))).alias("venue"), F.when(k % 9 == 0, "repository").alias("source_type"), v._pick("p_partkey", 5, "Nguyen An", "Garcia M", None, "An Nguyen").alias("author"), (k % 13).alias("cited"))
    return dedupe.dedupe_works(w).select("id", "survivor", "reason")


@query(f"""WITH RECURSIVE o AS (SELECT k, floor(lon / 0.01 + 0.5)::BIGINT AS cx, floor(lat / 0.01 + 0.5)::BIGINT AS cy, lon, lat, epoch_us(acq) AS t, length_m FROM ({v.SQL_OBJECTS}) WHERE k % 5 = 0), l AS (SELECT k, floor(lon / 0.01 + 0.5)::BIGINT AS cx, floor(lat / 0.01 + 0.5)::BIGINT AS cy, lon, lat, epoch_us(ts) AS t, (k % 300 + 10)::DOUBLE AS len FROM ({v.SQL_LIGHTS})),
p AS (SELECT o.k AS ia, l.k AS ib, round({geo.sql_haversine_m('o.lon', 'o.lat', 'l.lon', 'l.lat')} / 1000 + abs(log2(o.length_m / l.len)), 6) AS cost FROM o JOIN l ON abs(o.cx - l.cx) <= 1 AND abs(o.cy - l.cy) <= 1 AND abs(o.t - l.t) <= 1800000000), q AS (SELECT row_number() OVER (ORDER BY cost, ia, ib) AS n, * FROM p),
g(n, ta, tb, ok) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], false UNION ALL SELECT q.n, CASE WHEN list_contains(ta, ia) OR list_contains(tb, ib) THEN ta ELSE list_append(ta, ia) END, CASE WHEN list_contains(ta, ia) OR list_contains(tb, ib) THEN tb ELSE list_append(tb, ib) END, NOT (list_contains(ta, ia) OR list_contains(tb, ib)) FROM g JOIN q ON q.n = g.n + 1),
w AS (SELECT ia, ib, cost FROM g JOIN q USING (n) WHERE ok) SELECT ia, count(*) AS n_cand, any_value(w.ib) AS ib, any_value(w.cost) AS cost FROM p LEFT JOIN w USING (ia) GROUP BY ia""")
def radar_pairs(spark, sf):
    """Contacts and gridded detections within half an hour, one to one by distance and length; losers keep their number of candidates."""
    o = v.objects(spark, sf).where("k % 5 = 0").select(F.col("k").alias("ia"), "lon", "lat", "acq", "length_m")
    l = v.lights(spark, sf).select(F.col("k").alias("ib"), "lon", "lat", "ts", (F.col("k") % 300 + 10).cast("double").alias("len"))  # noqa: E741
    p = proximity.block_join(o, l, 0.01).where(F.abs(F.unix_micros("acq") - F.unix_micros("r_ts")) <= 1_800_000_000)
    p = p.select("ia", F.col("r_ib").alias("ib"), F.round(F.col("dist_m") / 1000 + F.abs(F.log2(F.col("length_m") / F.col("r_len"))), 6).alias("cost"))
    won = assign.greedy(p)
    return p.groupBy("ia").agg(F.count("*").alias("n_cand")).join(won, "ia", "left").select("ia", "n_cand", "ib", "cost")


@query(f"""WITH s AS ({v.SQL_SCENES}), l AS (SELECT mission, orbit, max(start) AS t FROM s GROUP BY ALL), k AS (SELECT *, greatest(1, ceil((epoch_us(TIMESTAMP '2001-09-01') - epoch_us(t)) / 1036800000000))::BIGINT AS k FROM l), p AS (SELECT mission, orbit, n, epoch_us(t) + n * 1036800000000 AS due FROM k, generate_series(k, k + 7) g(n) WHERE k <= 3) SELECT mission, orbit, n AS cycles, due FROM p WHERE due BETWEEN epoch_us(TIMESTAMP '2001-09-01') AND epoch_us(TIMESTAMP '2001-09-01') + 72 * 3600000000""")
def predicted_passes(spark, sf):
    """Passes of the next three days that repeat one at most three cycles old."""
    return temporal.predict_repeats(v.scenes(spark, sf), ["mission", "orbit"], "start", F.lit("2001-09-01 00:00:00").cast("timestamp"), 72.0, 12, 3).select("mission", "orbit", "cycles", F.unix_micros("predicted").alias("due"))


@query(f"""WITH n AS (SELECT night, count(*) FILTER (WHERE class = 'lit_vessel_candidate') AS lit, count(*) FILTER (WHERE class = 'lit_vessel_candidate' AND quality = 'clear') AS clear, night * 37 % 100 AS moon FROM ({v.SQL_LIGHTS}) GROUP BY night), s AS (SELECT night FROM n WHERE moon <= 30 ORDER BY clear DESC, night LIMIT 1), o AS (SELECT n.*, row_number() OVER (ORDER BY n.night IN (SELECT night FROM s) DESC, moon, n.night) AS i FROM n), t AS (SELECT *, sum(lit) OVER (ORDER BY i) AS total FROM o), c AS (SELECT coalesce(min(i), 1000000) AS cut FROM t WHERE i > 1 AND total > (SELECT count(*) // 2 FROM ({v.SQL_LIGHTS})))
SELECT night, i AS place, total::BIGINT AS total FROM t, c WHERE i < c.cut""")
def lean_nights(spark, sf):
    """The showcase night, then from the darkest moon up, until a limit would be passed. Nights are few."""
    l = v.lights(spark, sf)  # noqa: E741
    n = l.groupBy("night").agg(F.count(F.when(F.col("class") == "lit_vessel_candidate", 1)).alias("lit"), F.count(F.when((F.col("class") == "lit_vessel_candidate") & (F.col("quality") == "clear"), 1)).alias("clear")).withColumn("moon", F.col("night") * 37 % 100)
    show = n.where("moon <= 30").orderBy(F.desc("clear"), "night").limit(1).select("night", F.lit(0).alias("_s"))
    limit = l.agg(F.floor(F.count("*") / 2).alias("_limit"))
    w = Window.orderBy(F.coalesce("_s", F.lit(1)), "moon", "night")  # nights alone
    t = n.join(show, "night", "left").withColumns({"place": F.row_number().over(w).cast("long"), "total": F.sum("lit").over(w.rowsBetween(Window.unboundedPreceding, 0))}).crossJoin(limit)  # one row
    cut = F.min(F.when((F.col("place") > 1) & (F.col("total") > F.col("_limit")), F.col("place"))).over(Window.partitionBy())
    return t.withColumn("_cut", cut).where("_cut is null or place < _cut").select("night", "place", "total")


@query(f"""WITH r AS (SELECT mmsi, event_id, epoch_us(ts) AS t, epoch_us(lag(ts) OVER (PARTITION BY mmsi ORDER BY ts, event_id)) AS p FROM ({v.SQL_AIS})), h AS (SELECT DISTINCT floor(epoch_us(ts) / 3600000000)::BIGINT AS hour FROM ({v.SQL_AIS}) WHERE event_id % 7 <> 0), g AS (SELECT mmsi, p, t, floor(p / 3600000000)::BIGINT AS a, floor(t / 3600000000)::BIGINT AS b FROM r WHERE t - p > 21600000000)
SELECT mmsi, p AS gap_start, t AS gap_end, (SELECT count(*) FROM h WHERE hour BETWEEN a AND b) < b - a + 1 AS overlaps FROM g""")
def track_gaps(spark, sf):
    """Silences over six hours, and whether the recorder missed an hour of them."""
    a = v.ais(spark, sf)
    hours = a.where("event_id % 7 <> 0").select(F.floor(F.unix_micros("ts") / 3_600_000_000).alias("hour")).distinct()
    return temporal.gaps_with_recorder(temporal.gaps(a, ["mmsi"], "ts", 21600, "event_id"), hours, ["mmsi"]).select("mmsi", F.unix_micros("gap_start").alias("gap_start"), F.unix_micros("gap_end").alias("gap_end"), "overlaps")
