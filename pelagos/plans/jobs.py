"""Jobs: chains of the operators, each a query with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pelagos.functions import geo, scalars, works
from pelagos.operators import aggregate, around, evidence, proximity, temporal, tracks
from pelagos.plans.registry import query
from pelagos.sources import views as v


def _hav(a: str, b: str) -> str:
    return geo.sql_haversine_m(f"{a}.lon", f"{a}.lat", f"{b}.lon", f"{b}.lat")


@query(f"""WITH o AS (SELECT *, k % 9 AS day FROM ({v.SQL_OBJECTS}) WHERE k % 10 = 0), l AS ({v.SQL_LIGHTS}), b AS ({v.SQL_BEHAVIOUR}), c AS (SELECT floor(lon / 0.01 + 0.5)::BIGINT AS cx, floor(lat / 0.01 + 0.5)::BIGINT AS cy, night, count(*) AS n, min(light_id) AS vessel FROM l WHERE quality = 'clear' GROUP BY ALL),
p AS (SELECT o.det_id, min(c.vessel) FILTER (WHERE c.cx = floor(o.lon / 0.01 + 0.5) AND c.cy = floor(o.lat / 0.01 + 0.5) AND c.night = o.day) AS vessel, coalesce(sum(c.n), 0)::BIGINT AS heard FROM o LEFT JOIN c ON c.cx BETWEEN floor(o.lon / 0.01 + 0.5) - 1 AND floor(o.lon / 0.01 + 0.5) + 1 AND c.cy BETWEEN floor(o.lat / 0.01 + 0.5) - 1 AND floor(o.lat / 0.01 + 0.5) + 1 GROUP BY 1),
e AS (SELECT o.det_id, count(*) AS n FROM o JOIN b ON abs(o.lat - b.lat) < 0.02 AND epoch_us(o.acq) BETWEEN epoch_us(b.start) - 10800000000 AND epoch_us(b.stop) + 10800000000 AND {_hav('o', 'b')} <= 2000 GROUP BY 1)
SELECT o.det_id, CASE WHEN p.vessel IS NOT NULL THEN 'matched' WHEN p.heard > 0 THEN 'unmatched' ELSE 'no_coverage' END AS ais_status, p.vessel, coalesce(e.n, 0) AS n_events FROM o JOIN p USING (det_id) LEFT JOIN e USING (det_id)""")
def identity_job(spark, sf):
    """Identity of contacts: pairing in the own cell and day, status by what was heard around, events as evidence."""
    o = v.objects(spark, sf).where("k % 10 = 0").withColumn("day", F.col("k") % 9)
    cell = lambda df: df.withColumns({"_cx": geo.centre_key(F.col("lon"), 0.01), "_cy": geo.centre_key(F.col("lat"), 0.01)})
    clear = v.lights(spark, sf).where("quality = 'clear'")
    own = cell(clear).groupBy("_cx", "_cy", F.col("night").alias("day")).agg(F.min("light_id").alias("vessel"))
    heard = proximity.block_counts(o, clear, "det_id", "light_id", 0.01).select("det_id", F.col("n").alias("heard"))
    out = cell(o).join(own, ["_cx", "_cy", "day"], "left").join(heard, "det_id", "left")
    out = evidence.near_in_span(out, v.behaviour(spark, sf), "acq", "event_key", "start", "stop", 2.0, 3.0, "ids")
    status = F.when(F.col("vessel").isNotNull(), "matched").when(F.col("heard") > 0, "unmatched").otherwise("no_coverage")
    return out.select("det_id", status.alias("ais_status"), "vessel", F.size("ids").cast("long").alias("n_events"))


_STEPS = (0.05, 0.1, 0.25)


@query(" UNION ALL ".join(f"SELECT {r}::DOUBLE AS res, count(*) AS cells, sum(least(a, b))::BIGINT AS pairs, count(*) FILTER (WHERE a > 0 AND b > 0) AS \"both\" FROM (SELECT floor(lon / {r} + 0.5) AS cx, floor(lat / {r} + 0.5) AS cy, k % 9 AS day, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM (SELECT lon, lat, k, 0 AS side FROM ({v.SQL_OBJECTS}) UNION ALL SELECT lon, lat, k, 1 FROM ({v.SQL_LIGHTS})) GROUP BY ALL)" for r in _STEPS))
def comparison_steps(spark, sf):
    """Two sources counted per cell and day at three resolutions."""
    x = v.objects(spark, sf).select("lon", "lat", "k", F.lit(0).alias("side")).unionByName(v.lights(spark, sf).select("lon", "lat", "k", F.lit(1).alias("side")))
    out = None
    for r in _STEPS:
        g = x.groupBy(geo.centre_key(F.col("lon"), r).alias("cx"), geo.centre_key(F.col("lat"), r).alias("cy"), (F.col("k") % 9).alias("day")).agg(F.count(F.when(F.col("side") == 0, 1)).alias("a"), F.count(F.when(F.col("side") == 1, 1)).alias("b"))
        part = g.agg(F.lit(r).alias("res"), F.count("*").alias("cells"), F.sum(F.least("a", "b")).alias("pairs"), F.count(F.when((F.col("a") > 0) & (F.col("b") > 0), 1)).alias("both"))
        out = part if out is None else out.unionByName(part)
    return out


_CELL = "floor((lat - 10.0::DOUBLE) / 0.05)::BIGINT AS row, floor((lon - 105.0::DOUBLE) / 0.05)::BIGINT AS col"


def _cells(df):
    return df.withColumns({"row": F.floor((F.col("lat") - 10.0) / 0.05), "col": F.floor((F.col("lon") - 105.0) / 0.05)})


@query(f"""WITH s AS (SELECT DISTINCT scene_id, {_CELL} FROM ({v.SQL_OBJECTS})), n AS (SELECT scene_id, {_CELL}, count(*) AS n FROM ({v.SQL_OBJECTS}) WHERE confidence IN ('high', 'medium') GROUP BY ALL), e AS (SELECT s.*, (20 + (s.row * 7 + s.col * 3 + s.scene_id) % 12)::DOUBLE AS km2 FROM s)
SELECT e.row, e.col, count(*) AS looks, round(sum(km2), 4) AS exposure, coalesce(sum(n.n), 0)::BIGINT AS observed, count(*) FILTER (WHERE coalesce(n.n, 0) = 0) AS empty FROM e LEFT JOIN n USING (scene_id, row, col) GROUP BY ALL""")
def exposure_table(spark, sf):
    """Looks, exposure and counts per cell, empty looks included."""
    o = _cells(v.objects(spark, sf))
    s = o.select("scene_id", "row", "col").distinct().withColumn("km2", (F.lit(20) + (F.col("row") * 7 + F.col("col") * 3 + F.col("scene_id")) % 12).cast("double"))
    n = o.where("confidence in ('high', 'medium')").groupBy("scene_id", "row", "col").agg(F.count("*").alias("n"))
    x = s.join(n, ["scene_id", "row", "col"], "left").na.fill(0, ["n"])
    return x.groupBy("row", "col").agg(F.count("*").alias("looks"), F.round(F.sum("km2"), 4).alias("exposure"), F.sum("n").alias("observed"), F.count(F.when(F.col("n") == 0, 1)).alias("empty"))


@query(f"""WITH t AS (SELECT {_CELL}, k % 9 AS night, count(*) AS n FROM ({v.SQL_LIGHTS}) GROUP BY ALL), m AS (SELECT row, col, avg(n) AS expected FROM t GROUP BY ALL), z AS (SELECT t.*, m.expected, (t.n - m.expected) / sqrt(m.expected) AS z FROM t JOIN m USING (row, col)) SELECT sha1('lights|' || night || '|' || row || '|' || col) AS event_id, night, row, col, n, round(expected, 6) AS expected, round(z, 6) AS z FROM z WHERE abs(z) >= 1""")
def activity_events(spark, sf):
    """Cells and nights far from what is usual there, with ids from their content."""
    t = _cells(v.lights(spark, sf)).groupBy("row", "col", "night").agg(F.count("*").alias("n"))
    m = F.avg("n").over(Window.partitionBy("row", "col"))
    z = t.withColumn("expected", m).withColumn("z", (F.col("n") - F.col("expected")) / F.sqrt("expected")).where("abs(z) >= 1")
    return z.select(F.sha1(F.concat_ws("|", F.lit("lights"), *(F.col(c).cast("string") for c in ("night", "row", "col")))).alias("event_id"), "night", "row", "col", "n", F.round("expected", 6).alias("expected"), F.round("z", 6).alias("z"))


@query(f"""WITH l AS ({v.SQL_LIGHTS}), s AS (SELECT x.light_id, count(DISTINCT y.night) AS seen FROM l x JOIN l y ON abs(x.lat - y.lat) < 0.005 WHERE {_hav('x', 'y')} <= 500 GROUP BY 1), c AS (SELECT floor(wide_lon) AS a, floor(wide_lat) AS b, count(DISTINCT night) AS clear FROM l WHERE quality = 'clear' GROUP BY ALL)
SELECT l.light_id, s.seen, coalesce(c.clear, 0) AS clear_nights, CASE WHEN s.seen >= greatest(3, ceil(0.3::DOUBLE * coalesce(c.clear, 0))) THEN 'persistent_light' ELSE 'lit_vessel_candidate' END AS light_class, coalesce(infra_m <= 1000, false) AS near_infra FROM l JOIN s USING (light_id) LEFT JOIN c ON c.a = floor(wide_lon) AND c.b = floor(wide_lat)""")
def light_table(spark, sf):
    """Lights with their recurrence, the clear nights of their cell and what stands near."""
    l = v.lights(spark, sf).drop("class")  # noqa: E741
    where = {"_a": F.floor("wide_lon"), "_b": F.floor("wide_lat")}
    clear = l.where("quality = 'clear'").withColumns(where).groupBy("_a", "_b").agg(F.count_distinct("night").alias("clear_nights"))
    x = l.withColumns(where).join(clear, ["_a", "_b"], "left").na.fill(0, ["clear_nights"])
    out = evidence.recurring(x, F.col("clear_nights"))
    return out.select("light_id", F.col("nights_seen").alias("seen"), "clear_nights", "light_class", F.coalesce(F.col("infra_m") <= 1000, F.lit(False)).alias("near_infra"))


@query(f"""SELECT night, {v._sql_pick('k', 3, 'a', 'b', 'c')} AS satellite, {_CELL}, count(*) AS pixels, count(*) FILTER (WHERE quality = 'clear') AS clear, round(count(*) FILTER (WHERE quality = 'clear')::DOUBLE / count(*), 6) AS share FROM ({v.SQL_LIGHTS}) GROUP BY ALL""")
def clear_sky(spark, sf):
    l = _cells(v.lights(spark, sf).withColumn("satellite", v._pick("k", 3, "a", "b", "c")))  # noqa: E741
    g = l.groupBy("night", "satellite", "row", "col").agg(F.count("*").alias("pixels"), F.count(F.when(F.col("quality") == "clear", 1)).alias("clear"))
    return g.withColumn("share", F.round(F.col("clear") / F.col("pixels"), 6))


@query(f"""WITH g AS (SELECT {_CELL}, count(*) FILTER (WHERE confidence = 'high') AS n, count(DISTINCT scene_id) AS looks FROM ({v.SQL_OBJECTS}) GROUP BY ALL) SELECT row, col, n, looks, round(1000 * n::DOUBLE / (30.0::DOUBLE * looks), 6) AS density, rank() OVER (ORDER BY n::DOUBLE / looks DESC) <= 5 AS densest FROM g WHERE looks >= 2""")
def density_grid(spark, sf):
    """Candidates per thousand square kilometres and look; the densest cells."""
    g = _cells(v.objects(spark, sf)).groupBy("row", "col").agg(F.count(F.when(F.col("confidence") == "high", 1)).alias("n"), F.count_distinct("scene_id").alias("looks")).where("looks >= 2")
    g = g.withColumn("_d", F.col("n") / F.col("looks"))
    fifth = g.orderBy(F.desc("_d")).limit(5).agg(F.min("_d").alias("_least"))
    return g.crossJoin(F.broadcast(fifth)).select("row", "col", "n", "looks", F.round(1000 * F.col("n") / (30.0 * F.col("looks")), 6).alias("density"), (F.col("_d") >= F.col("_least")).alias("densest"))  # one row on the right


@query(f"""WITH g AS (SELECT {_CELL}, det_id, scene_id % 2 AS side FROM ({v.SQL_OBJECTS}) WHERE k % 3 = 0), b AS (SELECT row, col FROM g GROUP BY ALL HAVING count(DISTINCT side) = 2) SELECT g.det_id, g.side FROM g JOIN b USING (row, col)""")
def shared_cells(spark, sf):
    """Objects in cells that both missions have seen."""
    g = _cells(v.objects(spark, sf).where("k % 3 = 0")).withColumn("side", F.col("scene_id") % 2)
    return g.join(g.groupBy("row", "col").agg(F.count_distinct("side").alias("n")).where("n = 2"), ["row", "col"], "left_semi").select("det_id", "side")


@query(f"""WITH s AS (SELECT scene_id, epoch_us(acq) AS t FROM ({v.SQL_OBJECT_SCENES})), w AS (SELECT scene_id, (scene_id * 37 % 15)::DOUBLE AS wind, (200 + scene_id * 13 % 60)::DOUBLE AS ctt FROM s WHERE scene_id % 5 <> 0) SELECT o.det_id, w.wind, w.ctt, w.ctt < 220 AS deep, w.scene_id IS NOT NULL AS has_weather FROM ({v.SQL_OBJECTS}) o LEFT JOIN w USING (scene_id)""")
def weather_per_contact(spark, sf):
    """Wind and cloud-top temperature of each contact's scene; deep convection below a temperature; some scenes lack weather."""
    k = F.col("scene_id")
    w = v.object_scenes(spark, sf).where("scene_id % 5 <> 0").select("scene_id", (k * 37 % 15).cast("double").alias("wind"), (F.lit(200) + k * 13 % 60).cast("double").alias("ctt"))
    return v.objects(spark, sf).join(w, "scene_id", "left").select("det_id", "wind", "ctt", (F.col("ctt") < 220).alias("deep"), F.col("wind").isNotNull().alias("has_weather"))




@query(f"""WITH g AS (SELECT row, col, sum(a) AS a, sum(b) AS b FROM (SELECT {_CELL}, 1 AS a, 0 AS b FROM ({v.SQL_OBJECTS}) UNION ALL SELECT {_CELL}, 0, 1 FROM ({v.SQL_LIGHTS})) GROUP BY ALL), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb, a, b FROM g)
SELECT count(*) AS cells, round(corr(ra, rb), 6) AS rho, round(count(*) FILTER (WHERE a > 0 AND b > 0)::DOUBLE / count(*), 6) AS shared FROM r""")
def two_sensors(spark, sf):
    """Rank correlation of two sensors' counts per cell, and the share of cells that both see."""
    x = _cells(v.objects(spark, sf)).select("row", "col", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(_cells(v.lights(spark, sf)).select("row", "col", F.lit(0).alias("a"), F.lit(1).alias("b")))
    g = x.groupBy("row", "col").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("all", F.lit(1))
    rho = aggregate.spearman(g, ["all"], "a", "b")
    name = next(c for c in rho.columns if c not in ("all", "n"))
    share = g.groupBy("all").agg(F.count("*").alias("cells"), (F.count(F.when((F.col("a") > 0) & (F.col("b") > 0), 1)) / F.count("*")).alias("shared"))
    return rho.join(share, "all").select("cells", F.round(name, 6).alias("rho"), F.round("shared", 6).alias("shared"))


@query(f"""WITH l AS (SELECT light_id, lon, lat, {v._sql_pick('k', 4, 'platform', 'turbine', 'other')} AS kind FROM ({v.SQL_LIGHTS})), o AS (SELECT lon, lat FROM ({v.SQL_OBJECTS}) WHERE confidence = 'fixed'), d AS (SELECT l.light_id, l.kind, min({_hav('l', 'o')}) AS d FROM l LEFT JOIN o ON abs(l.lat - o.lat) < 0.005 GROUP BY ALL), g AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE d <= 250) AS k250, count(*) FILTER (WHERE d <= 500) AS k500 FROM d GROUP BY 1)
SELECT kind, n, k250, k500, round({scalars.sql_wilson('k500', 'n', '-')}, 6) AS low, round({scalars.sql_wilson('k500', 'n', '+')}, 6) AS high FROM g""")
def structure_check(spark, sf):
    """The share of known structures with a fixed object near, by kind."""
    l = v.lights(spark, sf).withColumn("kind", v._pick("k", 4, "platform", "turbine", "other"))  # noqa: E741
    fixed = v.objects(spark, sf).where("confidence = 'fixed'").select("det_id", "lon", "lat")
    d = proximity.nearest(l.select("light_id", "lon", "lat", "kind"), fixed, "light_id", "det_id", 500.0)
    g = d.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("nearest_m") <= 250, 1)).alias("k250"), F.count(F.when(F.col("nearest_m") <= 500, 1)).alias("k500"))
    low, high = scalars.wilson(F.col("k500"), F.col("n"))
    return g.select("kind", "n", "k250", "k500", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH r AS (SELECT *, lag(lon) OVER w AS a, lag(lat) OVER w AS b, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000 AS dt FROM ({v.SQL_REPORTS}) WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id)), k AS (SELECT *, {geo.sql_haversine_m('a', 'b', 'lon', 'lat')} AS m FROM r)
SELECT mmsi, count(*) AS reports, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, arg_max(length_m, struct_pack(a := ts, b := event_id)) FILTER (WHERE length_m IS NOT NULL) AS length_m, bool_or(lon < 105.1 AND lat < 10.1) AS ever_inside, count(*) FILTER (WHERE a IS NULL OR dt <= 0 OR m / dt / 0.514444::DOUBLE <= 60) AS points FROM k GROUP BY mmsi""")
def vessel_table(spark, sf):
    """Vessels with first and last report, latest length, whether ever inside an area, and points left by the speed filter."""
    r = temporal.speed_from_previous(v.reports(spark, sf), "mmsi", "ts", "event_id", geo.haversine_m)
    g = r.groupBy("mmsi").agg(F.count("*").alias("reports"), F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last"), F.max_by("length_m", F.when(F.col("length_m").isNotNull(), F.struct("ts", "event_id"))).alias("length_m"), F.max((F.col("lon") < 105.1) & (F.col("lat") < 10.1)).alias("ever_inside"), F.count(F.when(F.col("step_kn").isNull() | (F.col("step_kn") <= 60), 1)).alias("points"))
    return g


_CTX = "f AS (SELECT p_partkey // 24 AS row, p_partkey % 24 AS col, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey * 7919 % 1000)::DOUBLE / 10 END AS value FROM part WHERE p_partkey < 700)"


@query(f"""WITH {_CTX}, a AS (SELECT event_id, lon, lat, ts::DATE AS day FROM ({v.SQL_AIS})), d AS (SELECT o_orderdate::DATE AS day, max(o_totalprice) AS sst FROM (SELECT DATE '2024-01-01' + (o_orderkey % 29)::INTEGER AS o_orderdate, o_totalprice FROM orders) GROUP BY 1) SELECT a.event_id, f.value AS depth, f.value > 50 AS deep, round(d.sst, 4) AS sst FROM a LEFT JOIN f ON f.row = floor(24.0::DOUBLE - lat)::BIGINT AND f.col = floor(lon - 99.0::DOUBLE)::BIGINT LEFT JOIN d USING (day)""")
def object_context(spark, sf):
    """Static samples at each object and the field of its day."""
    from pelagos.operators import grids
    from pelagos.plans.grids import _field

    a = v.ais(spark, sf).select("event_id", "lon", "lat", F.to_date("ts").alias("day"))
    d = v.table(spark, sf, "orders").select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 29).cast("int")).alias("day"), "o_totalprice").groupBy("day").agg(F.max("o_totalprice").alias("sst"))
    x = grids.sample_cells(a, _field(spark, sf), 99.0, 24.0, 1.0, "depth").join(d, "day", "left")
    return x.select("event_id", "depth", (F.col("depth") > 50).alias("deep"), F.round("sst", 4).alias("sst"))


@query(f"""WITH o AS (SELECT det_id, lon, lat, acq FROM ({v.SQL_OBJECTS}) WHERE k % 25 = 0), r AS ({v.SQL_REPORTS}), p AS (SELECT o.det_id, r.mmsi, min(struct_pack(d := {_hav('o', 'r')}, e := r.event_id)) AS b FROM o JOIN r ON abs(epoch_us(r.ts) - epoch_us(o.acq)) <= 900000000 GROUP BY ALL), k AS (SELECT det_id, mmsi, b.d AS d, row_number() OVER (PARTITION BY det_id ORDER BY b.d, mmsi) AS rank FROM p WHERE b.d <= 10000) SELECT det_id, mmsi, round(d, 2) AS dist_m, rank::INTEGER AS rank FROM k WHERE rank <= 3""")
def review_neighbours(spark, sf):
    """The three nearest vessels of each reviewed contact within a quarter of an hour."""
    o = v.objects(spark, sf).where("k % 25 = 0").select("det_id", "lon", "lat", "acq")
    near = around.nearest_few(o, v.reports(spark, sf), "mmsi", "acq", "ts", 10_000, 900, 3)
    return near.select("det_id", F.posexplode("near").alias("rank", "near")).select("det_id", F.col("near.id").alias("mmsi"), F.round("near.dist_m", 2).alias("dist_m"), (F.col("rank") + 1).alias("rank"))


@query(f"""SELECT det_id FROM ({v.SQL_OBJECTS}) WHERE ('0x' || substr(sha256('label:' || det_id), 1, 8))::BIGINT < CASE confidence WHEN 'high' THEN 0.5 WHEN 'medium' THEN 0.2 ELSE 0.05 END * 4294967296""")
def label_queue(spark, sf):
    """Contacts drawn for labelling at a rate by class, by a hash of their id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("label:"), "det_id"), 256), 1, 8), 16, 10).cast("long")
    rate = F.when(F.col("confidence") == "high", 0.5).when(F.col("confidence") == "medium", 0.2).otherwise(0.05)
    return v.objects(spark, sf).where(h < rate * 4294967296).select("det_id")


@query("""WITH s AS (SELECT p_partkey AS id, p_name AS name, p_partkey % 90 AS issn FROM part), a AS (SELECT c_custkey % 45 * 2 AS issn, max(round(c_acctbal, 2)) AS apc FROM customer GROUP BY 1), h AS (SELECT DISTINCT s_suppkey % 40 AS issn FROM supplier) SELECT s.id, CASE WHEN a.apc IS NOT NULL THEN a.apc::VARCHAR || ' | list' ELSE 'unknown | [UNVERIFIED]' END AS apc_known, h.issn IS NOT NULL AS flagged, CASE WHEN a.apc IS NOT NULL THEN 'VERIFIED' ELSE 'PARTIAL' END AS status FROM s LEFT JOIN a ON a.issn = s.issn LEFT JOIN h ON h.issn = s.issn""")
def venue_sheet(spark, sf):
    """A venue sheet: seed rows with a fee and its provenance, a screening list and a status."""
    s = v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 90).alias("issn"))
    a = v.table(spark, sf, "customer").groupBy((F.col("c_custkey") % 45 * 2).alias("issn")).agg(F.max(F.round("c_acctbal", 2)).alias("apc"))
    h = v.table(spark, sf, "supplier").select((F.col("s_suppkey") % 40).alias("issn")).distinct().withColumn("flagged", F.lit(True))
    x = s.join(a, "issn", "left").join(h, "issn", "left").na.fill(False, ["flagged"])
    cell = F.when(F.col("apc").isNotNull(), works.join_cell(F.col("apc").cast("string"), F.lit("list"))).otherwise("unknown | [UNVERIFIED]")
    return x.select("id", cell.alias("apc_known"), "flagged", works.cell_status([cell], F.lit("House")).alias("status"))


@query(f"""WITH t AS (SELECT {_CELL}, night, count(*) AS n, round(sum(radiance), 4) AS light FROM ({v.SQL_LIGHTS}) GROUP BY ALL), m AS (SELECT row, col, max(night) AS night FROM t GROUP BY ALL) SELECT t.row, t.col, t.night, t.n, t.light FROM t JOIN m USING (row, col, night)""")
def latest_night_cells(spark, sf):
    """Each cell's latest night."""
    t = _cells(v.lights(spark, sf)).groupBy("row", "col", "night").agg(F.count("*").alias("n"), F.round(F.sum("radiance"), 4).alias("light"))
    return t.groupBy("row", "col").agg(F.max_by(F.struct("night", "n", "light"), "night").alias("x")).select("row", "col", "x.*")


@query(f"""WITH p AS (SELECT mmsi, floor(epoch_us(ts) / 3600000000)::BIGINT AS h, floor(lon / 0.05) AS cx, floor(lat / 0.05) AS cy, event_id FROM ({v.SQL_REPORTS})), c AS (SELECT cx, cy, h, count(*) AS n, min(mmsi) AS first FROM p GROUP BY ALL), e AS (SELECT cx, cy, h, first, unnest(generate_series(1, n)) AS copy, n FROM c) SELECT CASE WHEN n <= 1 THEN 'one' WHEN n <= 3 THEN 'few' ELSE 'many' END AS crowd, count(*) AS rows, count(DISTINCT first) AS vessels FROM e GROUP BY 1""")
def presence_rows(spark, sf):
    """Cells with several detections as that many rows."""
    p = v.reports(spark, sf).groupBy(F.floor(F.col("lon") / 0.05).alias("cx"), F.floor(F.col("lat") / 0.05).alias("cy"), F.floor(F.unix_micros("ts") / 3_600_000_000).alias("h")).agg(F.count("*").alias("n"), F.min("mmsi").alias("first"))
    e = p.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return e.groupBy(F.when(F.col("n") <= 1, "one").when(F.col("n") <= 3, "few").otherwise("many").alias("crowd")).agg(F.count("*").alias("rows"), F.count_distinct("first").alias("vessels"))


@query(f"""WITH w AS (SELECT scene_id, count(*) AS labels FROM ({v.SQL_OBJECTS}) WHERE confidence = 'high' GROUP BY 1), g AS (SELECT s.scene_id, s.mission, coalesce(w.labels, 0) AS labels FROM ({v.SQL_OBJECT_SCENES}) s LEFT JOIN w USING (scene_id)) SELECT scene_id, mission, labels, row_number() OVER (PARTITION BY mission ORDER BY sha256('20261002:' || scene_id), scene_id) <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY mission)) AS test FROM g""")
def scene_splits(spark, sf):
    """Scenes with their labels and a fifth per mission held out, whole scenes at a time."""
    o = v.objects(spark, sf).where("confidence = 'high'").groupBy("scene_id").agg(F.count("*").alias("labels"))
    g = v.object_scenes(spark, sf).select("scene_id", "mission").join(o, "scene_id", "left").na.fill(0, ["labels"])
    w = Window.partitionBy("mission")
    rank = F.row_number().over(w.orderBy(F.sha2(F.concat(F.lit("20261002:"), F.col("scene_id").cast("string")), 256), "scene_id"))
    return g.withColumn("test", rank <= F.round(0.2 * F.count("*").over(w))).select("scene_id", "mission", "labels", "test")


@query(f"""WITH l AS (SELECT k % 700 AS label_id, k, confidence AS a, pol_class AS b FROM ({v.SQL_OBJECTS})), f AS (SELECT label_id, CASE WHEN count(DISTINCT a) <= 1 THEN arg_min(a, k) END AS kind, CASE WHEN count(DISTINCT b) <= 1 THEN arg_min(b, k) END AS channel, count(*) AS n FROM l GROUP BY 1), i AS (SELECT p_partkey AS label_id, p_size AS image FROM part) SELECT f.label_id, f.kind, f.channel, f.n, i.image FROM f LEFT JOIN i USING (label_id)""")
def label_table(spark, sf):
    """Labels joined to their images; attributes with conflicting values are blank."""
    o = v.objects(spark, sf).select((F.col("k") % 700).alias("label_id"), "k", F.col("confidence").alias("kind"), F.col("pol_class").alias("channel"))
    one = tracks.blank_conflicts(o, "label_id", ["k"], ["kind", "channel"]).join(o.groupBy("label_id").agg(F.count("*").alias("n")), "label_id")
    return one.join(v.table(spark, sf, "part").select(F.col("p_partkey").alias("label_id"), F.col("p_size").alias("image")), "label_id", "left").select("label_id", "kind", "channel", "n", "image")


@query(f"""WITH e AS (SELECT scene_id, count(*) AS n FROM ({v.SQL_OBJECTS}) GROUP BY 1), x AS (SELECT mission, count(*) AS scenes, sum(e.n)::BIGINT AS objects, round(avg(e.n), 6) AS mean FROM ({v.SQL_OBJECT_SCENES}) s JOIN e USING (scene_id) GROUP BY 1) SELECT * FROM x""")
def scene_totals(spark, sf):
    """Objects per mission and scene."""
    e = v.objects(spark, sf).groupBy("scene_id").agg(F.count("*").alias("n"))
    return v.object_scenes(spark, sf).join(e, "scene_id").groupBy("mission").agg(F.count("*").alias("scenes"), F.sum("n").alias("objects"), F.round(F.avg("n"), 6).alias("mean"))


@query(f"""WITH d AS (SELECT doc_id, md5(text) AS h, source FROM documents), s AS (SELECT h, min(doc_id) AS kept, count(*) AS n FROM d WHERE h IS NOT NULL GROUP BY h) SELECT d.doc_id AS id, s.kept, s.n - 1 AS merged FROM d JOIN s USING (h) WHERE d.doc_id = s.kept AND s.n > 1""")
def merge_log(spark, sf):
    """Works that others were merged into, with how many."""
    d = v.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h")).where("h is not null")
    return d.groupBy("h").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).where("n > 1").select("id", F.col("id").alias("kept"), (F.col("n") - 1).alias("merged"))


@query(f"""SELECT confidence, pol_class, count(*) AS n, round(avg(CASE WHEN wind_ms >= 12 THEN 1.0::DOUBLE ELSE 0 END), 6) AS windy FROM ({v.SQL_OBJECTS}) WHERE wind_ms IS NOT NULL GROUP BY ALL""")
def weather_shares(spark, sf):
    o = v.objects(spark, sf).where("wind_ms is not null")
    return o.groupBy("confidence", "pol_class").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("wind_ms") >= 12, 1.0).otherwise(0.0)), 6).alias("windy"))
