"""Maritime views of the test tables, as DataFrames and as the same SELECT in DuckDB SQL.

The tables hold no coordinates; integer arithmetic on ids gives every row a place, so both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lon(key: str):
    return F.lit(99.0) + (F.col(key) * 7919 % 23250) / F.lit(1000.0)


def _lat(key: str):
    return (F.col(key) * 104729 % 27250) / F.lit(1000.0) - F.lit(3.25)


def ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transponder reports: mmsi, ts, lon, lat, sog_kn, msg_type."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("user_id") + 201000000).alias("mmsi"), F.col("ts").cast("timestamp").alias("ts"), _lon("event_id").alias("lon"), _lat("event_id").alias("lat"), (F.col("value") / 10).alias("sog_kn"), F.col("event_type").alias("msg_type"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar contacts: det_id, acq, lon, lat, length_m, cnn, confidence, status."""
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    x = table(spark, sf_dir, "lineitem").withColumn("_k", key)
    return x.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("det_id"), F.col("l_shipdate").cast("timestamp").alias("acq"),
        _lon("_k").alias("lon"), _lat("_k").alias("lat"), (F.col("l_quantity") * 4).alias("length_m"), (F.col("l_discount") * 10).alias("cnn"),
        F.element_at(F.create_map(F.lit("A"), F.lit("high"), F.lit("N"), F.lit("medium"), F.lit("R"), F.lit("low")), F.col("l_returnflag")).alias("confidence"),
        F.when(F.col("l_linestatus") == "F", "matched").otherwise("unmatched").alias("status"), F.col("l_tax").alias("wind"), F.col("l_suppkey").alias("l_suppkey"),
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliographic works from documents: id, title (the first line, whole), abstract, year, venue, lang."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), (F.col("doc_id") % 12 + 2015).alias("year"), F.col("source").alias("venue"), "lang")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellite scenes from orders: scene_id, mission, orbit, start, stop, dwell minutes."""
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") * 37 % 1440).cast("int"))
    out = o.select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderstatus").alias("mission"), (F.col("o_custkey") % 175).alias("orbit"), start.alias("start"), (F.col("o_orderkey") % 25 + 1).cast("int").alias("minutes"))
    return out.withColumn("stop", F.col("start") + F.make_dt_interval(mins=F.col("minutes")))


SQL_AIS = "SELECT event_id, user_id + 201000000 AS mmsi, ts, 99.0::DOUBLE + (event_id * 7919 % 23250)::DOUBLE / 1000.0 AS lon, (event_id * 104729 % 27250)::DOUBLE / 1000.0 - 3.25::DOUBLE AS lat, value / 10 AS sog_kn, event_type AS msg_type FROM events"
SQL_CONTACTS = "SELECT l_orderkey || '_' || l_linenumber AS det_id, l_shipdate AS acq, 99.0::DOUBLE + ((l_orderkey * 7 + l_linenumber) * 7919 % 23250)::DOUBLE / 1000.0 AS lon, ((l_orderkey * 7 + l_linenumber) * 104729 % 27250)::DOUBLE / 1000.0 - 3.25::DOUBLE AS lat, l_quantity * 4 AS length_m, l_discount * 10 AS cnn, CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' WHEN 'R' THEN 'low' END AS confidence, CASE WHEN l_linestatus = 'F' THEN 'matched' ELSE 'unmatched' END AS status, l_tax AS wind, l_suppkey FROM lineitem"
SQL_WORKS = "SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS abstract, doc_id % 12 + 2015 AS year, source AS venue, lang FROM documents"
SQL_SCENES = "SELECT o_orderkey AS scene_id, o_orderstatus AS mission, o_custkey % 175 AS orbit, o_orderdate + to_minutes((o_orderkey * 37 % 1440)::INTEGER) AS start, (o_orderkey % 25 + 1)::INTEGER AS minutes, o_orderdate + to_minutes((o_orderkey * 37 % 1440 + o_orderkey % 25 + 1)::INTEGER) AS stop FROM orders"


# A small busy sea (75 by 90 km from 105 E, 10 N, half a day of reports), on which the matcher's limits of metres and minutes have something to decide.
_DAY = 1705276800000000  # 2024-01-15 in microseconds


def _near_lon(key: str):
    return F.lit(105.0) + (F.col(key) * 7919 % 69750) / F.lit(100000.0)


def _near_lat(key: str):
    return F.lit(10.0) + (F.col(key) * 104729 % 81750) / F.lit(100000.0)


def _sql_near(key: str) -> str:
    return f"105.0::DOUBLE + ({key} * 7919 % 69750)::DOUBLE / 100000.0 AS lon, 10.0::DOUBLE + ({key} * 104729 % 81750)::DOUBLE / 100000.0 AS lat"


def _pick(key: str, n: int, *values):
    """The value at ``key % n``; the last one beyond the list."""
    out = F.lit(values[-1])
    for i, x in reversed(list(enumerate(values[:-1]))):
        out = F.when(F.col(key) % n == i, F.lit(x)).otherwise(out)
    return out


def _sql_pick(key: str, n: int, *values) -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()
    return f"CASE {key} % {n} " + " ".join(f"WHEN {i} THEN {text(x)}" for i, x in enumerate(values[:-1])) + f" ELSE {text(values[-1])} END"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the small sea: event_id, mmsi, ts, lon, lat, sog_kn, cog_deg, length_m."""
    e = table(spark, sf_dir, "events")
    ts = F.timestamp_micros(F.lit(_DAY) + F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 48"))
    return e.select(
        "event_id", (F.col("user_id") + 201000000).alias("mmsi"), ts.alias("ts"), _near_lon("event_id").alias("lon"), _near_lat("event_id").alias("lat"),
        F.when(F.col("event_id") % 9 != 0, F.col("value") / 10).alias("sog_kn"), F.when(F.col("event_id") % 8 != 0, (F.col("event_id") * 37 % 360).cast("double")).alias("cog_deg"),
        F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 190 + 10).cast("double")).alias("length_m"),
    )


SQL_REPORTS = f"SELECT event_id, user_id + 201000000 AS mmsi, make_timestamp({_DAY} + (epoch_us(ts) - 1704067200000000) // 48) AS ts, {_sql_near('event_id')}, CASE WHEN event_id % 9 <> 0 THEN value / 10 END AS sog_kn, CASE WHEN event_id % 8 <> 0 THEN (event_id * 37 % 360)::DOUBLE END AS cog_deg, CASE WHEN user_id % 7 <> 0 THEN (user_id % 190 + 10)::DOUBLE END AS length_m FROM events"

_CLASSES = ("fixed", "high", "high", "medium", "medium", "low")
_POLS = ("VV+VH", "VV only", "VH only", None)
_CALM = (None, True, False)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar contacts of the small sea in forty scenes: det_id, k, scene_id, pass_id, acq, lon, lat, length_m, confidence, cnn_score, pol_class, wind_ms, deep_convection, match_ambiguous, ais_status, n_low_1km, near_fixed_m."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    k = F.col("k")
    return o.select(
        F.concat(F.lit("K"), k.cast("string")).alias("det_id"), "k", (k % 40).alias("scene_id"), F.concat(F.lit("P"), F.expr("(k % 40) div 4").cast("string")).alias("pass_id"),
        F.timestamp_micros(F.lit(_DAY) + (k % 40 * 20 + 10) * 60_000_000).alias("acq"), _near_lon("k").alias("lon"), _near_lat("k").alias("lat"),
        (k * 13 % 400 + 5).cast("double").alias("length_m"), _pick("k", 6, *_CLASSES).alias("confidence"), ((k * 31 % 100) / F.lit(100.0)).alias("cnn_score"), _pick("k", 4, *_POLS).alias("pol_class"),
        F.when(k % 11 != 0, (k * 17 % 150) / F.lit(10.0)).alias("wind_ms"), F.when(k % 5 != 0, k % 9 == 0).alias("deep_convection"), F.when(k % 3 != 0, k % 13 == 0).alias("match_ambiguous"),
        _pick("k", 10, "matched", "no_coverage", "unmatched").alias("ais_status"), F.when(k % 4 != 0, k % 7).alias("n_low_1km"), F.when(k % 2 != 0, (k * 29 % 1000).cast("double")).alias("near_fixed_m"),
    )


SQL_OBJECTS = f"""SELECT 'K' || k AS det_id, k, k % 40 AS scene_id, 'P' || ((k % 40) // 4) AS pass_id, make_timestamp({_DAY} + (k % 40 * 20 + 10) * 60000000) AS acq, {_sql_near('k')}, (k * 13 % 400 + 5)::DOUBLE AS length_m, {_sql_pick('k', 6, *_CLASSES)} AS confidence, (k * 31 % 100)::DOUBLE / 100.0 AS cnn_score,
{_sql_pick('k', 4, *_POLS)} AS pol_class, CASE WHEN k % 11 <> 0 THEN (k * 17 % 150)::DOUBLE / 10.0 END AS wind_ms, CASE WHEN k % 5 <> 0 THEN k % 9 = 0 END AS deep_convection, CASE WHEN k % 3 <> 0 THEN k % 13 = 0 END AS match_ambiguous, {_sql_pick('k', 10, 'matched', 'no_coverage', 'unmatched')} AS ais_status,
CASE WHEN k % 4 <> 0 THEN k % 7 END AS n_low_1km, CASE WHEN k % 2 <> 0 THEN (k * 29 % 1000)::DOUBLE END AS near_fixed_m FROM (SELECT o_orderkey AS k FROM orders)"""


def object_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty scenes: scene_id, acq, mission."""
    return objects(spark, sf_dir).select("scene_id", "acq", F.when(F.col("scene_id") % 8 < 4, "A").otherwise("B").alias("mission")).distinct()


SQL_OBJECT_SCENES = f"SELECT DISTINCT scene_id, acq, CASE WHEN scene_id % 8 < 4 THEN 'A' ELSE 'B' END AS mission FROM ({SQL_OBJECTS})"

_LIT = ("lit_vessel_candidate", "persistent_light")


def lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Night lights: light_id, k, lon, lat, ts, night, radiance, quality, class, s1_passes, infra_m. Over the whole grid where ``wide`` says so."""
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    k = F.col("k")
    return p.select(
        F.concat(F.lit("L"), k.cast("string")).alias("light_id"), "k", _near_lon("k").alias("lon"), _near_lat("k").alias("lat"), _lon("k").alias("wide_lon"), _lat("k").alias("wide_lat"),
        F.timestamp_micros(F.lit(_DAY) + (k * 53 % 720) * 60_000_000).alias("ts"), (k % 9).alias("night"), F.when(k % 10 != 0, (k * 19 % 500) / F.lit(10.0)).alias("radiance"),
        F.when(k % 5 == 0, "cloudy").otherwise("clear").alias("quality"), _pick("k", 3, _LIT[1], _LIT[0]).alias("class"), (k % 4).alias("s1_passes"), F.when(k % 6 != 0, (k * 41 % 4000).cast("double")).alias("infra_m"),
    )


SQL_LIGHTS = f"""SELECT 'L' || k AS light_id, k, {_sql_near('k')}, 99.0::DOUBLE + (k * 7919 % 23250)::DOUBLE / 1000.0 AS wide_lon, (k * 104729 % 27250)::DOUBLE / 1000.0 - 3.25::DOUBLE AS wide_lat, make_timestamp({_DAY} + (k * 53 % 720) * 60000000) AS ts, k % 9 AS night,
CASE WHEN k % 10 <> 0 THEN (k * 19 % 500)::DOUBLE / 10.0 END AS radiance, CASE WHEN k % 5 = 0 THEN 'cloudy' ELSE 'clear' END AS quality, {_sql_pick('k', 3, _LIT[1], _LIT[0])} AS class, k % 4 AS s1_passes, CASE WHEN k % 6 <> 0 THEN (k * 41 % 4000)::DOUBLE END AS infra_m FROM (SELECT p_partkey AS k FROM part)"""


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour events with a span: event_key, vessel, kind, lon, lat, start, stop."""
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    k = F.col("k")
    start = F.lit(_DAY) + (k * 71 % 720) * 60_000_000
    return c.select(F.concat(F.lit("E"), k.cast("string")).alias("event_key"), (k % 150 + 201000000).alias("vessel"), _pick("k", 3, "gap", "encounter", "loitering").alias("kind"), _near_lon("k").alias("lon"), _near_lat("k").alias("lat"), F.timestamp_micros(start).alias("start"), F.timestamp_micros(start + (k % 200) * 60_000_000).alias("stop"))


SQL_BEHAVIOUR = f"SELECT 'E' || k AS event_key, k % 150 + 201000000 AS vessel, {_sql_pick('k', 3, 'gap', 'encounter', 'loitering')} AS kind, {_sql_near('k')}, make_timestamp({_DAY} + (k * 71 % 720) * 60000000) AS start, make_timestamp({_DAY} + (k * 71 % 720 + k % 200) * 60000000) AS stop FROM (SELECT c_custkey AS k FROM customer)"


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned passes with boxes: pass_group, start, west, south, east, north, status."""
    n = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("long"))
    k = F.col("k")
    w, s = F.lit(105.0) + (k * 3 % 20) / F.lit(33.0), F.lit(10.0) + (k * 7 % 24) / F.lit(33.0)
    return n.select(F.concat(F.lit("G"), k.cast("string")).alias("pass_group"), F.timestamp_micros(F.lit(_DAY) + k * 45 * 60_000_000).alias("start"), w.alias("west"), s.alias("south"), (w + 0.301).alias("east"), (s + 0.301).alias("north"), _pick("k", 6, "past", "planned").alias("status"))


SQL_PLAN = f"SELECT 'G' || k AS pass_group, make_timestamp({_DAY} + k * 45 * 60000000) AS start, w AS west, s AS south, w + 0.301::DOUBLE AS east, s + 0.301::DOUBLE AS north, {_sql_pick('k', 6, 'past', 'planned')} AS status FROM (SELECT k, 105.0::DOUBLE + (k * 3 % 20)::DOUBLE / 33.0 AS w, 10.0::DOUBLE + (k * 7 % 24)::DOUBLE / 33.0 AS s FROM (SELECT n_nationkey::BIGINT AS k FROM nation))"
