"""Queries of the read API: filtered lists, search, identity, leads, export."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pelagos.functions import scalars
from pelagos.operators import aggregate, evidence, filters, paging, service
from pelagos.plans.registry import query
from pelagos.sources import views as v
from pelagos.streaming import live


@query(f"""WITH a AS ({v.SQL_AIS}) SELECT event_id, mmsi, round(sog_kn, 6) AS sog_kn FROM a WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND lon BETWEEN 100 AND 115 AND lat BETWEEN 0 AND 20 ORDER BY a.sog_kn DESC NULLS LAST, event_id LIMIT 100 OFFSET 50""")
def window_filter_page(spark, sf):
    a = v.ais(spark, sf)
    box = filters.parse_bbox("100,0,115,20")
    found = a.where(filters.mask_window(F.col("ts"), F.col("lon"), F.col("lat"), "2024-01-05", "2024-01-20", box))
    return paging.page(paging.order_by(found, "-sog_kn", ("sog_kn", "ts", "event_id"), "event_id"), 100, 50).select("event_id", "mmsi", F.round("sog_kn", 6).alias("sog_kn"))


@query(f"""WITH a AS ({v.SQL_AIS}), r AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY sog_kn DESC NULLS LAST, event_id) AS rank FROM a) SELECT mmsi, event_id, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def topn_per_group(spark, sf):
    return aggregate.top_n(v.ais(spark, sf), ["mmsi"], [F.desc_nulls_last("sog_kn"), F.asc("event_id")], 5).select("mmsi", "event_id", "rank")


@query("""SELECT url, min(page_id) AS page_id FROM pages WHERE starts_with(url, 'https://www.') GROUP BY url ORDER BY url LIMIT 20""")
def id_prefix_search(spark, sf):
    p = v.table(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    return paging.prefix_search(p, "url", "https://www.", 20)


@query("""SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, NULL FROM supplier""")
def union_conform(spark, sf):
    c = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return paging.union_conform({"customer": c, "supplier": s})


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events""")
def json_props_flatten(spark, sf):
    e = v.table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), "event_type")


@query("""WITH q AS (SELECT c_custkey AS id, c_name AS name, 'customer' AS kind, CASE WHEN c_name = 'Customer#000000001' THEN 3 WHEN starts_with(c_name, 'Customer#00000000') THEN 2 ELSE 1 END AS score FROM customer WHERE contains(c_name, '00000001')
UNION ALL SELECT s_suppkey, s_name, 'supplier', CASE WHEN s_name = 'Supplier#000000001' THEN 3 WHEN starts_with(s_name, 'Supplier#00000000') THEN 2 ELSE 1 END FROM supplier WHERE contains(s_name, '00000001'))
SELECT kind, id, name, score FROM q ORDER BY score DESC, kind, id LIMIT 50""")
def search_fan_out(spark, sf):
    parts = []
    for kind, table, key, name, label in (("customer", "customer", "c_custkey", "c_name", "Customer"), ("supplier", "supplier", "s_suppkey", "s_name", "Supplier")):
        x = v.table(spark, sf, table).where(F.col(name).contains("00000001"))
        score = F.when(F.col(name) == f"{label}#000000001", 3).when(F.col(name).startswith(f"{label}#00000000"), 2).otherwise(1)
        parts.append(x.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(name).alias("name"), score.alias("score")))
    return parts[0].unionByName(parts[1]).orderBy(F.desc("score"), "kind", "id").limit(50)


@query("""SELECT c.c_custkey AS id, coalesce(s.s_name, c.c_name) AS name, n.n_name AS flag, r.r_name AS registry, s.s_suppkey IS NOT NULL AS known FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey LEFT JOIN nation n ON n.n_nationkey = coalesce(s.s_nationkey, c.c_nationkey) LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def identity_merge(spark, sf):
    c, s = v.table(spark, sf, "customer"), v.table(spark, sf, "supplier")
    n, r = v.table(spark, sf, "nation"), v.table(spark, sf, "region")
    x = c.join(s, c["c_custkey"] == s["s_suppkey"], "left")
    x = x.join(n, n["n_nationkey"] == F.coalesce("s_nationkey", "c_nationkey"), "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return x.select(F.col("c_custkey").alias("id"), F.coalesce("s_name", "c_name").alias("name"), F.col("n_name").alias("flag"), F.col("r_name").alias("registry"), F.col("s_suppkey").isNotNull().alias("known"))


@query(f"""WITH c AS ({v.SQL_CONTACTS}) SELECT strftime(acq, '%Y-%m') AS month, confidence, status, count(*) AS n, median(length_m) AS median_length, max(length_m) AS longest, sum(cnn >= 0.5)::BIGINT AS strong FROM c GROUP BY ALL""")
def pass_summary(spark, sf):
    c = v.contacts(spark, sf).groupBy(F.date_format("acq", "yyyy-MM").alias("month"), "confidence", "status")
    return c.agg(F.count("*").alias("n"), F.median("length_m").alias("median_length"), F.max("length_m").alias("longest"), F.count(F.when(F.col("cnn") >= 0.5, 1)).alias("strong"))


@query("""SELECT l.l_suppkey AS id, count(*) AS orders FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal < 0) AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size >= 10) GROUP BY 1""")
def semi_anti_join(spark, sf):
    x, s, p = (v.table(spark, sf, t) for t in ("lineitem", "supplier", "part"))
    x = x.join(s.where("s_acctbal < 0"), x["l_suppkey"] == s["s_suppkey"], "left_anti").join(p.where("p_size >= 10"), x["l_partkey"] == p["p_partkey"], "left_semi")
    return x.groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("orders"))


@query(f"""WITH a AS ({v.SQL_AIS}) SELECT event_id, to_json(struct_pack(type := 'Feature', id := event_id, mmsi := mmsi, kind := msg_type)) AS feature FROM a""")
def export_features(spark, sf):
    a = v.ais(spark, sf)
    return a.select("event_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("event_id").alias("id"), "mmsi", F.col("msg_type").alias("kind")), {"ignoreNullFields": "false"}).alias("feature"))


@query("""WITH e AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events) SELECT user_id, event_id FROM e WHERE total <= 1000""")
def greedy_budget(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return v.table(spark, sf, "events").withColumn("total", F.sum("value").over(w)).where("total <= 1000").select("user_id", "event_id")


@query("""SELECT 'contacts' AS kind, count(*) AS n FROM lineitem UNION ALL SELECT 'reports', count(*) FROM events UNION ALL SELECT 'scenes', count(*) FROM orders UNION ALL SELECT 'works', count(*) FROM documents""")
def object_counts(spark, sf):
    parts = [v.table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, t in (("contacts", "lineitem"), ("reports", "events"), ("scenes", "orders"), ("works", "documents"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_STATES = ("new", "reviewing", "closed_explained", "closed_unexplained", "closed_false_alarm", "lost")
_TEXTS = ("VMS fleet", "vms_fleet", "other", "Rain cell (note required)", None, "no carriage requirement", "nonsense", "sea_clutter")
_ALLOWED_SQL = " OR ".join(f"(f = '{a}' AND t IN ({', '.join(repr(x) for x in b)}))" for a, b in service.ALLOWED.items())
_PLAIN = "trim(regexp_replace(replace(lower(trim(coalesce(r, ''))), '_', ' '), '\\(note required\\)$', ''))"
_REASON = "CASE " + " ".join(f"WHEN t = '{s}' AND p IN ('{x.lower()}', '{x.lower().split(' (')[0]}') THEN '{x}'" for s, xs in service.REASONS.items() for x in xs) + " END"


@query(f"""WITH d AS (SELECT event_id, {v._sql_pick('event_id', 6, *_STATES)} AS f, {v._sql_pick('(event_id // 6)', 6, *_STATES)} AS t, {v._sql_pick('(event_id // 7)', 8, *_TEXTS)} AS r, CASE WHEN event_id % 5 = 0 THEN 'seen' WHEN event_id % 5 = 1 THEN ' ' END AS note FROM events), q AS (SELECT *, {_PLAIN} AS p FROM d), n AS (SELECT *, {_REASON} AS reason, trim(coalesce(note, '')) = '' AS bare FROM q)
SELECT event_id, reason, CASE WHEN NOT ({_ALLOWED_SQL}) THEN 'transition_not_allowed' WHEN t IN ('closed_explained', 'closed_false_alarm') AND reason IS NULL THEN 'reason_required' WHEN t IN ('closed_explained', 'closed_false_alarm') AND reason = 'other' AND bare THEN 'note_required' WHEN t = 'closed_unexplained' AND bare THEN 'note_required' WHEN t = 'reviewing' AND f LIKE 'closed%' AND bare THEN 'note_required' END AS problem FROM n""")
def decision_rules(spark, sf):
    """Which decisions on leads may stand, and the reason they mean."""
    e = v.table(spark, sf, "events").withColumns({"e6": F.expr("event_id div 6"), "e7": F.expr("event_id div 7")})
    d = e.select("event_id", v._pick("event_id", 6, *_STATES).alias("f"), v._pick("e6", 6, *_STATES).alias("t"), v._pick("e7", 8, *_TEXTS).alias("r"), F.when(F.col("event_id") % 5 == 0, "seen").when(F.col("event_id") % 5 == 1, " ").alias("note"))
    return d.select("event_id", service.canonical_reason(F.col("t"), F.col("r")).alias("reason"), service.decision_problem(F.col("f"), F.col("t"), F.col("r"), F.col("note")).alias("problem"))


@query()
def decision_states(spark, sf):
    """The state of each lead after its log; entries that do not follow are passed by."""
    e = v.table(spark, sf, "events").withColumns({"e6": F.expr("event_id div 6"), "e7": F.expr("event_id div 7")})
    log = e.select(F.col("user_id").alias("lead_id"), "event_id", v._pick("e6", 6, *_STATES).alias("to_state"), v._pick("e7", 8, *_TEXTS).alias("reason"), F.lit("seen").alias("note"))
    return service.replay(log, "lead_id", "event_id")


@query(f"""SELECT det_id, confidence, round(cnn_score, 6) AS cnn_score FROM ({v.SQL_OBJECTS}) WHERE lon BETWEEN 105.06 AND 105.6 AND lat BETWEEN 10.06 AND 10.75 AND confidence IN ('high', 'fixed') AND match_ambiguous IN (false) AND cnn_score >= 0.3 AND length_m <= 350 ORDER BY cnn_score DESC NULLS LAST, det_id LIMIT 60 OFFSET 5""")
def contacts_query(spark, sf):
    """The list endpoint's filters, order and page."""
    params = {"bbox": "105.06,10.06,105.6,10.75", "class": "high,fixed", "ambiguous": "false", "min_cnn": "0.3", "max_length": "350", "sort": "-cnn_score", "limit": "60", "offset": "5"}
    out = service.list_query(v.objects(spark, sf), params, {"class": "confidence", "ambiguous": "match_ambiguous"}, {"min_cnn": ("cnn_score", "min"), "max_length": ("length_m", "max")}, "acq", ("-cnn_score", ("cnn_score", "length_m"), "det_id"))
    return out.select("det_id", "confidence", F.round("cnn_score", 6).alias("cnn_score"))


@query(f"""SELECT det_id, strftime(acq, '%Y-%m-%dT%H:%M:%SZ') AS acq, wind_ms, coalesce(n_low_1km, 0)::INTEGER AS n_low_1km, 'open' AS build, NULL::VARCHAR AS vessel_key, match_ambiguous FROM ({v.SQL_OBJECTS})""")
def contact_records(spark, sf):
    """Records of fixed shape with defaults."""
    fields = [("det_id", "string"), ("acq", "time"), ("wind_ms", "double"), ("n_low_1km", "int"), ("build", "string"), ("vessel_key", "string"), ("match_ambiguous", "boolean")]
    return service.records(v.objects(spark, sf), fields, {"n_low_1km": 0, "build": "open"})


@query("""WITH h AS (SELECT 'customer' AS kind, c_name AS id, c_mktsegment AS label, starts_with(upper(c_name), 'CUSTOMER#00000001') AS hit FROM customer UNION ALL SELECT 'part', p_name, p_type, starts_with(upper(p_name), 'CUSTOMER#00000001') FROM part UNION ALL SELECT 'supplier', s_name, s_name, starts_with(upper(s_name), 'CUSTOMER#00000001') FROM supplier)
SELECT kind, id, label, CASE WHEN hit THEN CASE kind WHEN 'customer' THEN 0.95 WHEN 'part' THEN 0.9 ELSE 0.8 END WHEN upper(label) = 'CUSTOMER#00000001' THEN 1.0 ELSE 0.6 END::DOUBLE AS score FROM h WHERE hit OR contains(upper(label), 'CUSTOMER#00000001') ORDER BY score DESC, kind, id LIMIT 25""")
def search_kinds(spark, sf):
    c, p, s = (v.table(spark, sf, t) for t in ("customer", "part", "supplier"))
    return service.search([("customer", c, "c_name", "c_mktsegment", 0.95), ("part", p, "p_name", "p_type", 0.9), ("supplier", s, "s_name", "s_name", 0.8)], "Customer#00000001", 25)


@query("""WITH b AS (SELECT event_id, event_id % 4 <> 0 AS alive, CASE WHEN event_id % 3 <> 0 THEN (event_id * 7 % 1500)::DOUBLE END AS ago, (event_id * 13 % 400)::DOUBLE AS up, event_id % 5 AS streak FROM events)
SELECT event_id, CASE WHEN NOT alive THEN 'not_running' WHEN ago IS NULL AND up < 180 THEN 'starting' WHEN coalesce(ago, up) > 600 THEN 'stale' ELSE 'ok' END AS health, CASE WHEN streak <= 0 THEN 0.0 ELSE greatest(0.0, [60.0, 300.0, 900.0][least(streak, 3)] - up) END::DOUBLE AS wait_s FROM b""")
def recorder_health(spark, sf):
    e = v.table(spark, sf, "events")
    k, now = F.col("event_id"), F.lit("2024-02-01 00:00:00").cast("timestamp")
    back = lambda s: F.timestamp_micros(F.unix_micros(now) - s * 1_000_000)
    up = (k * 13 % 400).cast("double")
    health = live.recorder_health(k % 4 != 0, F.when(k % 3 != 0, back(k * 7 % 1500)), back(k * 13 % 400), now)
    return e.select("event_id", health.alias("health"), live.restart_wait_s(k % 5, up).alias("wait_s"))


@query(f"""WITH s AS (SELECT scene_id, acq, epoch_us(acq) + 7200000000 AS done FROM ({v.SQL_OBJECT_SCENES})), r AS (SELECT ts, epoch_us(ts) + (event_id % 5) * 3600000000 AS rec FROM ({v.SQL_REPORTS})) SELECT s.scene_id, count(*) AS late FROM s JOIN r ON abs(epoch_us(r.ts) - epoch_us(s.acq)) <= 1800000000 AND r.rec > s.done GROUP BY 1""")
def scenes_to_rematch(spark, sf):
    """Scenes with reports that arrived after they were processed."""
    s = v.object_scenes(spark, sf).select("scene_id", F.col("acq").alias("at"))
    done = s.select("scene_id", F.timestamp_micros(F.unix_micros("at") + 7_200_000_000).alias("processed"))
    r = v.reports(spark, sf).select("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 5 * 3_600_000_000).alias("received"))
    return live.rematch(s, done, r)


_REG = "SELECT o_custkey AS id, max(o_orderpriority) AS name, max(o_orderstatus) AS flag FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1"
_OWN = "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 5 <> 0 THEN 'F' END AS flag FROM customer WHERE c_custkey % 4 <> 1"


def _identities(spark, sf):
    k = F.col("c_custkey")
    own = v.table(spark, sf, "customer").where(k % 4 != 1).select(k.alias("id"), F.when(k % 2 == 0, F.col("c_name")).alias("name"), F.when(k % 5 != 0, F.lit("F")).alias("flag"))
    reg = v.table(spark, sf, "orders").where("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("name"), F.max("o_orderstatus").alias("flag"))
    return own, reg


@query(f"SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'report' WHEN a.name IS NULL AND a.flag IS NULL THEN 'registry' ELSE 'both' END AS source, coalesce(a.name, b.name) AS name, coalesce(a.flag, b.flag) AS flag FROM ({_OWN}) a FULL JOIN ({_REG}) b ON a.id = b.id")
def merged_identity(spark, sf):
    """Identities of reports and registry, field by field."""
    own, reg = _identities(spark, sf)
    return evidence.merge_identity(own, reg, "id", ["name", "flag"])


@query(f"SELECT a.id, b.id IS NOT NULL AS found, array_to_string(list_filter([CASE WHEN a.flag <> b.flag THEN 'flag' END, CASE WHEN a.name <> b.name THEN 'name' END], lambda x: x IS NOT NULL), ';') AS differs FROM ({_OWN}) a LEFT JOIN ({_REG}) b ON a.id = b.id")
def identity_differences(spark, sf):
    own, reg = _identities(spark, sf)
    return evidence.identity_differences(own, reg, "id", ["name", "flag"]).select("id", "found", F.array_join("differs", ";").alias("differs"))


@query("SELECT p_partkey AS id, p_name AS name, count(l.l_orderkey) AS labels FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_quantity > 40 GROUP BY 1, 2")
def windows_with_labels(spark, sf):
    """Image windows with their number of labels, none included."""
    p, x = v.table(spark, sf, "part"), v.table(spark, sf, "lineitem").where("l_quantity > 40")
    return p.join(x, p["p_partkey"] == x["l_partkey"], "left").groupBy(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).agg(F.count("l_orderkey").alias("labels"))


@query(f"""WITH o AS (SELECT *, {scalars.sql_bin('length_m', [0, 15, 25, 50, 100, 200, 500])} AS bin FROM ({v.SQL_OBJECTS})) SELECT bin, count(*) FILTER (WHERE ais_status = 'matched') AS found, count(*) FILTER (WHERE ais_status = 'no_coverage') AS missed, round(count(*) FILTER (WHERE ais_status = 'matched')::DOUBLE / count(*) FILTER (WHERE ais_status IN ('matched', 'no_coverage')), 6) AS recall FROM o WHERE ais_status IN ('matched', 'no_coverage') AND bin IS NOT NULL GROUP BY bin""")
def recall_by_length(spark, sf):
    """Found and missed vessels per length bin."""
    o = v.objects(spark, sf)
    out = aggregate.recall_by_bin(o.where("ais_status = 'matched'"), o.where("ais_status = 'no_coverage'"), scalars.length_bin(F.col("length_m"), [0, 15, 25, 50, 100, 200, 500]))
    return out.withColumn("recall", F.round("recall", 6))


@query(f"""WITH o AS (SELECT det_id, pass_id, sum(length(det_id) * 10) OVER (PARTITION BY pass_id ORDER BY cnn_score DESC, det_id ROWS UNBOUNDED PRECEDING) AS total FROM ({v.SQL_OBJECTS})) SELECT det_id, pass_id FROM o WHERE total <= 3000""")
def page_budget(spark, sf):
    """Contacts of a page in order of score while they fit its bytes."""
    o = v.objects(spark, sf).withColumn("bytes", F.length("det_id") * 10)
    return aggregate.within_budget(o, ["pass_id"], [F.desc("cnn_score"), F.asc("det_id")], "bytes", 3000).select("det_id", "pass_id")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS number, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'x' END AS text, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS items FROM events""")
def cleaned_values(spark, sf):
    k = F.col("event_id")
    x = F.when(k % 8 == 0, F.lit(float("nan"))).when(k % 4 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    text = F.when(k % 5 == 0, " NaN ").when(k % 5 == 1, "").otherwise(" x")
    flag = F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "0.0").otherwise("maybe")
    items = scalars.json_list(F.when(k % 2 == 0, '["a", "b"]').otherwise("not json"))
    return v.table(spark, sf, "events").select("event_id", scalars.clean_number(x).alias("number"), scalars.clean_text(text).alias("text"), scalars.clean_bool(flag).alias("flag"), F.size(items).alias("items"))
