"""Summaries: corpora and screens, structures, rates, acceptance, estimates from samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos.functions import scalars
from pelagos.operators import summaries as s
from pelagos.plans.registry import query
from pelagos.sources import views as v

_MEMBERS = "list_filter([CASE WHEN doc_id % 5 <> 0 THEN lang END, CASE WHEN doc_id % 3 = 0 THEN source END, lang], lambda x: x IS NOT NULL)"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN [] ELSE {_MEMBERS} END AS ms FROM documents), e AS (SELECT DISTINCT doc_id, unnest(ms) AS member FROM d), c AS (SELECT member, count(*) AS n_papers FROM e GROUP BY 1)
SELECT member, n_papers, round(100 * n_papers::DOUBLE / (SELECT count(*) FROM d), 2) AS pct, round(100 * n_papers::DOUBLE / (SELECT count(*) FROM d WHERE len(ms) > 0), 2) AS pct_known, row_number() OVER (ORDER BY n_papers DESC, member)::INTEGER AS rank FROM c ORDER BY n_papers DESC, member LIMIT 12""")
def top_members(spark, sf):
    """Members of each work's list (countries, institutions), counted once a work."""
    d = v.table(spark, sf, "documents")
    ms = F.array_compact(F.array(F.when(F.col("doc_id") % 5 != 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.col("lang")))
    return s.ranked_members(d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(ms).alias("ms")), "doc_id", F.col("ms"), 12)


@query("SELECT coalesce(source, 'unattributed') AS venue_group, lang AS method, count(*) AS n FROM documents GROUP BY ALL")
def venue_coverage(spark, sf):
    return v.table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("unattributed")).alias("venue_group"), F.col("lang").alias("method")).agg(F.count("*").alias("n"))


_NATURES = ("Retraction", "Expression of concern", "Correction", "Reinstatement")


@query(f"""WITH n AS (SELECT 'journal ' || (o_custkey % 40) AS journal, {v._sql_pick('o_orderkey', 4, *_NATURES)} AS nature, o_orderdate::DATE AS day, ['reason ' || (o_orderkey % 5), CASE WHEN o_orderkey % 2 = 0 THEN 'reason ' || (o_orderkey % 3) ELSE '' END] AS reasons FROM orders), k AS (SELECT n_regionkey::BIGINT AS key, 'journal ' || n_nationkey AS name FROM nation),
h AS (SELECT k.key, n.* FROM n JOIN k ON n.journal = k.name), c AS (SELECT key, count(*) AS notices, count(*) FILTER (WHERE nature = 'Retraction') AS retractions, count(*) FILTER (WHERE nature = 'Retraction' AND day >= DATE '1998-01-01') AS retractions_since, count(*) FILTER (WHERE nature = 'Expression of concern') AS concerns, count(*) FILTER (WHERE nature = 'Correction') AS corrections FROM h GROUP BY key),
w AS (SELECT key, reason, count(*) AS c FROM (SELECT key, unnest(reasons) AS reason FROM h WHERE nature = 'Retraction') WHERE reason <> '' GROUP BY ALL), t AS (SELECT key, string_agg(reason || ' (' || c || ')', '; ' ORDER BY c DESC, reason) AS top_reasons FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, reason) <= 3) GROUP BY key)
SELECT c.*, t.top_reasons FROM c JOIN t USING (key)""")
def notices_by_venue(spark, sf):
    o, n = v.table(spark, sf, "orders"), v.table(spark, sf, "nation")
    k = F.col("o_orderkey")
    reason = lambda m: F.concat(F.lit("reason "), (k % m).cast("string"))
    notices = o.select(F.concat(F.lit("journal "), (F.col("o_custkey") % 40).cast("string")).alias("journal"), v._pick("o_orderkey", 4, *_NATURES).alias("nature"), F.to_date("o_orderdate").alias("day"), F.array(reason(5), F.when(k % 2 == 0, reason(3)).otherwise("")).alias("reasons"))
    venues = n.select(F.col("n_regionkey").cast("long").alias("key"), F.concat(F.lit("journal "), F.col("n_nationkey").cast("string")).alias("name"))
    return s.notices_by_venue(notices, venues, F.lit("1998-01-01").cast("date"))


_DET = f"SELECT k % 60 AS structure_id, lon, lat, CASE WHEN k % 11 <> 0 THEN 'kind' || (k % 3) END AS label, CASE WHEN k % 4 <> 0 THEN k % 5 END AS confidence, DATE '2023-01-01' + (k % 300)::INTEGER AS day, DATE '2022-01-01' + (k % 90)::INTEGER AS start_day, CASE WHEN k % 60 % 2 = 0 THEN DATE '2024-01-01' + (k % 50)::INTEGER END AS end_day FROM ({v.SQL_LIGHTS})"


@query(f"""WITH d AS ({_DET}), c AS (SELECT structure_id, label, count(*) AS c FROM d WHERE label IS NOT NULL GROUP BY ALL), l AS (SELECT structure_id, arg_min(label, struct_pack(a := -c, b := label)) AS label FROM c GROUP BY 1),
g AS (SELECT structure_id, median(lon) AS lon, median(lat) AS lat, arg_max(confidence, struct_pack(a := day, b := confidence)) FILTER (WHERE confidence IS NOT NULL) AS confidence, min(start_day) AS a, max(end_day) AS e, count(*) AS n, max(day) AS z FROM d GROUP BY 1)
SELECT structure_id, round(lon, 6) AS lon, round(lat, 6) AS lat, label, confidence, n, e IS NULL AS ongoing, round(date_diff('day', a, coalesce(e, z)) / 30.44::DOUBLE, 1) AS months FROM g LEFT JOIN l USING (structure_id)""")
def structures(spark, sf):
    k = F.col("k")
    day = lambda text, n: F.date_add(F.lit(text).cast("date"), n.cast("int"))
    d = v.lights(spark, sf).select((k % 60).alias("structure_id"), "lon", "lat", F.when(k % 11 != 0, F.concat(F.lit("kind"), (k % 3).cast("string"))).alias("label"), F.when(k % 4 != 0, k % 5).alias("confidence"), day("2023-01-01", k % 300).alias("day"), day("2022-01-01", k % 90).alias("start_day"), F.when(k % 60 % 2 == 0, day("2024-01-01", k % 50)).alias("end_day"))
    return s.structures(d).select("structure_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "label", "confidence", "n", "ongoing", "months")


@query(f"""SELECT night, k % 6 AS region, sum(CASE WHEN quality = 'clear' THEN 1 ELSE 0 END)::BIGINT AS n, sum((k % 900)::DOUBLE) AS area, round(CASE WHEN sum((k % 900)::DOUBLE) >= 5000 THEN 1000 * sum(CASE WHEN quality = 'clear' THEN 1 ELSE 0 END) / sum((k % 900)::DOUBLE) END, 6) AS rate FROM ({v.SQL_LIGHTS}) GROUP BY ALL""")
def nightly_rates(spark, sf):
    l = v.lights(spark, sf).withColumn("region", F.col("k") % 6)  # noqa: E741
    return s.rate_per_area(l, ["night", "region"], F.when(F.col("quality") == "clear", 1).otherwise(0), (F.col("k") % 900).cast("double"), 5000.0).withColumn("rate", F.round("rate", 6))


_ACC = ("confidence", "pol_class", "scene_id")


@query(f"""WITH o AS ({v.SQL_OBJECTS}), x AS (SELECT 'all' AS grp, 'all' AS value, cnn_score, length_m FROM o UNION ALL {' UNION ALL '.join(f"SELECT '{c}', {c}::VARCHAR, cnn_score, length_m FROM o" for c in _ACC)}), g AS (SELECT grp, value, count(*) AS n, count(*) FILTER (WHERE cnn_score >= 0.5) AS accepted, quantile_cont(cnn_score, 0.25) AS q25, quantile_cont(cnn_score, 0.5) AS q50, quantile_cont(cnn_score, 0.75) AS q75, median(length_m) AS length_m_median FROM x GROUP BY ALL)
SELECT grp, value, n, accepted, round(accepted::DOUBLE / n, 6) AS share, round({scalars.sql_wilson('accepted', 'n', '-')}, 6) AS low, round({scalars.sql_wilson('accepted', 'n', '+')}, 6) AS high, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, length_m_median FROM g""")
def acceptance_rows(spark, sf):
    """Acceptance by class, channels and scene, each on its own, and for all."""
    out = s.acceptance(v.objects(spark, sf), list(_ACC), F.col("cnn_score") >= 0.5, "cnn_score", ["length_m"])
    return out.select("grp", "value", "n", "accepted", *(F.round(c, 6).alias(c) for c in ("share", "low", "high", "q25", "q50", "q75")), "length_m_median")


_FILL = ("wind_ms", "deep_convection", "match_ambiguous", "pol_class", "near_fixed_m")


@query(f"WITH o AS ({v.SQL_OBJECTS}) " + " UNION ALL ".join(f"SELECT confidence, '{c}' AS name, count(*) AS n, count({c}) AS filled, round(count({c})::DOUBLE / count(*), 6) AS rate FROM o GROUP BY 1" for c in _FILL))
def fill_rates(spark, sf):
    return s.fill_rates(v.objects(spark, sf), "confidence", list(_FILL)).withColumn("rate", F.round("rate", 6))


@query(f"""WITH o AS ({v.SQL_OBJECTS}), q AS (SELECT confidence, count(*) AS size FROM o GROUP BY 1), d AS (SELECT confidence, count(*) AS n, count(*) FILTER (WHERE cnn_score >= 0.7) AS k FROM o WHERE k % 10 = 3 GROUP BY 1), j AS (SELECT *, size::DOUBLE / (SELECT sum(size) FROM q) AS w, k::DOUBLE / n AS p FROM d JOIN q USING (confidence))
SELECT round(sum(w * p), 6) AS share, round(sqrt(sum(CASE WHEN n > 1 THEN w * w * p * (1 - p) / (n - 1) ELSE 0 END)), 6) AS se, round(sum(k * size::DOUBLE / n), 4) AS total FROM j""")
def stratified_share(spark, sf):
    """The share of high scores in all contacts, from a tenth of them by class."""
    o = v.objects(spark, sf)
    out = s.stratified_share(o.where("k % 10 = 3"), "confidence", o.groupBy("confidence").agg(F.count("*").alias("size")), F.col("cnn_score") >= 0.7)
    return out.select(F.round("share", 6).alias("share"), F.round("se", 6).alias("se"), F.round("total", 4).alias("total"))


@query()
def bootstrap_share(spark, sf):
    """A weighted share with its interval over two hundred seeded replicates."""
    return s.bootstrap_share(v.objects(spark, sf).where("k % 10 = 3"), "k", F.col("cnn_score") >= 0.7, F.col("length_m"), 200, 11)


@query(f"""SELECT scene_id % 2 AS side, pol_class, floor(length_m / 50)::BIGINT AS bin, count(*) AS n, median(cnn_score) AS q50, round(quantile_cont(cnn_score, 0.25), 6) AS q25, round(quantile_cont(cnn_score, 0.75), 6) AS q75 FROM ({v.SQL_OBJECTS}) GROUP BY ALL""")
def noise_bins(spark, sf):
    """Median and quartiles per side, channel and bin."""
    q = F.percentile("cnn_score", F.array(F.lit(0.25), F.lit(0.75)))
    g = v.objects(spark, sf).groupBy((F.col("scene_id") % 2).alias("side"), "pol_class", F.floor(F.col("length_m") / 50).alias("bin")).agg(F.count("*").alias("n"), F.median("cnn_score").alias("q50"), q.alias("q"))
    return g.select("side", "pol_class", "bin", "n", "q50", F.round(F.col("q")[0], 6).alias("q25"), F.round(F.col("q")[1], 6).alias("q75"))


@query(f"""SELECT confidence, regr_count(cnn_score, wind_ms)::BIGINT AS n, round(regr_slope(cnn_score, wind_ms), 6) AS slope, round(regr_intercept(cnn_score, wind_ms), 6) AS intercept, round(regr_r2(cnn_score, wind_ms), 6) AS r2 FROM ({v.SQL_OBJECTS}) GROUP BY 1""")
def weather_fits(spark, sf):
    return s.linear_fit(v.objects(spark, sf), ["confidence"], "wind_ms", "cnn_score").select("confidence", "n", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")))


@query(f"""WITH g AS (SELECT floor(wind_ms / 3)::BIGINT AS bin, count(*) FILTER (WHERE scene_id % 2 = 0) AS n_a, count(*) FILTER (WHERE scene_id % 2 = 1) AS n_b, avg(cnn_score) FILTER (WHERE scene_id % 2 = 0) AS a, avg(cnn_score) FILTER (WHERE scene_id % 2 = 1) AS b FROM ({v.SQL_OBJECTS}) GROUP BY 1) SELECT bin, n_a, n_b, round(a - b, 6) AS difference FROM g WHERE n_a > 0 AND n_b > 0""")
def wind_matched_difference(spark, sf):
    o = v.objects(spark, sf).withColumn("side", F.when(F.col("scene_id") % 2 == 0, "a").otherwise("b"))
    return s.matched_difference(o, F.floor(F.col("wind_ms") / 3), "side", ("a", "b"), "cnn_score").withColumn("difference", F.round("difference", 6))


@query("""WITH j AS (SELECT d.doc_id, d.lang, CASE l.quality WHEN 1 THEN 'relevant' WHEN 0 THEN 'not relevant' END AS judgment FROM documents d JOIN labels l USING (doc_id)), e AS (SELECT judgment, 'all' AS theme FROM j WHERE judgment IS NOT NULL UNION ALL SELECT judgment, lang FROM j WHERE judgment IS NOT NULL AND lang IS NOT NULL)
SELECT theme, count(*) AS judged, count(*) FILTER (WHERE judgment = 'relevant') AS relevant, round(count(*) FILTER (WHERE judgment = 'relevant')::DOUBLE / count(*), 6) AS precision FROM e GROUP BY theme""")
def judged_precision(spark, sf):
    j = v.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "relevant").when(F.col("quality") == 0, "not relevant").alias("judgment"))
    out = s.judged_precision(v.table(spark, sf, "documents").select("doc_id", "lang"), j, "doc_id", F.array_compact(F.array("lang")))
    return out.withColumn("precision", F.round("precision", 6))


@query(f"WITH d AS (SELECT DISTINCT start::DATE AS d FROM ({v.SQL_SCENES}) WHERE orbit = 7), g AS (SELECT d, date_diff('day', lag(d) OVER (ORDER BY d), d) AS g FROM d) SELECT count(*) AS days, median(g) AS median_gap, max(g)::INTEGER AS max_gap FROM g")
def footprint_days(spark, sf):
    return s.day_gaps(v.scenes(spark, sf).where("orbit = 7"), "start")


@query(f"""WITH a AS ({v.SQL_AIS}) SELECT count(*) AS reports, count(DISTINCT mmsi) AS vessels, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, round(quantile_cont(sog_kn, 0.25), 6) AS q25, round(median(sog_kn), 6) AS q50, round(quantile_cont(sog_kn, 0.75), 6) AS q75, round(count(*) FILTER (WHERE sog_kn > 1)::DOUBLE / count(sog_kn), 6) AS moving, (SELECT string_agg(msg_type || ' ' || n, ';' ORDER BY n DESC, msg_type) FROM (SELECT msg_type, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, msg_type LIMIT 12)) AS top_types FROM a""")
def stream_summary(spark, sf):
    a = v.ais(spark, sf)
    q = F.percentile("sog_kn", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = a.agg(F.count("*").alias("reports"), F.count_distinct("mmsi").alias("vessels"), F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last"), q.alias("q"), (F.count(F.when(F.col("sog_kn") > 1, 1)) / F.count("sog_kn")).alias("moving"))
    top = a.groupBy("msg_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "msg_type").limit(12)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), "msg_type", "n"))), lambda x: F.concat(x["msg_type"], F.lit(" "), x["n"].cast("string"))), ";")
    out = one.crossJoin(top.agg(text.alias("top_types")))  # single rows
    return out.select("reports", "vessels", "first", "last", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))), F.round("moving", 6).alias("moving"), "top_types")


@query(f"""SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY confidence), 6) AS share FROM (SELECT confidence, ais_status, count(*) AS n FROM ({v.SQL_OBJECTS}) GROUP BY ALL)""")
def identity_crosstab(spark, sf):
    from pyspark.sql import Window

    n = v.objects(spark, sf).groupBy("confidence", "ais_status").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("confidence")), 6))


@query(f"""SELECT floor((24.0 - wide_lat) / 0.25)::BIGINT AS row, floor((wide_lon - 99.0) / 0.25)::BIGINT AS col, sum(k % 5)::BIGINT AS ours, sum(k % 3)::BIGINT AS theirs, sum(least(k % 5, k % 3))::BIGINT AS pairs FROM ({v.SQL_LIGHTS}) GROUP BY ALL""")
def comparison_cells(spark, sf):
    """Comparison counts summed per coarse cell."""
    from pelagos.functions import geo

    k = F.col("k")
    return v.lights(spark, sf).groupBy(geo.corner_row(F.col("wide_lat")).alias("row"), geo.corner_col(F.col("wide_lon")).alias("col")).agg(F.sum(k % 5).alias("ours"), F.sum(k % 3).alias("theirs"), F.sum(F.least(k % 5, k % 3)).alias("pairs"))


_VEN = "SELECT p_partkey AS id, [(p_partkey % 90)::VARCHAR, 'x' || (p_partkey % 17)] AS issns, 'title ' || (p_partkey % 200) AS title FROM part"


def _venues(spark, sf):
    k = F.col("p_partkey")
    return v.table(spark, sf, "part").select(k.alias("id"), F.array((k % 90).cast("string"), F.concat(F.lit("x"), (k % 17).cast("string"))).alias("issns"), F.concat(F.lit("title "), (k % 200).cast("string")).alias("title"))


@query(f"""WITH s AS ({_VEN}) SELECT id, id % 13 = 0 OR list_has_any(issns, (SELECT list(DISTINCT (c_custkey % 8)::VARCHAR) FROM customer)) OR title IN (SELECT 'title ' || (s_suppkey % 40 + 150) FROM supplier) OR regexp_matches(title, '^title 1[0-2]$') AS covered FROM s""")
def covered_venues(spark, sf):
    """Venues already on the shortlist by id, ISSN, title or pattern."""
    x = _venues(spark, sf)
    ids = x.where("id % 13 = 0").select("id")
    issns = v.table(spark, sf, "customer").select((F.col("c_custkey") % 8).cast("string").alias("issn"))
    titles = v.table(spark, sf, "supplier").select(F.concat(F.lit("title "), (F.col("s_suppkey") % 40 + 150).cast("string")).alias("title"))
    return s.covered(x, ids, issns, titles, "^title 1[0-2]$").select("id", "covered")


@query(f"""WITH s AS ({_VEN}), t AS (SELECT c_custkey AS row_id, [(c_custkey % 45 * 7)::VARCHAR] AS issns, 'title ' || (c_custkey % 90) AS title FROM customer), i AS (SELECT a.id, min(b.row_id) AS r FROM (SELECT id, unnest(issns) AS x FROM s) a JOIN (SELECT row_id, unnest(issns) AS x FROM t) b USING (x) GROUP BY 1), m AS (SELECT title, min(row_id) AS r FROM t GROUP BY 1)
SELECT s.id, coalesce(i.r, m.r) AS row_id, CASE WHEN i.r IS NOT NULL THEN 'issn' WHEN m.r IS NOT NULL THEN 'title' ELSE 'none' END AS status FROM s LEFT JOIN i USING (id) LEFT JOIN m USING (title)""")
def venue_matches(spark, sf):
    """Rank rows of venues by any ISSN first, then by title."""
    t = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.array((F.col("c_custkey") % 45 * 7).cast("string")).alias("issns"), F.concat(F.lit("title "), (F.col("c_custkey") % 90).cast("string")).alias("title"))
    return s.match_by_issn_then_title(_venues(spark, sf), t)


@query("""WITH c AS (SELECT source AS name, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), f AS (SELECT *, substr(md5(name), 1, 1) IN ('0', '1', '2', '3', '4', '5') AS no_source FROM c), r AS (SELECT *, sum(CASE WHEN no_source THEN 0 ELSE 1 END) OVER (ORDER BY n DESC, name ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT name, n, no_source FROM r WHERE k < 6 OR (k = 6 AND NOT no_source)""")
def top_venues(spark, sf):
    """Venues by count until six real ones, those without a source flagged."""
    c = v.table(spark, sf, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    return s.top_venues(c, 6, "n", F.substring(F.md5("name"), 1, 1).isin(*"012345"))


@query(f"""WITH o AS ({v.SQL_OBJECTS}), p AS (SELECT det_id FROM o WHERE confidence = 'high' ORDER BY sha256('20261009:' || det_id), det_id LIMIT 40) SELECT det_id, det_id IN (SELECT det_id FROM p) AS chosen FROM o""")
def verification_sample(spark, sf):
    return s.seeded_mask(v.objects(spark, sf), "det_id", F.col("confidence") == "high", 40, 20261009).select("det_id", "chosen")


@query(f"""WITH o AS (SELECT det_id, scene_id, CASE WHEN confidence = 'low' THEN 'empty' ELSE 'labelled' END AS kind FROM ({v.SQL_OBJECTS})) SELECT det_id, scene_id, kind FROM o QUALIFY row_number() OVER (PARTITION BY scene_id, kind ORDER BY sha256('3:' || det_id), det_id) <= CASE kind WHEN 'labelled' THEN 12 ELSE 3 END""")
def capped_windows(spark, sf):
    o = v.objects(spark, sf).select("det_id", "scene_id", F.when(F.col("confidence") == "low", "empty").otherwise("labelled").alias("kind"))
    return s.capped_per_group(o, "scene_id", "det_id", {"labelled": 12, "empty": 3}, "kind", 3)


@query("""WITH g AS (SELECT c_mktsegment AS stratum, count(*) AS size FROM customer GROUP BY 1), e AS (SELECT *, 37 * size::DOUBLE / sum(size) OVER () AS e FROM g), f AS (SELECT *, floor(e)::BIGINT AS b, row_number() OVER (ORDER BY e - floor(e) DESC, stratum) AS r FROM e) SELECT stratum, size, b + CASE WHEN r <= 37 - sum(b) OVER () THEN 1 ELSE 0 END AS quota FROM f""")
def sample_quotas(spark, sf):
    """Thirty-seven scenes dealt out to strata by the largest remainder."""
    g = v.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count("*").alias("size"))
    return s.largest_remainder(g, 37, "stratum", "size")


@query(f"""WITH o AS ({v.SQL_OBJECTS}), r AS (SELECT 'K' || (o_orderkey * 3 % 2000) AS det_id, min(o_custkey) AS lead_rank FROM orders GROUP BY 1) SELECT o.det_id, row_number() OVER (ORDER BY CASE WHEN r.lead_rank IS NOT NULL THEN 0 WHEN ais_status = 'matched' THEN 1 ELSE 2 END, r.lead_rank NULLS LAST, epoch_us(acq) DESC, o.det_id) AS place FROM o LEFT JOIN r USING (det_id) QUALIFY place <= 200""")
def contact_order(spark, sf):
    """Contacts in the order a page keeps them: leads by rank, then matched, then the newest."""
    from pyspark.sql import Window

    r = v.table(spark, sf, "orders").groupBy(F.concat(F.lit("K"), (F.col("o_orderkey") * 3 % 2000).cast("string")).alias("det_id")).agg(F.min("o_custkey").alias("lead_rank"))
    o = v.objects(spark, sf).join(r, "det_id", "left")
    order = [F.when(F.col("lead_rank").isNotNull(), 0).when(F.col("ais_status") == "matched", 1).otherwise(2), F.asc_nulls_last("lead_rank"), F.desc("acq"), F.asc("det_id")]
    head = o.orderBy(*order).limit(200)
    return head.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("det_id", "place")  # the head alone
