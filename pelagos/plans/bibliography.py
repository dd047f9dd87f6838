"""Queries on works: keys, themes, entity resolution, rankings, screening."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pelagos.functions import scalars
from pelagos.operators import dedupe, passages
from pelagos.plans.registry import query
from pelagos.sources import views as v

# Words of the tables' invented prose that stand in for themes here; the real themes are in pelagos.functions.works.
WORDS = {"detection": "the|detect", "night": "night|light|und", "sea": "sea|mer|la", "vessel": "ship|vessel|que"}
#: A whole word, whatever letters stand beside it.
THEMES = {name: rf"(?:^|[^\p{{L}}])(?:{words})(?:[^\p{{L}}]|$)" for name, words in WORDS.items()}


def has_word(text, name: str):
    """Whether the lower-cased text has a word of the theme; the pattern runs only where one stands in it at all."""
    found = F.lit(False)
    for word in WORDS[name].split("|"):
        found = found | text.contains(word)
    return found & text.rlike(THEMES[name])


@query(r"""SELECT doc_id AS id, trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '<[^>]*>', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS title_key, len(regexp_extract_all(text, '[A-Za-z]+')) AS words FROM documents""")
def normalise_text_keys(spark, sf):
    w = v.works(spark, sf)
    return w.select("id", scalars.normalise_title(F.col("title")).alias("title_key"), F.regexp_count("abstract", F.lit("[A-Za-z]+")).cast("long").alias("words"))


@query("SELECT doc_id AS id, " + ", ".join(f"regexp_matches(lower(text), '{p}') AS {n}" for n, p in THEMES.items()) + " FROM documents")
def theme_flags(spark, sf):
    w = v.works(spark, sf)
    return w.select("id", *(has_word(F.lower("abstract"), n).alias(n) for n in WORDS))


_T = "t AS (SELECT doc_id AS id, doc_id % 12 + 2015 AS year, source AS venue, lang, k.theme AS theme FROM documents, (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in THEMES.items()) + ") k(theme, p) WHERE regexp_matches(lower(text), k.p))"


def _themed(spark, sf):
    w = v.works(spark, sf)
    w = w.withColumn("_low", F.lower("abstract"))
    hit = F.array_compact(F.array(*(F.when(has_word(F.col("_low"), n), F.lit(n)) for n in WORDS)))
    return w.select("id", "year", "venue", "lang", hit.alias("themes"))


@query(f"WITH {_T}, y AS (SELECT unnest(generate_series(2015, 2026)) AS year) SELECT y.year, " + ", ".join(f"count(*) FILTER (WHERE theme = '{n}') AS {n}" for n in THEMES) + " FROM y LEFT JOIN t USING (year) GROUP BY y.year")
def theme_by_year(spark, sf):
    t = _themed(spark, sf).withColumn("theme", F.explode("themes"))
    n = t.groupBy("year").agg(*(F.count(F.when(F.col("theme") == x, 1)).alias(x) for x in THEMES))
    years = spark.range(2015, 2027).withColumnRenamed("id", "year")
    return years.join(n, "year", "left").na.fill(0)


@query(f"""WITH {_T}, n AS (SELECT source AS venue, count(*) AS n, min(doc_id % 12 + 2015) AS first_year, max(doc_id % 12 + 2015) AS last_year FROM documents GROUP BY 1), c AS (SELECT venue, theme, count(*) AS k FROM t GROUP BY ALL), m AS (SELECT venue, arg_min(theme, struct_pack(a := -k, b := theme)) AS top_theme FROM c GROUP BY venue)
SELECT n.venue, n.n, n.first_year, n.last_year, m.top_theme, row_number() OVER (ORDER BY n.n DESC, n.venue) AS rank, round(100 * n.n::DOUBLE / sum(n.n) OVER (), 2) AS percent FROM n LEFT JOIN m USING (venue)""")
def venue_rank(spark, sf):
    w = _themed(spark, sf)
    n = w.groupBy("venue").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    c = w.withColumn("theme", F.explode("themes")).groupBy("venue", "theme").agg(F.count("*").alias("k"))
    m = c.groupBy("venue").agg(F.min_by("theme", F.struct(-F.col("k"), F.col("theme"))).alias("top_theme"))
    total = n.agg(F.sum("n").alias("total"))
    ranked = n.join(m, "venue", "left").crossJoin(F.broadcast(total))  # one row on the right
    # A row per venue: the report is ordered as a whole.
    return ranked.select("venue", "n", "first_year", "last_year", "top_theme", F.row_number().over(Window.orderBy(F.desc("n"), "venue")).cast("long").alias("rank"), F.round(100 * F.col("n") / F.col("total"), 2).alias("percent"))


@query(r"""WITH k AS (SELECT doc_id AS id, trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '<[^>]*>', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS t, md5(coalesce(text, '')) AS h, len(text) AS n FROM documents),
g AS (SELECT id, min(id) OVER (PARTITION BY h) AS a FROM k)
SELECT id, a AS survivor, CASE WHEN count(*) OVER (PARTITION BY a) > 1 THEN 'same text' END AS reason FROM g""")
def dedupe_exact_text(spark, sf):
    w = v.works(spark, sf)
    return dedupe.resolve(w.select("id", "abstract"), "id", [("same text", F.md5(F.coalesce("abstract", F.lit(""))))], [F.col("id")]).select("id", "survivor", "reason")


_TITLE = "trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '<[^>]*>', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH RECURSIVE w AS (SELECT doc_id AS id, doc_id % 12 + 2015 AS year, len(text) AS n, md5(text) AS h, {_TITLE} AS t FROM documents), k AS (SELECT id, 0 AS p, h AS key FROM w WHERE h IS NOT NULL UNION ALL SELECT id, 1, t || '|' || year FROM w WHERE len(t) >= 25 UNION ALL SELECT id, 2, t FROM w WHERE len(t) >= 40),
f AS (SELECT p, key, min(id) AS first, count(*) AS n FROM k GROUP BY ALL HAVING count(*) > 1), e AS (SELECT k.id, f.first, k.p FROM k JOIN f USING (p, key)), s AS (SELECT DISTINCT id AS a, first AS b FROM e WHERE id <> first UNION SELECT DISTINCT first, id FROM e WHERE id <> first),
r(id, root) AS (SELECT id, id FROM w UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.id), c AS (SELECT id, min(root) AS root FROM r GROUP BY id), b AS (SELECT root, arg_min(w.id, struct_pack(y := year, n := n, i := w.id)) AS survivor FROM c JOIN w USING (id) GROUP BY root),
y AS (SELECT id, min(p) AS p FROM e GROUP BY id) SELECT c.id, b.survivor, CASE y.p WHEN 0 THEN 'same text' WHEN 1 THEN 'title and year' WHEN 2 THEN 'title' END AS reason FROM c JOIN b USING (root) LEFT JOIN y USING (id)""")
def dedupe_works(spark, sf):
    """Ordered passes: same text, same title and year, same long title."""
    w = v.works(spark, sf)
    title = scalars.normalise_title(F.col("title"))
    passes = [("same text", F.md5("abstract")), ("title and year", F.when(F.length(title) >= 25, scalars.title_year_key(F.col("title"), F.col("year")))), ("title", F.when(F.length(title) >= 40, title))]
    return dedupe.resolve(w, "id", passes, [F.col("year"), F.length("abstract")]).select("id", "survivor", "reason")


@query("""WITH p AS (SELECT p_partkey, lpad((p_partkey * 7919 % 10000000)::VARCHAR, 7, '0') AS d FROM part), c AS (SELECT *, (11 - (substr(d, 1, 1)::INT * 8 + substr(d, 2, 1)::INT * 7 + substr(d, 3, 1)::INT * 6 + substr(d, 4, 1)::INT * 5 + substr(d, 5, 1)::INT * 4 + substr(d, 6, 1)::INT * 3 + substr(d, 7, 1)::INT * 2) % 11) % 11 AS x FROM p)
SELECT p_partkey, substr(d, 1, 4) || '-' || substr(d, 5, 3) || CASE WHEN x = 10 THEN 'X' ELSE x::VARCHAR END AS issn FROM c""")
def issn_check(spark, sf):
    d = F.lpad((F.col("p_partkey") * 7919 % 10000000).cast("string"), 7, "0")
    p = v.table(spark, sf, "part").select("p_partkey", d.alias("d"))
    return p.select("p_partkey", F.concat(F.substring("d", 1, 4), F.lit("-"), F.substring("d", 5, 3), scalars.issn_check_digit(F.col("d"))).alias("issn"))


@query("""WITH l AS (SELECT d.source, d.lang, d.doc_id, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)), o AS (SELECT source, lang, min(doc_id) AS first FROM l GROUP BY ALL)
SELECT source, string_agg(lang, ';' ORDER BY first, lang) AS langs, (SELECT count(*) FROM l WHERE l.source IS NOT DISTINCT FROM o.source AND toxic = 1) AS toxic FROM o GROUP BY source""")
def array_rollup_union(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", "source", "lang").join(v.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    o = d.groupBy("source", "lang").agg(F.min("doc_id").alias("first"), F.count(F.when(F.col("toxic") == 1, 1)).alias("t"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("first", "lang"))), lambda x: x["lang"])
    return o.groupBy("source").agg(F.array_join(order, ";").alias("langs"), F.sum("t").alias("toxic"))


@query("""WITH h AS (SELECT doc_id, lang, sha256('42:precision:' || doc_id) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS r FROM h) SELECT lang, doc_id, r FROM r WHERE r <= 25""")
def hash_sample(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", "lang", F.sha2(F.concat(F.lit("42:precision:"), F.col("doc_id").cast("string")), 256).alias("h"))
    r = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return d.withColumn("r", r.cast("long")).where("r <= 25").select("lang", "doc_id", "r")


@query("""SELECT lang, count(*) AS n, count(text) AS with_text, sum(len(text))::BIGINT AS chars, count(DISTINCT source) AS sources, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY lang""")
def corpus_summary(spark, sf):
    return v.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.sum(F.length("text")).alias("chars"), F.count_distinct("source").alias("sources"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("""WITH p AS (SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)) SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM p GROUP BY item_id""")
def anchor_passages(spark, sf):
    """Documents that hold a benchmark passage word for word."""
    hit = passages.containing(v.table(spark, sf, "documents"), v.table(spark, sf, "benchmark"))
    return hit.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
