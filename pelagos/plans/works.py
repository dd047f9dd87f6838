"""Queries on made-up works: themes, places, authors, venues, cells, ship types."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos.functions import works as w
from pelagos.plans.registry import query
from pelagos.sources import views as v

PHRASES = (
    "Ship detection in SAR images", "search and rescue SAR teams at sea", "blood vessel segmentation in MRI of patients", "dark vessels and AIS gaps", "Sentinel-1 monitoring of fishing vessels", "matching AIS with synthetic aperture radar", "xView3 challenge",
    "IUU fishing seen by satellites", "satellite tags on sharks and fishing effort", "small boat detection with radar", "artisanal fleets detected in imagery", "VIIRS boat detection at night", "night-time lights and economics", "the Hong Kong SAR ports",
    "research vessel cruises", "Vietnam East Sea", "the Mekong Delta", "Gulf of Thailand fisheries", "small target detection of ships", "squid lights and boats by day/night band", "SAR of a compound", "retinal vessel density and stroke", "pressure vessel", "non-broadcast ships", "classification of ships",
)
_TEXT = f"""w AS (SELECT doc_id AS id, p[doc_id % 25 + 1] || '. ' || p[doc_id * 7 // 3 % 25 + 1] || ' ' || p[doc_id * 11 // 5 % 25 + 1] AS t FROM documents, (SELECT [{', '.join("'" + p + "'" for p in PHRASES)}] AS p))"""


def _texts(spark, sf):
    p = F.array(*(F.lit(x) for x in PHRASES))
    at = lambda e: F.element_at(p, (F.expr(e) + 1).cast("int"))
    return v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(at("doc_id % 25"), F.lit(". "), at("doc_id * 7 div 3 % 25"), F.lit(" "), at("doc_id * 11 div 5 % 25")).alias("t"))


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _r(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', ' ', 'g')"


_MED = f"len(list_distinct(list_transform(regexp_extract_all(t, '{w.MEDICAL}'), lambda x: lower(x)))) >= 2"
_SAR = f"({_m('t', w.SAR_LONG)} OR {_m('t', w.SAR_STRONG)} OR ({_m('h', w.SAR_BARE)} AND NOT {_m('h', w.SAR_OTHER)} AND {_m('h', w.SENSING_CONTEXT)}))"
_LOOSE_SAR = f"({_m('t', w.SAR_LONG)} OR {_m('t', w.SAR_STRONG)} OR {_m('t', w.SAR_BARE)})"
_CRAFT = f"({_m('s', w.UNAMBIGUOUS_SHIP)} OR ({_m('s', w.VESSEL)} AND NOT med))"
_PREPARED = f"{_TEXT}, x AS (SELECT id, t, {_r('t', w.NONMARITIME_VESSEL)} AS s, {_r('t', w.SAR_REGION)} AS h, {_r('t', w.ANIMAL_TELEMETRY)} AS q, {_MED} AS med FROM w), y AS (SELECT *, {_SAR} AS sar, {_LOOSE_SAR} AS sar_loose, {_CRAFT} AS craft FROM x)"


@query(f"""WITH {_PREPARED} SELECT id, sar, craft, med, {_LOOSE_SAR} AS sar_loose FROM y""")
def work_terms(spark, sf):
    """Whether a text means radar, a craft, or the body."""
    t = F.col("t")
    return _texts(spark, sf).select("id", w.has_sar(t).alias("sar"), w.has_craft(t).alias("craft"), w.is_medical(t).alias("med"), w.has_sar(t, strict=False).alias("sar_loose"))


@query(f"""WITH {_PREPARED} SELECT id, craft AND {_m('t', w.DETECT)} AND sar AS sar_ship_detection, {_m('t', w.FUSE)} AND sar AND ({_m('t', w.AIS_LONG)} OR ({_m('t', w.AIS_SHORT)} AND {_m('s', w.SHIP_CONTEXT)})) AS sar_ais_fusion, {_m('t', w.XVIEW)} AS xview3,
{_m('t', w.IUU)} AND ({_m('t', w.IUU_STRONG)} OR {_m('s', w.VESSEL_CONTEXT)}) AND ({_m('q', w.SENSING_FISHING)} OR sar) AS iuu_remote_sensing,
(({_m('t', w.SMALL_CRAFT)} AND NOT (med AND NOT {_m('t', w.UNAMBIGUOUS_CRAFT)})) OR ({_m('t', w.SMALL_TARGET)} AND {_m('t', w.MARITIME_TERM)}) OR ({_m('t', w.ARTISANAL)} AND {_m('t', w.ARTISANAL_CONTEXT)})) AND {_m('t', w.DETECT_ONLY)} AND ({_m('t', w.SENSING_SMALL)} OR sar) AS small_vessel,
{_m('t', w.NIGHT_SENSOR)} AND (craft OR {_m('t', w.FISHING_PHRASE)}) AND ({_m('t', w.BAND_SENSOR)} OR ({_m('t', w.NIGHT_LIGHTS)} AND ({_m('t', w.BOAT_OR_FISHING)} OR {_m('t', w.MONITOR)}))) AND {_m('t', w.NIGHT_DATA)} AS viirs_boats,
{_m('t', w.DARK)} AND ({_m('t', w.MARITIME_STRONG)} OR {_m('t', w.VESSEL)}) AS dark_loose FROM y""")
def work_themes(spark, sf):
    """The themes in strict mode, and dark vessels in loose mode (its strict pattern looks ahead, which the SQL engine cannot)."""
    t = w.theme_tests(F.col("t"))
    return _texts(spark, sf).select("id", *(t[n].alias(n) for n in w.THEMES if n != "dark_vessels"), w.theme_tests(F.col("t"), strict=False)["dark_vessels"].alias("dark_loose"))


_PLACES = "list_filter([" + ", ".join(f"CASE WHEN {_m('t', p)} THEN '{n}' END" for n, p in w.PLACES.items()) + "], lambda x: x IS NOT NULL)"
_VN = "list_filter([" + ", ".join(f"CASE WHEN {_m('t', w.PLACES[n])} THEN '{n}' END" for n in w.VIETNAM_PLACES) + f", CASE WHEN {_m('t', w.DELTA)} THEN 'Mekong Delta' END], lambda x: x IS NOT NULL)"


@query(f"""WITH {_TEXT}, p AS (SELECT id, array_to_string({_PLACES}, ';') AS places, array_to_string({_VN}, ';') AS vietnam, CASE id % 6 WHEN 0 THEN 'VN' WHEN 1 THEN 'TH' ELSE 'FR' END AS cc FROM w) SELECT id, places, vietnam, places <> '' OR cc IN ('VN', 'TH') AS sea, vietnam <> '' OR cc = 'VN' AS vn FROM p""")
def work_places(spark, sf):
    t = F.col("t")
    cc = F.array(F.when(F.col("id") % 6 == 0, "VN").when(F.col("id") % 6 == 1, "TH").otherwise("FR"))
    sea, vn = w.place_flags(t, cc)
    return _texts(spark, sf).select("id", F.array_join(w.places_of(t), ";").alias("places"), F.array_join(w.vietnam_places(t), ";").alias("vietnam"), sea.alias("sea"), vn.alias("vn"))


_NAMES = ("Nguyen Van An", "An N.", "Maria Garcia-Lopez", "J. Garcia", None, "Le")
_DOIS = ("https://doi.org/10.48550/arXiv.1", "10.1109/x", None, "doi:10.2139/ssrn.5", "10.5281/zenodo.9")
_N = lambda k: v._sql_pick(k, 6, *_NAMES)
_BARE = "nullif(regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', ''), '')"
_TOK = lambda c: f"list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) >= 3))"


@query(f"""WITH a AS (SELECT o_orderkey AS k, {_N('o_orderkey')} AS a, {_N('(o_orderkey // 6)')} AS b, {v._sql_pick('o_orderkey', 5, *_DOIS)} AS doi, CASE WHEN o_orderkey % 4 = 0 THEN 'preprint' ELSE 'article' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'Sea' END AS venue, CASE WHEN o_orderkey % 7 = 0 THEN 'repository' END AS st FROM orders),
t AS (SELECT *, {_TOK('a')} AS x, {_TOK('b')} AS y, {_BARE} AS bare FROM a), p AS (SELECT *, kind = 'preprint' OR {' OR '.join(f"starts_with(coalesce(bare, ''), '{d}')" for d in w.PREPRINT_DOIS)} AS pre, bare IS NULL AND venue IS NULL AS weak FROM t)
SELECT k, list_has_any(x, y) AS agree, len(x) = 0 OR len(y) = 0 OR list_has_any(x, y) AS same, bare AS doi, pre AS preprint, weak, pre OR coalesce(st = 'repository', false) OR weak AS secondary FROM p""")
def work_records(spark, sf):
    """First authors that agree, preprints, weak and secondary records."""
    k = F.col("o_orderkey")
    x = v.table(spark, sf, "orders").withColumn("k6", F.expr("o_orderkey div 6")).select(k.alias("k"), v._pick("o_orderkey", 6, *_NAMES).alias("a"), v._pick("k6", 6, *_NAMES).alias("b"), v._pick("o_orderkey", 5, *_DOIS).alias("doi"), F.when(k % 4 == 0, "preprint").otherwise("article").alias("kind"), F.when(k % 3 == 0, "Sea").alias("venue"), F.when(k % 7 == 0, "repository").alias("st"))
    c = F.col
    from pelagos.functions.scalars import normalise_doi

    return x.select("k", w.authors_agree(c("a"), c("b")).alias("agree"), w.same_first_author(c("a"), c("b")).alias("same"), normalise_doi(c("doi")).alias("doi"), w.is_preprint(c("kind"), c("doi")).alias("preprint"), w.is_weak(c("doi"), c("venue")).alias("weak"), w.is_secondary(c("kind"), c("doi"), c("venue"), c("st")).alias("secondary"))


_RAWS = ("http://x.y/z", "Proceedings of the 12th Radar Conference 2019", "IGARSS 2020 - Symposium on the Sea", None, "Sea", "ab", "Marine Policy", "The Proceedings of the First Workshop, 2021")
_KINDS = ("conference", "journal", "repository", "", None, "book series", "dataset")


@query(f"""WITH a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'Primary ' || (p_partkey % 9) END AS source, CASE WHEN p_partkey % 3 = 0 THEN 'journal' ELSE 'repository' END AS lk, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Loc ' || (p_partkey % 7) END AS ln, {v._sql_pick('p_partkey', 8, *_RAWS)} AS raw, {v._sql_pick('p_partkey', 5, '10.48550/arXiv.1', '10.5281/zenodo.7', None, '10.1109/x')} AS doi, {v._sql_pick('(p_partkey // 8)', 7, *_KINDS)} AS kind FROM part),
c AS (SELECT *, CASE WHEN NOT regexp_matches(trim(coalesce(raw, '')), '(?i)^(?:https?://|www\\.)') AND len(trim(coalesce(raw, ''))) >= 3 THEN trim(raw) END AS clean, CASE {' '.join(f"WHEN starts_with(lower(doi), '{d}') THEN '{n}'" for d, n in w.REPOSITORY_DOIS)} END AS dv FROM a),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw), '{w.LEAD_ACRONYM}', ''), '{w.PROCEEDINGS}', ''), '{w.YEAR}', ' ', 'g'), '{w.ORDINAL}', ' ', 'g'), '\\s+', ' ', 'g'), '^[ \\-,:;.]+|[ \\-,:;.]+$', '', 'g') AS short FROM c)
SELECT k, CASE WHEN source IS NOT NULL THEN source WHEN lk = 'journal' AND ln <> '' THEN ln WHEN clean IS NOT NULL THEN clean WHEN dv IS NOT NULL THEN dv WHEN ln <> '' THEN ln ELSE '' END AS venue, CASE WHEN source IS NOT NULL THEN 'primary_source' WHEN lk = 'journal' AND ln <> '' THEN 'other_location' WHEN clean IS NOT NULL THEN 'raw_name' WHEN dv IS NOT NULL THEN 'doi_prefix' WHEN ln <> '' THEN 'any_location' ELSE 'unattributed' END AS method,
CASE WHEN coalesce(raw, '') = '' THEN '' WHEN (kind NOT IN ('conference', '') AND NOT regexp_matches(raw, '{w.CONFERENCE}')) OR short = '' THEN raw ELSE short END AS series,
CASE WHEN kind IN ('conference', 'repository') THEN kind WHEN kind IN ('journal', 'book series', 'ebook platform') THEN CASE WHEN regexp_matches(coalesce(raw, ''), '{w.CONFERENCE}') THEN 'conference' ELSE 'journal' END WHEN coalesce(kind, '') <> '' THEN 'other' ELSE 'unattributed' END AS grp FROM n""")
def work_venues(spark, sf):
    """A venue by the ordered fallbacks, a series' name and a venue's group."""
    k = F.col("p_partkey")
    x = v.table(spark, sf, "part").withColumn("k8", F.expr("p_partkey div 8")).select(k.alias("k"), F.when(k % 5 == 0, F.concat(F.lit("Primary "), (k % 9).cast("string"))).alias("source"), F.array(F.struct(F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Loc "), (k % 7).cast("string"))).alias("name"), F.when(k % 3 == 0, "journal").otherwise("repository").alias("kind"))).alias("locations"), v._pick("p_partkey", 8, *_RAWS).alias("raw"), v._pick("p_partkey", 5, "10.48550/arXiv.1", "10.5281/zenodo.7", None, "10.1109/x").alias("doi"), v._pick("k8", 7, *_KINDS).alias("kind"))
    c = F.col
    r = w.resolve_venue(c("source"), c("locations"), c("raw"), c("doi"))
    return x.select("k", r["venue"].alias("venue"), r["method"].alias("method"), w.series_name(c("raw"), c("kind")).alias("series"), w.venue_group(c("kind"), c("raw")).alias("grp"))


@query("""WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'fee ' || (o_orderkey % 9) WHEN o_orderkey % 4 = 1 THEN 'fee | list | more' ELSE 'unknown | [UNVERIFIED]' END AS cell, CASE WHEN o_orderkey % 3 = 0 THEN 'UNVERIFIED' ELSE 'House' END AS pub FROM orders), s AS (SELECT *, CASE WHEN contains(cell, ' | ') THEN trim(substr(cell, 1, strpos(cell, ' | ') - 1)) ELSE cell END AS value, CASE WHEN contains(cell, ' | ') THEN trim(substr(cell, strpos(cell, ' | ') + 3)) ELSE '' END AS prov FROM a)
SELECT k, value, prov, CASE WHEN prov <> '' THEN value || ' | ' || prov ELSE value END AS joined, CASE WHEN NOT regexp_matches(cell, 'UNVERIFIED|unknown') AND pub <> 'UNVERIFIED' THEN 'VERIFIED' WHEN pub <> 'UNVERIFIED' THEN 'PARTIAL' ELSE 'UNVERIFIED' END AS status FROM s""")
def sheet_cells(spark, sf):
    k = F.col("o_orderkey")
    x = v.table(spark, sf, "orders").select(k.alias("k"), F.when(k % 4 == 0, F.concat(F.lit("fee "), (k % 9).cast("string"))).when(k % 4 == 1, "fee | list | more").otherwise("unknown | [UNVERIFIED]").alias("cell"), F.when(k % 3 == 0, "UNVERIFIED").otherwise("House").alias("pub"))
    value, prov = w.split_cell(F.col("cell"))
    return x.select("k", value.alias("value"), prov.alias("prov"), w.join_cell(value, prov).alias("joined"), w.cell_status([F.col("cell"), F.col("pub")], F.col("pub")).alias("status"))


@query(f"""SELECT l_orderkey * 8 + l_linenumber AS k, CASE {' '.join(f"WHEN l_partkey % 130 = {n} THEN '{t}'" for n, t in w.SHIP_TYPES.items())} {' '.join(f"WHEN l_partkey % 130 // 10 = {n} THEN '{t}'" for n, t in w.SHIP_TENS.items())} WHEN l_partkey % 130 BETWEEN 1 AND 99 THEN 'reserved' END AS label,
CASE WHEN l_suppkey % 600 + l_partkey % 500 BETWEEN 1 AND 1022 THEN (l_suppkey % 600 + l_partkey % 500)::DOUBLE END AS length_m, CASE WHEN l_suppkey % 70 + l_partkey % 80 BETWEEN 1 AND 126 THEN (l_suppkey % 70 + l_partkey % 80)::DOUBLE END AS width_m,
CASE WHEN l_partkey % 14 BETWEEN 1 AND 12 AND l_suppkey % 33 BETWEEN 1 AND 31 THEN lpad((l_partkey % 14)::VARCHAR, 2, '0') || '-' || lpad((l_suppkey % 33)::VARCHAR, 2, '0') || ' ' || lpad(least(l_partkey % 26, 24)::VARCHAR, 2, '0') || ':' || lpad(least(l_suppkey % 63, 60)::VARCHAR, 2, '0') END AS eta FROM lineitem""")
def static_fields(spark, sf):
    """Ship type labels, dimensions and arrival times of static messages."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    d = lambda x, n: (x % n).cast("double")
    length, width = w.dimensions(d(s, 600), d(p, 500), d(s, 70), d(p, 80))
    return v.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), w.ship_type_label(p % 130).alias("label"), length.alias("length_m"), width.alias("width_m"), w.eta_text(p % 14, s % 33, p % 26, s % 63).alias("eta"))


@query("""WITH a AS (SELECT event_id, event_id % 91 AS a, event_id % 181 AS b, event_id % 4 AS form FROM events) SELECT event_id, round(CASE form WHEN 0 THEN b WHEN 1 THEN -b WHEN 2 THEN b ELSE a + 0.5 END, 6) AS lon, round(CASE form WHEN 0 THEN a WHEN 1 THEN -a WHEN 2 THEN a ELSE -(a + 0.25) END, 6) AS lat FROM a""")
def coordinate_texts(spark, sf):
    """Coordinates in four ways of writing."""
    e = v.table(spark, sf, "events")
    a, b, form = (F.col("event_id") % 91).cast("string"), (F.col("event_id") % 181).cast("string"), F.col("event_id") % 4
    text = F.when(form == 0, F.concat(a, F.lit(", "), b)).when(form == 1, F.concat(a, F.lit("S "), b, F.lit("W"))).when(form == 2, F.concat(b, F.lit(" E, "), a, F.lit(" N"))).otherwise(F.concat(a, F.lit("° 15' S "), a, F.lit("° 30' E")))
    at = w.coordinates(text)
    return e.select("event_id", F.round(at["lon"], 6).alias("lon"), F.round(at["lat"], 6).alias("lat"))
