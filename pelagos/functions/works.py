"""Column expressions on works: themes and places of a text, names, venues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pelagos.functions.scalars import normalise_doi, normalise_title

# The patterns of themes, terms and places.
SHIP = r"(?i)\b(?:ships?|vessels?|boats?)\b"
VESSEL = r"(?i)\bvessels?\b"
DETECT = r"(?i)\b(?:detect|recogni[sz]|classif|segment)\w*"
DETECT_ONLY = r"(?i)\bdetect\w*"
NONMARITIME_VESSEL = (
    r"(?i)\b(?:blood|lymph\w*|vascular|coronary|cerebral|retinal|cardiac|pulmonary|renal|arterial|venous|capillary|microvascular|pressure|reaction|reactor|xylem|tumou?r|brain|hepatic|cardiovascular)[\s-]+vessels?\b"
    r"|\bvessels?[\s-]+(?:wall|walls|segmentation|occlusion|extraction|tree|diameter|tortuosity|density|lumen|stenosis|bifurcation|branching)\b"
    r"|\b(?:research|oceanographic|survey|scientific|training)\s+(?:vessels?|ships?)\b|\bship-?(?:board|borne|based)\b|\bshipboard\b"
)
MEDICAL = (
    r"(?i)\b(?:blood|vascular|mri|magnetic resonance|angiogra\w*|arter\w*|vein|veins|cerebr\w*|retina|retinal|tumou?r|endotheli\w*|aneurysm|stroke|patients?|lymph\w*|capillar\w*|thromb\w*|clinical|histolog\w*|ultrasound|tomograph\w*)\b"
)
UNAMBIGUOUS_SHIP = r"(?i)\b(?:ships?|boats?)\b"
UNAMBIGUOUS_CRAFT = r"(?i)\b(?:ships?|boats?|fishing)\b"
SENSING_CONTEXT = (
    r"(?i)\b(?:radars?|satellites?|spaceborne|airborne|backscatter\w*|polarimetr\w*|interferometr\w*|microwave|sentinel|imagery|remote[\s-]*sens\w*|oceans?|maritime|marine|seas?|offshore|coastal|ships?|boats?|fishing)\b"
)
FISHING_PHRASE = (
    r"(?i)\bfishing[\s-]+(?:vessels?|boats?|fleets?|lights?|lamps?|grounds?|zones?|effort|activit(?:y|ies)|operations?|areas?|pressure|traffic|ships?)\b|\bfishing\s+(?:with|using)\s+lights?\b"
)
SAR_LONG = r"(?i)synthetic[\s-]+aperture[\s-]+radars?|\bsentinel[\s-]*1[a-d]?\b|\bradarsat\w*|\bterrasar\w*|\bcosmo[\s-]*sky[\s-]*med\b|\bgaofen[\s-]*3\b|\bgf[\s-]*3\b|\biceye\b|\bcapella\b"
SAR_STRONG = r"(?i)(?-i:\bSAR)[\s-]+(?:images?|imagery|imaging|data|datasets?|scenes?|sensors?|satellites?|chips?|patch(?:es)?|backscatter|amplitude|intensity|echoes?|acquisitions?|signatures?|products?)\b"
SAR_BARE = r"\bSAR\b"
SAR_REGION = r"(?i)\b(?:hong[\s-]+kong|macao|macau)[\s,(-]*(?:special[\s-]+administrative[\s-]+region)?[\s,(-]*SAR\)?"
SAR_OTHER = r"(?i)search[\s-]*(?:and|&|/)[\s-]*rescue|\brescue\b|specific[\s-]+absorption[\s-]+rate|structure[\s-]*(?:activity|affinity)|special[\s-]+administrative[\s-]+region"
AIS_SHORT = r"\bAIS\b"
AIS_LONG = r"(?i)automatic[\s-]+identification[\s-]+systems?"
FUSE = r"(?i)\b(?:fusion|fus(?:e|ed|es|ing)|match|correlat|associat|integrat|combin)\w*"
DARK_REST = (
    r"|(?-i:\bAIS)[\s-]+(?:gaps?|disabl\w+|dark\w*|silen\w+|outages?|(?:switch|turn|shut)\w*[\s-]+off)\b|\bgaps?\s+in\s+(?:the\s+)?(?:(?-i:AIS)|automatic[\s-]+identification[\s-]+systems?)\b"
    r"|\b(?:go|goes|going|gone|went)\s+dark\b|\b(?:disabl\w+|(?:switch|turn|shut)\w*\s+(?:off|down))\s+(?:\w+\s+){0,3}?(?:(?-i:AIS)|automatic[\s-]+identification[\s-]+systems?)\b|(?-i:\bAIS)\s+(?:\w+\s+){0,2}?(?:disabled|(?:switched|turned|shut)\s+off)\b"
)
DARK = r"(?i)\bdark[\s-]+(?:vessels?|ships?|fleets?|fishing|boats?|targets?|shipping|trawlers?|activit(?:y|ies)|maritime)\b|\bnon[\s-]?broadcast\w*" + DARK_REST
DARK_STRICT = (
    r"(?i)\bdark[\s-]+(?:vessels?|ships?|fleets?|boats?|shipping|trawlers?)\b|\bdark[\s-]+fishing\b(?![\s-]+spiders?)"
    r"|\bnon[\s-]?broadcast\w*(?![\s-]+(?:films?|videos?|tv|television|radio|media|spray\w*|applications?))" + DARK_REST
)
MARITIME_STRONG = r"(?i)\b(?:ships?|boats?|fishing|fisher(?:y|ies|men|man)|maritime|shipping|automatic[\s-]+identification[\s-]+systems?)\b|(?-i:\bAIS\b)"
MARITIME_CONTEXT = (
    r"(?i)\b(?:ships?|boats?|fishing|fisher(?:y|ies|men|man)|maritime|marine|oceans?|seas?|offshore|coastal|shipping|trawl\w*|fleets?|ports?|satellites?|radar|SAR|sentinel|tankers?|cargo|sanctions?|automatic[\s-]+identification[\s-]+systems?)\b"
)
SHIP_CONTEXT = r"(?i)\b(?:ships?|vessels?|boats?|maritime|shipping|fishing|ports?|fleets?|trawlers?|tankers?)\b"
XVIEW = r"(?i)\bxview[\s-]*3"
ILLEGAL = r"(?-i:\bIUU\b)|\billegal(?:ly)?[\s,]+(?:and[\s,]+)?(?:unreported[\s,]+(?:and[\s,]+)?(?:unregulated[\s,]+)?)?fishing\b|\bunreported[\s,]+(?:and[\s,]+)?unregulated\b"
IUU = r"(?i)" + ILLEGAL + r"|\bfishing[\s-]+(?:effort|activit(?:y|ies)|vessels?|boats?|fleets?)\b"
IUU_STRONG = r"(?i)" + ILLEGAL + r"|\bfishing[\s-]+(?:vessels?|boats?|fleets?)\b"
VESSEL_CONTEXT = r"(?i)\b(?:vessels?|ships?|boats?|fleets?|AIS|VMS|trawlers?|surveillance|patrol)\b|automatic[\s-]+identification"
SENSING_FISHING = r"(?i)\bsatellites?\b|remote[\s-]*sens\w*|\bVIIRS\b|\bsentinel\b|\bimagery\b|night[\s-]*(?:time[\s-]*)?lights?\b"
ANIMAL_TELEMETRY = (
    r"(?i)\bpop-?up\s+satellite\b|\bsatellite[\s-]+(?:tags?|tagged|tagging|telemetry|transmitters?|collars?|linked)\b"
    r"|\bsatellite[\s-]+tracking\s+of\s+(?:\w+\s+){1,3}(?:sharks?|turtles?|whales?|seals?|seabirds?|birds?|penguins?|tuna|rays?)\b"
)
SMALL_CRAFT = r"(?i)\bsmall(?:[\s-]*(?:sized?|scale))?[\s-]+(?:vessels?|boats?|ships?|fishing)\b|\bsmall[\s-]*scale[\s-]+fish\w*"
SMALL_TARGET = r"(?i)\bsmall(?:[\s-]*sized?)?[\s-]+(?:\w+[\s-]+)?targets?\b"
MARITIME_TERM = r"(?i)\b(?:ships?|vessels?|boats?|maritime|fishing)\b"
ARTISANAL = r"(?i)\bartisanal\b"
ARTISANAL_CONTEXT = r"(?i)\b(?:fish\w*|vessels?|boats?|canoes?|fleets?|ships?|marine|coastal|pirogues?)\b"
SENSING_SMALL = r"(?i)\bsatellites?\b|remote[\s-]*sens\w*|\bimagery\b|\bradars?\b"
NIGHT_SENSOR = r"(?i)\bVIIRS\b|visible[\s-]+infrared[\s-]+imaging[\s-]+radiometer|day[\s/-]*night[\s-]+band|night[\s-]*(?:time[\s-]*)?lights?\b|low[\s-]+light[\s-]+imaging"
NIGHT_CRAFT = r"(?i)\b(?:boats?|fishing|vessels?|ships?)\b"
NIGHT_DATA = r"(?i)night|nocturnal|day[\s/-]*night|\bDNB\b|low[\s-]*light|\bVBD\b|boat detection|\b(?:fishing|LED|squid|jigging|attracting)\s+lights?\b|\blight[\s-]+(?:fishing|attracting)|(?-i:\bAIS\b|\bVMS\b)|V-?Pass|vessel\s+monitoring"
BAND_SENSOR = r"(?i)\bVIIRS\b|visible[\s-]+infrared[\s-]+imaging[\s-]+radiometer|day[\s/-]*night[\s-]+band|\bDNB\b"
NIGHT_LIGHTS = r"(?i)night[\s-]*(?:time[\s-]*)?lights?\b"
MONITOR = r"(?i)\b(?:detect|identif|recogni[sz]|classif|extract|monitor)\w*"
BOAT_OR_FISHING = r"(?i)\b(?:boats?)\b|\bfishing[\s-]+(?:vessels?|boats?|fleets?|lights?|lamps?)\b"
PLACES = {
    "Vietnam": r"(?i)\bviet[\s-]?nam\w*", "Tonkin": r"(?i)\btonkin\b", "Mekong": r"(?i)\bmekong\b", "Ca Mau": r"(?i)\bca[\s-]+mau\b", "Gulf of Thailand": r"(?i)\bgulf\s+of\s+thailand\b", "South China Sea": r"(?i)\bsouth\s+china\s+sea\b",
    "Spratly": r"(?i)\bspratlys?\b", "Paracel": r"(?i)\bparacels?\b", "Malacca": r"(?i)\bmalacca\b", "Sulu": r"(?i)\bsulu\b", "Celebes": r"(?i)\bcelebes\b", "Java Sea": r"(?i)\bjava\s+sea\b", "Andaman": r"(?i)\bandaman\b", "Indonesia": r"(?i)\bindonesia\w*",
    "Philippines": r"(?i)\bphilippin\w*|\bfilipino\b", "Malaysia": r"(?i)\bmalaysia\w*", "Thailand": r"(?i)\bthailand\b|\bthai\b", "Cambodia": r"(?i)\bcambodia\w*", "Myanmar": r"(?i)\bmyanmar\b", "Brunei": r"(?i)\bbrunei\b", "Singapore": r"(?i)\bsingapore\b",
    "Timor-Leste": r"(?i)\btimor[\s-]*leste\b|\beast\s+timor\b", "East Sea (Vietnam)": r"(?i)\b(?:vietnam\w*|viet\s+nam)[\s'’s]*east\s+sea\b|\beast\s+sea\s+of\s+vietnam\b",
}
VIETNAM_PLACES, DELTA = ("Vietnam", "Tonkin", "Ca Mau", "East Sea (Vietnam)"), r"(?i)\bmekong\s+delta\b"
COUNTRIES = ("VN", "TH", "MY", "ID", "PH", "SG", "KH", "LA", "MM", "BN", "TL")
PREPRINT_DOIS = ("10.48550/arxiv", "10.1101/", "10.20944/preprints", "10.31219/osf.io", "10.36227/techrxiv", "10.22541/", "10.21203/rs.", "10.2139/ssrn", "10.31223/", "10.31234/", "10.32920/")
REPOSITORY_DOIS = (("10.36227/techrxiv", "TechRxiv"), ("10.13140/rg", "ResearchGate"), ("10.48550/arxiv", "arXiv"), ("10.2139/ssrn", "SSRN"), ("10.20944/preprints", "Preprints.org"), ("10.21203/rs", "Research Square"), ("10.5281/zenodo", "Zenodo"), ("10.6084/m9.figshare", "Figshare"))
CONFERENCE = r"(?i)\bconference\s+(?:proceedings|series)\b|^proceedings\b"
LEAD_ACRONYM, PROCEEDINGS, YEAR = r"^[A-Za-z0-9/\-]{2,20}\s*(?:19|20)\d{2}\s*-\s*", r"(?i)^(?:the\s+)?proceedings\s+of\s+(?:the\s+)?", r"\b(?:19|20)\d{2}\b"
ORDINAL = r"(?i)\b\d+(?:st|nd|rd|th)\b|\b(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\b"
SHIP_TYPES = {
    30: "fishing", 31: "towing", 32: "towing, long or wide", 33: "dredging or underwater ops", 34: "diving ops", 35: "military ops", 36: "sailing", 37: "pleasure craft", 50: "pilot vessel", 51: "search and rescue", 52: "tug", 53: "port tender",
    54: "anti-pollution", 55: "law enforcement", 56: "spare, local", 57: "spare, local", 58: "medical transport", 59: "noncombatant ship",
}
SHIP_TENS = {2: "wing in ground", 4: "high speed craft", 6: "passenger", 7: "cargo", 8: "tanker", 9: "other"}
THEMES = ("sar_ship_detection", "dark_vessels", "sar_ais_fusion", "xview3", "iuu_remote_sensing", "small_vessel", "viirs_boats")


def strip_nonmaritime(text: Column) -> Column:
    """The text without blood vessels, pressure vessels, research ships and the like."""
    return F.regexp_replace(text, NONMARITIME_VESSEL, " ")


def is_medical(text: Column) -> Column:
    """Two or more different biomedical terms."""
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MEDICAL), F.lit(0)), lambda x: F.lower(x)))) >= 2


def has_sar(text: Column, strict: bool = True) -> Column:
    """A radar system by name, or the abbreviation where the text means radar; the loose test takes the abbreviation alone."""
    sure = text.rlike(SAR_LONG) | text.rlike(SAR_STRONG)
    if not strict:
        return sure | text.rlike(SAR_BARE)
    rest = F.regexp_replace(text, SAR_REGION, " ")
    return sure | (rest.rlike(SAR_BARE) & ~rest.rlike(SAR_OTHER) & rest.rlike(SENSING_CONTEXT))


def has_craft(text: Column, strict: bool = True, fishing: bool = False) -> Column:
    """A ship, boat or vessel; strictly no vessel of the body or the laboratory, and with ``fishing`` a fishing phrase will do."""
    if not strict:
        return text.rlike(NIGHT_CRAFT if fishing else SHIP)
    rest = strip_nonmaritime(text)
    out = rest.rlike(UNAMBIGUOUS_SHIP) | (rest.rlike(VESSEL) & ~is_medical(text))
    return out | text.rlike(FISHING_PHRASE) if fishing else out


def theme_tests(text: Column, strict: bool = True) -> dict[str, Column]:
    """The seven themes of a normalised text."""
    rest = strip_nonmaritime(text)
    if strict:
        beside = F.regexp_replace(rest, DARK_STRICT, " ")
        dark = text.rlike(DARK_STRICT) & (beside.rlike(MARITIME_CONTEXT) | (beside.rlike(AIS_SHORT) & ~text.rlike(MEDICAL)))
    else:
        dark = text.rlike(DARK) & (text.rlike(MARITIME_STRONG) | text.rlike(VESSEL))
    ais = text.rlike(AIS_LONG) | (text.rlike(AIS_SHORT) & (rest.rlike(SHIP_CONTEXT) if strict else F.lit(True)))
    iuu = text.rlike(IUU)
    if strict:
        iuu = iuu & (text.rlike(IUU_STRONG) | rest.rlike(VESSEL_CONTEXT))
    seen = F.regexp_replace(text, ANIMAL_TELEMETRY, " ") if strict else text
    small = text.rlike(SMALL_CRAFT)
    if strict:
        small = small & ~(is_medical(text) & ~text.rlike(UNAMBIGUOUS_CRAFT))
    small = small | (text.rlike(SMALL_TARGET) & text.rlike(MARITIME_TERM)) | (text.rlike(ARTISANAL) & (text.rlike(ARTISANAL_CONTEXT) if strict else F.lit(True)))
    night = text.rlike(NIGHT_SENSOR) & has_craft(text, strict, fishing=True)
    if strict:
        night = night & (text.rlike(BAND_SENSOR) | (text.rlike(NIGHT_LIGHTS) & (text.rlike(BOAT_OR_FISHING) | text.rlike(MONITOR)))) & text.rlike(NIGHT_DATA)
    sar = has_sar(text, strict)
    return {
        "sar_ship_detection": has_craft(text, strict) & text.rlike(DETECT) & sar, "dark_vessels": dark, "sar_ais_fusion": text.rlike(FUSE) & sar & ais, "xview3": text.rlike(XVIEW),
        "iuu_remote_sensing": iuu & (seen.rlike(SENSING_FISHING) | sar), "small_vessel": small & text.rlike(DETECT_ONLY) & (text.rlike(SENSING_SMALL) | sar), "viirs_boats": night,
    }


def themes_of(text: Column, strict: bool = True) -> Column:
    """The names of the themes that a text matches, in their fixed order."""
    return F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in theme_tests(text, strict).items())))


def places_of(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in PLACES.items())))


def vietnam_places(text: Column) -> Column:
    own = [F.when(text.rlike(PLACES[n]), F.lit(n)) for n in VIETNAM_PLACES]
    return F.array_compact(F.array(*own, F.when(text.rlike(DELTA), F.lit("Mekong Delta"))))


def place_flags(text: Column, countries: Column) -> tuple[Column, Column]:
    """(Southeast Asia, Vietnam) by the text's places or the authors' countries."""
    near = F.arrays_overlap(countries, F.array(*(F.lit(c) for c in COUNTRIES)))
    return (F.size(places_of(text)) > 0) | F.coalesce(near, F.lit(False)), (F.size(vietnam_places(text)) > 0) | F.coalesce(F.array_contains(countries, "VN"), F.lit(False))


def name_tokens(name: Column) -> Column:
    """The different parts of a name that have three letters or more."""
    return F.array_distinct(F.filter(F.split(normalise_title(F.coalesce(name, F.lit(""))), " "), lambda x: F.length(x) >= 3))


def authors_agree(a: Column, b: Column) -> Column:
    """Both names are known and share a part."""
    return F.arrays_overlap(name_tokens(a), name_tokens(b))


def same_first_author(a: Column, b: Column) -> Column:
    """The names share a part, or one is not known."""
    return (F.size(name_tokens(a)) == 0) | (F.size(name_tokens(b)) == 0) | authors_agree(a, b)


def is_preprint(kind: Column, doi: Column) -> Column:
    bare = F.coalesce(normalise_doi(doi), F.lit(""))
    out = F.coalesce(kind == "preprint", F.lit(False))
    for p in PREPRINT_DOIS:
        out = out | bare.startswith(p)
    return out


def is_weak(doi: Column, venue: Column) -> Column:
    """Neither identifier nor venue."""
    return normalise_doi(doi).isNull() & (F.coalesce(venue, F.lit("")) == "")


def is_secondary(kind: Column, doi: Column, venue: Column, source_type: Column) -> Column:
    return is_preprint(kind, doi) | F.coalesce(source_type == "repository", F.lit(False)) | is_weak(doi, venue)


def venue_from_doi(doi: Column) -> Column:
    """Name of the repository that a DOI's prefix tells, else null."""
    out = F.lit(None).cast("string")
    for p, name in reversed(REPOSITORY_DOIS):
        out = F.when(F.lower(doi).startswith(p), name).otherwise(out)
    return out


def resolve_venue(source: Column, locations: Column, raw: Column, doi: Column) -> Column:
    """struct(venue, method): the primary source, else the first good location (array of structs name, kind), else the harvested name, else the DOI's prefix, else any location."""
    good = F.try_element_at(F.filter(locations, lambda x: (x["name"] != "") & x["kind"].isin("journal", "conference", "book series")), F.lit(1))["name"]
    any_ = F.try_element_at(F.filter(locations, lambda x: x["name"] != ""), F.lit(1))["name"]
    bare = F.trim(F.coalesce(raw, F.lit("")))
    clean = F.when(~bare.rlike(r"(?i)^(?:https?://|www\.)") & (F.length(bare) >= 3), bare)
    pick = lambda c, how: F.when(c.isNotNull() & (c != ""), F.struct(c.alias("venue"), F.lit(how).alias("method")))
    return F.coalesce(pick(source, "primary_source"), pick(good, "other_location"), pick(clean, "raw_name"), pick(venue_from_doi(doi), "doi_prefix"), pick(any_, "any_location"), F.struct(F.lit("").alias("venue"), F.lit("unattributed").alias("method")))


def series_name(venue: Column, kind: Column) -> Column:
    """A conference's name without acronym, years and ordinals; journals as they are."""
    name = F.regexp_replace(F.regexp_replace(F.trim(venue), LEAD_ACRONYM, ""), PROCEEDINGS, "")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, YEAR, " "), ORDINAL, " "), r"\s+", " ")
    name = F.regexp_replace(name, r"^[ \-,:;.]+|[ \-,:;.]+$", "")
    plain = ~kind.isin("conference", "") & ~venue.rlike(CONFERENCE)
    return F.when(F.coalesce(venue, F.lit("")) == "", "").when(plain | (name == ""), venue).otherwise(name)


def venue_group(kind: Column, venue: Column) -> Column:
    paper = F.coalesce(venue, F.lit("")).rlike(CONFERENCE)
    return F.when(kind.isin("conference", "repository"), kind).when(kind.isin("journal", "book series", "ebook platform"), F.when(paper, "conference").otherwise("journal")).when(F.coalesce(kind, F.lit("")) != "", "other").otherwise("unattributed")


def split_cell(cell: Column) -> tuple[Column, Column]:
    """(value, provenance) of ``value | provenance``."""
    parts = F.split(F.coalesce(cell, F.lit("")), r" \| ", 2)
    return F.trim(parts[0]), F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))


def join_cell(value: Column, provenance: Column) -> Column:
    return F.when(F.coalesce(provenance, F.lit("")) != "", F.concat(value, F.lit(" | "), provenance)).otherwise(value)


def cell_status(facts: list[Column], publisher: Column, flags: tuple[str, ...] = ("UNVERIFIED", "unknown")) -> Column:
    """VERIFIED without any doubtful fact; else PARTIAL while the publisher is sure, else UNVERIFIED."""
    doubt = lambda c: F.coalesce(c, F.lit("")).rlike("|".join(flags))
    some = F.lit(False)
    for f in facts:
        some = some | doubt(f)
    return F.when(~some, "VERIFIED").when(~doubt(publisher), "PARTIAL").otherwise("UNVERIFIED")


def ship_type_label(code: Column) -> Column:
    """Plain label of a ship type code; null where unknown."""
    out = F.when(code.between(1, 99), F.lit("reserved"))
    for n, label in SHIP_TENS.items():
        out = F.when(F.floor(code / 10) == n, label).otherwise(out)
    for n, label in SHIP_TYPES.items():
        out = F.when(code == n, label).otherwise(out)
    return out


def dimensions(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """(length, width) of the distances from the antenna; null where nothing, or more than the message can say."""
    return F.when((a + b > 0) & (a + b <= 1022), a + b), F.when((c + d > 0) & (c + d <= 126), c + d)


def eta_text(month: Column, day: Column, hour: Column, minute: Column) -> Column:
    two = lambda x, most: F.lpad(F.least(F.coalesce(x, F.lit(0)), F.lit(most)).cast("string"), 2, "0")
    good = month.between(1, 12) & day.between(1, 31)
    return F.when(good, F.concat(two(month, 12), F.lit("-"), two(day, 31), F.lit(" "), two(hour, 24), F.lit(":"), two(minute, 60)))


def coordinates(text: Column) -> Column:
    """struct(lon, lat) of a pair in decimal degrees: latitude first unless letters or a first number above 90 say otherwise; else of two parts in degrees and minutes; null if neither."""
    pair = r"(?i)^\s*(-?\d+(?:\.\d+)?)\s*([NSEW])?\s*[, ]\s*(-?\d+(?:\.\d+)?)\s*([NSEW])?\s*$"
    g = lambda i: F.regexp_extract(text, pair, i)
    a, b, p, q = g(1).try_cast("double"), g(3).try_cast("double"), F.upper(g(2)), F.upper(g(4))
    signed = lambda x, s: F.when(s.isin("W", "S"), -x).otherwise(x)
    east_first = p.isin("E", "W") | q.isin("N", "S")
    lat_first = p.isin("N", "S") | q.isin("E", "W")
    swap = F.when(east_first, True).when(lat_first, False).otherwise(F.abs(a) > 90)
    lon, lat = F.when(swap, signed(a, p)).otherwise(signed(b, q)), F.when(swap, signed(b, q)).otherwise(signed(a, p))
    plain = F.when(a.isNotNull() & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lon.alias("lon"), lat.alias("lat")))
    piece = r"""(?i)(\d+(?:\.\d+)?)\s*(?:°|\s)\s*(\d+(?:\.\d+)?)?\s*(?:'|\s)?\s*(\d+(?:\.\d+)?)?\s*(?:"|'')?\s*([NSEW])"""
    parts = F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(0)), lambda t: F.struct(*((F.coalesce(F.regexp_extract(t, piece, i).try_cast("double"), F.lit(0.0))).alias(n) for i, n in ((1, "d"), (2, "m"), (3, "s"))), F.upper(F.regexp_extract(t, piece, 4)).alias("h")))
    value = lambda x: F.when(x["h"].isin("S", "W"), -1.0).otherwise(1.0) * (x["d"] + x["m"] / 60 + x["s"] / 3600)
    one = lambda letters: F.try_element_at(F.transform(F.filter(parts, lambda x: x["h"].isin(*letters)), value), F.lit(1))
    both = F.when((F.size(parts) == 2) & one("NS").isNotNull() & one("EW").isNotNull(), F.struct(one("EW").alias("lon"), one("NS").alias("lat")))
    return F.coalesce(plain, both)
