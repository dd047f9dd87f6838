"""The leads queue: which contacts and cells deserve a look, by which rules, and in which order.

A lead says what was seen and what would change the picture; an absent report is missing evidence, never proof of intent. Three-valued
conditions follow the rules: what is not known keeps a contact in, except for the class and the network's score.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions.scalars import half_up

# Limits of the gate and the weights of the priority.
CNN_MIN, WIND_MAX_MS, CLUTTER_LOW, NEAR_FIXED_M, INFRA_M = 0.5, 12.0, 5, 250.0, 1000.0
CLASSES = ("high", "medium")
FACTORS = ("evidence_quality", "corroboration", "ais_reach", "persistence", "area_weight")
MAX_POINTS = {"evidence_quality": 30, "corroboration": 25, "ais_reach": 20, "persistence": 15, "area_weight": 10}
CNN_PTS, CHANNEL_PTS, WEATHER_PTS, LIGHT_PTS, EVENT_PTS, REACH_PTS, DENSITY_PTS, DENSITY_FULL, PERSIST_PTS = 20, 5, 5, 15, 10, 12, 8, 10, 15
CELL_PTS, CELL_LIGHTS_FULL, CELL_NIGHTS_FULL, CELL_LIGHTS = 5, 30, 7, 20
NAMES = {"L1": "Unmatched radar contact in AIS reach", "L7": "Lit activity where radar does not look"}
CONDITIONS = ("unmatched", "not_ambiguous", "vessel_class", "cnn", "both_channels", "not_clutter", "not_near_fixed", "weather")


def _col(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or nulls where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _known_true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def both_channels(df: DataFrame) -> Column:
    """True for a contact bright in both channels, false for one channel, null if not known; without the channels the class tells."""
    pol, kind = _col(df, "pol_class", "string"), _col(df, "confidence", "string")
    return F.when(pol.isNotNull(), pol == "VV+VH").when(kind.isNotNull(), kind == "high")


def weather_missing(df: DataFrame) -> Column:
    wind, deep = _col(df, "wind_ms", "double"), _col(df, "deep_convection", "boolean")
    return F.when(wind.isNull() & deep.isNull(), "wind and deep convection").when(wind.isNull(), "wind").when(deep.isNull(), "deep convection").otherwise("")


def gate(df: DataFrame) -> dict[str, Column]:
    """The eight conditions by name, each true or false."""
    reason = F.coalesce(_col(df, "low_reason", "string"), F.lit(""))
    return {
        "unmatched": _known_true(_col(df, "ais_status", "string") == "unmatched"),
        "not_ambiguous": ~_known_true(_col(df, "match_ambiguous", "boolean")),
        "vessel_class": _known_true(_col(df, "confidence", "string").isin(*CLASSES)),
        "cnn": _known_true(_col(df, "cnn_score", "double") >= CNN_MIN),
        "both_channels": F.coalesce(both_channels(df), F.lit(True)),
        "not_clutter": ~(_known_true(_col(df, "n_low_1km", "long") >= CLUTTER_LOW) | (reason == "clutter_zone")),
        "not_near_fixed": ~(_known_true(_col(df, "near_fixed_m", "double") <= NEAR_FIXED_M) | (reason == "near_fixed")),
        "weather": ~(_known_true(_col(df, "wind_ms", "double") >= WIND_MAX_MS) | _known_true(_col(df, "deep_convection", "boolean"))),
    }


def through_gate(df: DataFrame) -> DataFrame:
    """The contacts that meet all conditions, with channels, weather_known and weather_missing."""
    keep = F.lit(True)
    for c in gate(df).values():
        keep = keep & c
    missing = weather_missing(df)
    return df.where(keep).withColumns({"both": both_channels(df), "weather_missing": missing, "weather_known": missing == ""})


def area_points(region: Column, weights: dict[str, int] | None) -> Column:
    out = F.lit(0)
    for name, w in (weights or {}).items():
        out = F.when(region == name, max(0, min(MAX_POINTS["area_weight"], int(w)))).otherwise(out)
    return out


def contact_points(df: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with a points column per factor. Needs cnn_score, both, wind_ms, deep_convection, n_lights, n_events, ais_reach, n_ais_10km, n_persist, region_box."""
    zero = F.lit(0.0)
    clip = lambda x: F.least(F.greatest(F.coalesce(x, zero), zero), F.lit(1.0))
    calm = (F.col("wind_ms") < WIND_MAX_MS) & ~F.col("deep_convection")
    quality = CNN_PTS * clip((F.col("cnn_score") - CNN_MIN) / (1 - CNN_MIN)) + F.when(_known_true(F.col("both")), CHANNEL_PTS).otherwise(0) + F.when(_known_true(calm), WEATHER_PTS).otherwise(0)
    more = lambda c, pts: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, pts).otherwise(0)
    return df.withColumns({
        "pts_evidence_quality": half_up(quality).cast("long"), "pts_corroboration": (more("n_lights", LIGHT_PTS) + more("n_events", EVENT_PTS)).cast("long"),
        "pts_ais_reach": half_up(REACH_PTS * clip(F.col("ais_reach")) + DENSITY_PTS * clip(F.col("n_ais_10km") / DENSITY_FULL)).cast("long"),
        "pts_persistence": more("n_persist", PERSIST_PTS).cast("long"), "pts_area_weight": area_points(F.col("region_box"), weights).cast("long"),
    })


def cell_points(df: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` (n_lights, n_nights, region_box) with the points of a coverage lead: it makes no claim about AIS and is not corroborated."""
    lights = F.least(F.lit(1.0), F.log1p(F.coalesce("n_lights", F.lit(0)).cast("double")) / math.log1p(CELL_LIGHTS_FULL))
    nights = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("n_nights", F.lit(0)) - 1.0) / (CELL_NIGHTS_FULL - 1))
    none = F.lit(0).cast("long")
    return df.withColumns({"pts_evidence_quality": half_up(CELL_PTS * lights).cast("long"), "pts_corroboration": none, "pts_ais_reach": none, "pts_persistence": half_up(CELL_PTS * nights).cast("long"), "pts_area_weight": area_points(F.col("region_box"), weights).cast("long")})


def with_priority(df: DataFrame) -> DataFrame:
    """``df`` with priority, the sum of the factors within 0 and 100, and its band."""
    total = sum((F.col(f"pts_{f}") for f in FACTORS), F.lit(0).cast("long"))
    p = F.least(F.greatest(total, F.lit(0)), F.lit(100))
    return df.withColumns({"priority": p, "priority_band": F.when(p >= 67, "high").when(p >= 34, "medium").otherwise("low")})


def factors_json(df: DataFrame) -> Column:
    """The factors with their points and maxima as a JSON array."""
    return F.to_json(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f"pts_{f}").alias("points"), F.lit(MAX_POINTS[f]).alias("max_points")) for f in FACTORS)))


def select_lights(lights: DataFrame) -> DataFrame:
    """Clear-sky vessel lights that radar never saw in the window, away from known infrastructure."""
    near = _known_true(F.col("infra_m") <= INFRA_M)
    return lights.where((F.col("quality") == "clear") & (F.col("class") == "lit_vessel_candidate") & (F.col("s1_passes") == 0) & ~near)


def light_exclusions(lights: DataFrame) -> DataFrame:
    """One row of counts: all lights, candidates, never imaged, near infrastructure, kept."""
    clear = (F.col("quality") == "clear") & (F.col("class") == "lit_vessel_candidate")
    never, near = F.coalesce(F.col("s1_passes") == 0, F.lit(False)), _known_true(F.col("infra_m") <= INFRA_M)
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return lights.agg(F.count("*").alias("lights"), n(clear, "candidates"), n(clear & never, "never_imaged"), n(clear & never & near, "near_infra"), n(clear & never & ~near, "kept"))


def lit_cells(lights: DataFrame, cell: Column, most: int = CELL_LIGHTS) -> DataFrame:
    """Per cell: lights, different nights, their sorted list, first and last time, median radiance, mean place, and the brightest lights' ids."""
    x = lights.withColumn("cell_id", cell).where("cell_id is not null")
    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc_nulls_last("radiance"), "light_id"))
    bright = x.withColumn("_r", rank).where(F.col("_r") <= most).groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "light_id"))), lambda s: s["light_id"]).alias("light_ids"))
    out = x.groupBy("cell_id").agg(
        F.count("*").alias("n_lights"), F.count_distinct("night").alias("n_nights"), F.array_join(F.array_sort(F.collect_set(F.col("night").cast("string"))), ";").alias("nights"), F.min("ts").alias("first_light"), F.max("ts").alias("last_light"),
        F.median("radiance").alias("radiance_med"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
    )
    return out.join(bright, "cell_id")


def contact_evidence(most_persist: int = 5) -> Column:
    """The evidence of a contact lead in fixed role order, from det_id, pass_id, nearest_key, light_ids, event_keys, persist, weather_row and cell_id."""
    row = lambda kind, key, role: F.struct(F.lit(kind).alias("type"), key.cast("string").alias("id"), F.lit(role).alias("role"))
    one = lambda kind, c, role: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.array(row(kind, F.col(c), role))).otherwise(F.array().cast("array<struct<type:string,id:string,role:string>>"))
    many = lambda kind, ids, role: F.transform(ids, lambda x: row(kind, x, role))
    weather = F.when(F.col("weather_row"), F.array(row("weather", F.col("det_id"), "weather"))).otherwise(F.array().cast("array<struct<type:string,id:string,role:string>>"))
    return F.concat(
        F.array(row("contact", F.col("det_id"), "primary")), one("pass", "pass_id", "pass"), one("vessel", "nearest_key", "nearest_ais"), many("light", F.col("light_ids"), "same_night_light"),
        many("event", F.col("event_keys"), "ais_behaviour"), many("contact", F.slice("persist", 1, most_persist), "persistence"), weather, one("cell", "cell_id", "cell"),
    )


def cell_evidence(most: int = CELL_LIGHTS) -> Column:
    row = lambda kind, key, role: F.struct(F.lit(kind).alias("type"), key.cast("string").alias("id"), F.lit(role).alias("role"))
    return F.concat(F.array(row("cell", F.col("cell_id"), "primary")), F.transform(F.slice("light_ids", 1, most), lambda x: row("light", x, "light")))


def n_contact_evidence(most_persist: int = 5) -> Column:
    """The number of rows of ``contact_evidence``, from n_lights, n_events and n_persist in place of the ids."""
    there = lambda c: F.when(F.coalesce(F.col(c).cast("string") != "", F.lit(False)), 1).otherwise(0)
    return (F.lit(1) + there("pass_id") + there("nearest_key") + F.col("n_lights") + F.col("n_events") + F.least("n_persist", F.lit(most_persist)) + F.when(F.col("weather_row"), 1).otherwise(0) + there("cell_id")).cast("long")


def n_cell_evidence(most: int = CELL_LIGHTS) -> Column:
    """The number of rows of ``cell_evidence``."""
    return (F.lit(1) + F.least(F.size("light_ids"), F.lit(most))).cast("long")


def nearest_key(vessel_id: Column, mmsi: Column) -> Column:
    """Key of the nearest vessel: a registry id if there is one, else the number."""
    return F.when(vessel_id.isNotNull() & (vessel_id != ""), F.concat(F.lit("gfw:"), vessel_id)).when(mmsi.isNotNull(), F.concat(F.lit("mmsi:"), mmsi.cast("string")))


def _where(region: Column) -> Column:
    return F.when(region.isNotNull() & ~region.isin("", "other"), region).otherwise("outside the reporting boxes")


def contact_title(length_m: Column, region: Column) -> Column:
    size = F.when(length_m.isNotNull(), F.concat(F.format_string("%.0f", length_m), F.lit(" m"))).otherwise("length unknown")
    return F.concat(F.lit(f"{NAMES['L1']}, "), size, F.lit(", "), _where(region))


def cell_title(n_lights: Column, n_nights: Column, region: Column) -> Column:
    many = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    return F.concat(F.lit(f"{NAMES['L7']}, "), many(n_lights, "clear-sky light"), F.lit(" on "), many(n_nights, "night"), F.lit(", "), _where(region), F.lit(" (coverage lead, not a vessel lead)"))


def finalise(*frames: DataFrame) -> DataFrame:
    """All leads under the same columns, in the queue's order: type, priority, id."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(F.when(F.col("lead_type") == "L1", 0).when(F.col("lead_type") == "L7", 1).otherwise(9), F.desc("priority"), "lead_id")


def top_of_queue(leads: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(size, lead_type, n): types among the first leads by priority and id. Only the longest head is sorted."""
    head = leads.orderBy(F.desc("priority"), "lead_id").limit(max(sizes))
    ranked = head.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("priority"), "lead_id")))  # the head alone
    return ranked.select(F.explode(F.array(*(F.lit(s) for s in sizes))).alias("size"), "lead_type", "_r").where("_r <= size").groupBy("size", "lead_type").agg(F.count("*").alias("n"))


def queue_order(leads: DataFrame) -> DataFrame:
    """One row: the least priority of contact leads, the most of coverage leads, how many contact leads are below or at it, and whether all of the first come before all of the second."""
    l1, l7 = F.col("lead_type") == "L1", F.col("lead_type") == "L7"
    ends = leads.agg(F.min(F.when(l1, F.col("priority"))).alias("l1_min"), F.max(F.when(l7, F.col("priority"))).alias("l7_max"))
    key = F.struct((-F.col("priority")).alias("p"), "lead_id")
    last = leads.agg(F.max(F.when(l1, key)).alias("last"), F.min(F.when(l7, key)).alias("first"))
    x = leads.where(l1).crossJoin(F.broadcast(ends)).agg(F.count(F.when(F.col("priority") < F.col("l7_max"), 1)).alias("l1_below"), F.count(F.when(F.col("priority") == F.col("l7_max"), 1)).alias("l1_at"))  # one row on the right
    one = ends.crossJoin(x).crossJoin(last)  # single rows
    return one.select("l1_min", "l7_max", "l1_below", "l1_at", F.coalesce(F.col("last") < F.col("first"), F.lit(True)).alias("in_order"))


def corroboration_feasibility(passes: DataFrame, lights: DataFrame, hours: float = 3.0) -> DataFrame:
    """One row: different ten-minute pass times, how many have a light's clock time, and how many a light's time, within the hours.

    Clock times are minutes of the day, so at most 1,440 a side meet; absolute times meet by buckets of the window.
    """
    p = passes.where("acq is not null").select((F.floor(F.unix_seconds("acq") / 600) * 600).alias("t")).distinct()
    clock = lambda c: F.floor(c % 86400 / 60) * 60
    l = lights.where("ts is not null").select(F.unix_seconds("ts").alias("u")).distinct()  # noqa: E741
    own, other = p.groupBy(clock(F.col("t")).alias("c")).agg(F.count("*").alias("n")), l.select(clock(F.col("u")).alias("d")).distinct()
    gap = F.abs(F.col("c") - F.col("d"))
    by_clock = own.crossJoin(F.broadcast(other)).groupBy("c", "n").agg(F.min(F.least(gap, 86400 - gap)).alias("g"))  # minutes of a day on either side
    w = int(hours * 3600)
    near = p.withColumn("s", F.explode(F.sequence(F.floor(F.col("t") / w) - 1, F.floor(F.col("t") / w) + 1))).join(l.withColumn("s", F.floor(F.col("u") / w)), "s").where(F.abs(F.col("t") - F.col("u")) <= w).select("t").distinct()
    a = by_clock.agg(F.sum("n").alias("passes"), F.sum(F.when(F.col("g") <= w, F.col("n")).otherwise(0)).alias("by_clock"), F.min("g").alias("least_gap_s"))
    return a.crossJoin(near.agg(F.count("*").alias("absolute")))
