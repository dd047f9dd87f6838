"""Pairing of radar contacts with vessels that report: positions at the scene's time, gates, feasible pairs, ambiguity, status.

Distances are great-circle metres; motion is in local east and north metres. Unknown speeds, courses and lengths are null and never
turn a pair away; a contact without a pair is missing evidence, not proof of anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions import geo
from pelagos.functions.scalars import KN_MS
from pelagos.operators import proximity


# Limits of the matcher (metres, seconds, knots).
@dataclass(frozen=True)
class Match:
    max_dist_m: float = 2000.0
    max_gap_s: float = 1800.0
    max_extrap_s: float = 600.0
    base_gate_m: float | None = 500.0
    gate_s: float = 125.0
    min_length_ratio: float = 0.25
    fixed_max_kn: float = 2.0
    margin_m: float = 100.0
    ratio: float = 1.5
    window_s: int = 1800


#: The matcher of live scenes, and the one with a fixed gate of a kilometre.
LIVE, FIXED = Match(), Match(max_dist_m=1000.0, base_gate_m=None)
SAT_SPEED_MS = 7598.0


def with_static(reports: DataFrame, static: DataFrame, key: str = "mmsi", column: str = "length_m") -> DataFrame:
    """Reports with one static value per vessel, the reports' own first."""
    one = static.groupBy(key).agg(F.max(column).alias("_s"))
    out = reports.join(one, key, "left")
    return out.withColumn(column, F.coalesce(column, "_s") if column in reports.columns else F.col("_s")).drop("_s")


def near_scene(reports: DataFrame, scenes: DataFrame, seconds: int) -> DataFrame:
    """Reports (ts) within ``seconds`` of each scene (scene_id, acq), with dt_s from the scene; an equi-join on time buckets."""
    slot = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    a = scenes.withColumn("_s", F.explode(F.sequence(slot(F.col("acq")) - 1, slot(F.col("acq")) + 1)))
    pairs = a.join(reports.withColumn("_s", slot(F.col("ts"))), "_s").drop("_s")
    return pairs.withColumn("dt_s", (F.unix_micros("ts") - F.unix_micros("acq")) / 1_000_000).where(F.abs("dt_s") <= seconds)


def positions_at(reports: DataFrame, scenes: DataFrame, cfg: Match = LIVE, tie: str = "event_id") -> DataFrame:
    """(scene_id, mmsi, method, dt_s, sog_kn, cog_deg, n_reports, length_m, lon, lat, speed_kn, east_ms, north_ms): each vessel that can be placed at a scene's time.

    Linear between the last report before and the first after where both are near enough, else dead reckoning by speed and course from
    the nearest report if that is near enough, else that report's place. The velocity is the nearest report's, else the track's.
    """
    near = near_scene(reports, scenes, cfg.window_s)
    row = F.struct("ts", F.col(tie).alias("tie"), "dt_s", "lon", "lat", "sog_kn", "cog_deg")
    sides = near.groupBy("scene_id", "mmsi").agg(
        F.max(F.when(F.col("dt_s") <= 0, row)).alias("b"), F.min(F.when(F.col("dt_s") > 0, row)).alias("f"),
        F.min(F.struct(F.abs("dt_s").alias("gap"), row.alias("row"))).alias("n"), F.count("*").alias("n_reports"),
        F.max_by("length_m", F.when(F.col("length_m").isNotNull(), F.struct("ts", tie))).alias("length_m"),
    )
    gap, one = F.col("n.gap"), F.col("n.row")
    both = F.coalesce((-F.col("b.dt_s") <= cfg.max_gap_s) & (F.col("f.dt_s") <= cfg.max_gap_s), F.lit(False))
    share = -F.col("b.dt_s") / (F.col("f.dt_s") - F.col("b.dt_s"))
    moving = one["sog_kn"].isNotNull() & one["cog_deg"].isNotNull()
    run = one["sog_kn"] * KN_MS * -one["dt_s"]
    metre = 1 / (geo.KM_PER_DEGREE * 1000)
    lon_now = F.when(moving, one["lon"] + run * F.sin(F.radians(one["cog_deg"])) * metre / F.cos(F.radians(one["lat"]))).otherwise(one["lon"])
    lat_now = F.when(moving, one["lat"] + run * F.cos(F.radians(one["cog_deg"])) * metre).otherwise(one["lat"])
    mix = lambda c, other: F.when(both, F.col(f"b.{c}") + share * (F.col(f"f.{c}") - F.col(f"b.{c}"))).otherwise(other)
    own = moving & (gap <= cfg.max_extrap_s)
    span = F.col("f.dt_s") - F.col("b.dt_s")
    east = (F.col("f.lon") - F.col("b.lon")) * F.cos(F.radians(F.col("b.lat"))) / metre / span
    north = (F.col("f.lat") - F.col("b.lat")) / metre / span
    e = F.when(own, one["sog_kn"] * KN_MS * F.sin(F.radians(one["cog_deg"]))).when(both & (span > 0), east)
    n = F.when(own, one["sog_kn"] * KN_MS * F.cos(F.radians(one["cog_deg"]))).when(both & (span > 0), north)
    placed = sides.where(both | (gap <= cfg.max_extrap_s))
    return placed.select(
        "scene_id", "mmsi", F.when(both, "interp").when(moving, "extrap").otherwise("nearest").alias("method"),
        F.when(both, F.least(-F.col("b.dt_s"), F.col("f.dt_s"))).otherwise(gap).alias("dt_s"), one["sog_kn"].alias("sog_kn"), one["cog_deg"].alias("cog_deg"), "n_reports", "length_m",
        mix("lon", lon_now).alias("lon"), mix("lat", lat_now).alias("lat"),
        F.when(own, one["sog_kn"]).otherwise(F.sqrt(e * e + n * n) / KN_MS).alias("speed_kn"), e.alias("east_ms"), n.alias("north_ms"),
    )


def gate_metres(sog_kn: Column, cfg: Match = LIVE) -> Column:
    """How far a pair may lie apart: wider for a fast vessel, up to the most; the most where the speed is unknown."""
    if cfg.base_gate_m is None:
        return F.lit(cfg.max_dist_m)
    return F.coalesce(F.when(sog_kn.isNotNull(), F.least(F.lit(cfg.base_gate_m) + cfg.gate_s * F.abs(sog_kn) * KN_MS, F.lit(cfg.max_dist_m))), F.lit(cfg.max_dist_m))


def feasible(distance_m: Column, gate_m: Column, length_radar: Column, length_ais: Column, confidence: Column, speed_kn: Column, cfg: Match = LIVE) -> Column:
    """Within the gate; not where the return is far shorter than the hull, nor a fixed contact with a vessel under way."""
    short = F.coalesce(F.when(length_ais > 0, length_radar / length_ais) < cfg.min_length_ratio, F.lit(False))
    moored = F.coalesce((confidence == "fixed") & (F.coalesce(speed_kn, F.lit(0.0)) >= cfg.fixed_max_kn), F.lit(False))
    return (distance_m <= gate_m) & ~short & ~moored


def clearly_worse(a: Column, b: Column, cfg: Match = LIVE) -> Column:
    """Whether distance b is clearly worse than distance a."""
    return b >= F.greatest(a + cfg.margin_m, cfg.ratio * a)


def azimuth_shift(slant_m: Column, incidence_deg: Column, range_e: Column, range_n: Column, east_ms: Column, north_ms: Column, sat_ms: float = SAT_SPEED_MS, sign: float = 1.0) -> Column:
    """Metres along the satellite's track by which a moving target appears displaced; 0 where anything is unknown."""
    towards = (F.coalesce(east_ms, F.lit(0.0)) * range_e + F.coalesce(north_ms, F.lit(0.0)) * range_n) * F.sin(F.radians(incidence_deg))
    return F.coalesce(-sign * slant_m / sat_ms * towards, F.lit(0.0))


def expected_place(lon: Column, lat: Column, east_ms: Column, north_ms: Column, after_s: Column, shift_m: Column, track_e: Column, track_n: Column) -> tuple[Column, Column]:
    """Where a vessel placed at the scene's time should show ``after_s`` later, displaced by ``shift_m`` along the track."""
    zero = F.lit(0.0)
    east = F.coalesce(east_ms, zero) * after_s + shift_m * F.coalesce(track_e, zero)
    north = F.coalesce(north_ms, zero) * after_s + shift_m * F.coalesce(track_n, zero)
    metre = 1 / (geo.KM_PER_DEGREE * 1000)
    return lon + east * metre / F.cos(F.radians(lat)), lat + north * metre


def candidate_pairs(contacts: DataFrame, placed: DataFrame, cfg: Match = LIVE, speed: str = "speed_kn") -> DataFrame:
    """Feasible (scene_id, det_id, mmsi, dist_m, gate_m, dt_s, method, speed_kn, length_ais, length_m) of contacts and placed vessels of a scene."""
    at = placed.select("scene_id", "mmsi", "lon", "lat", "method", "dt_s", F.coalesce("sog_kn", speed).alias("speed_kn"), F.col("length_m").alias("length_ais"))
    pairs = proximity.within(contacts.select("scene_id", "det_id", "lon", "lat", "length_m", "confidence"), at, cfg.max_dist_m, extra=("scene_id",))
    gate = gate_metres(F.col("r_speed_kn"), cfg)
    kept = pairs.withColumn("gate_m", gate).where(feasible(F.col("dist_m"), F.col("gate_m"), F.col("length_m"), F.col("r_length_ais"), F.col("confidence"), F.col("r_speed_kn"), cfg))
    return kept.select("scene_id", "det_id", F.col("r_mmsi").alias("mmsi"), "dist_m", "gate_m", F.col("r_dt_s").alias("dt_s"), F.col("r_method").alias("method"), F.col("r_speed_kn").alias("speed_kn"), F.col("r_length_ais").alias("length_ais"), "length_m")


def ambiguity(pairs: DataFrame, taken: DataFrame, cfg: Match = LIVE) -> DataFrame:
    """``taken`` (scene_id, det_id, mmsi, dist_m) with ambiguous, alt_dist_m and candidates (the contact's possible vessels, sorted, ';' between).

    A pair is ambiguous if its contact has another feasible vessel that is not clearly worse and has no clearly better pair of its own, or
    the same holds for its vessel and another contact.
    """
    own = taken.select("scene_id", "det_id", F.col("mmsi").alias("c_mmsi"), F.col("dist_m").alias("c_dist"))
    other = taken.select("scene_id", "mmsi", F.col("det_id").alias("v_det"), F.col("dist_m").alias("v_dist"))
    x = pairs.select("scene_id", "det_id", "mmsi", "dist_m").join(own, ["scene_id", "det_id"], "left").join(other, ["scene_id", "mmsi"], "left")
    x = x.where("not (mmsi <=> c_mmsi)")
    free = lambda d: d.isNull() | ~clearly_worse(d, F.col("dist_m"), cfg)
    close = lambda d: d.isNotNull() & ~clearly_worse(d, F.col("dist_m"), cfg)
    for_contact = x.where(close(F.col("c_dist")) & free(F.col("v_dist"))).groupBy("scene_id", "det_id").agg(F.min("dist_m").alias("_a"), F.collect_set(F.col("mmsi").cast("string")).alias("_m"))
    for_vessel = x.where(close(F.col("v_dist")) & free(F.col("c_dist"))).groupBy("scene_id", "mmsi").agg(F.min("dist_m").alias("_b"))
    out = taken.join(for_contact, ["scene_id", "det_id"], "left").join(for_vessel, ["scene_id", "mmsi"], "left")
    names = F.array_join(F.array_sort(F.array_union(F.coalesce("_m", F.array().cast("array<string>")), F.array(F.col("mmsi").cast("string")))), ";")
    amb = F.col("_a").isNotNull() | F.col("_b").isNotNull()
    return out.withColumns({"ambiguous": amb, "alt_dist_m": F.least("_a", "_b"), "candidates": F.when(amb, names)}).drop("_a", "_b", "_m")


def match_scene(contacts: DataFrame, reports: DataFrame, scenes: DataFrame, static: DataFrame | None = None, gear: DataFrame | None = None, cfg: Match = LIVE) -> DataFrame:
    """Contacts (scene_id, det_id, lon, lat, length_m, confidence) with their vessel: stations only, gear left out, least total distance
    per scene, ambiguous pairs held back."""
    ships = reports.where(F.col("mmsi").between(201_000_000, 775_999_999))
    if gear is not None:
        ships = ships.join(gear.select("mmsi").distinct(), "mmsi", "left_anti")
    if static is not None:
        ships = with_static(ships, static)
    from pelagos.operators import scenes as whole  # which uses this module

    out = whole.matched(contacts, positions_at(ships, scenes, cfg), cfg)
    return out.withColumn("ais_status", F.when(F.col("mmsi").isNotNull(), "matched").otherwise("unmatched"))


def leftover(placed: DataFrame, matched: DataFrame) -> DataFrame:
    """Placed vessels that no contact took."""
    return placed.join(matched.where("mmsi is not null").select("scene_id", "mmsi"), ["scene_id", "mmsi"], "left_anti")


def live_quality(distance_m: Column, dt_s: Column, speed_kn: Column, length_radar: Column, length_ais: Column) -> Column:
    """high, medium or low by distance, by how far the vessel moved since its report (else by time) and by the length ratio."""
    ratio = F.when(length_ais > 0, length_radar / length_ais)
    track = F.abs(speed_kn) * KN_MS * F.abs(dt_s)

    def fits(most_m: float, most_track: float, most_s: float, low: float, high: float) -> Column:
        near = F.when(track.isNotNull(), track <= most_track).otherwise(F.abs(dt_s) <= most_s)
        return (distance_m <= most_m) & near & (ratio.isNull() | ratio.between(low, high))

    return F.when(distance_m.isNull(), None).when(fits(200, 1000, 300, 0.4, 3.0), "high").when(fits(500, 3000, 900, 0.25, 4.0), "medium").otherwise("low")


def status_of(contacts: DataFrame, reports: DataFrame, vessels: DataFrame, near_km: float = 20.0, count_km: float = 10.0) -> DataFrame:
    """``contacts`` (det_id, lon, lat, matched) with ais_status and n_ais_10km: unmatched only where any report was in the cell or near."""
    cell = geo.cell_id(F.col("lon"), F.col("lat"))
    heard_cells = reports.select(cell.alias("_cell")).where("_cell is not null").distinct().withColumn("_in", F.lit(True))
    near = proximity.heard(contacts, reports, "det_id", near_km * 1000).withColumn("_near", F.lit(True))
    out = proximity.count_within(contacts, vessels, "det_id", "mmsi", count_km * 1000).withColumnRenamed("n_within", "n_ais_10km")
    out = out.withColumn("_cell", cell).join(heard_cells, "_cell", "left").join(near, "det_id", "left")
    covered = F.coalesce("_in", "_near", F.lit(False))
    return out.withColumn("ais_status", F.when(F.col("matched"), "matched").when(covered, "unmatched").otherwise("no_coverage")).drop("_cell", "_in", "_near")


def merge_id_sets(a: Column, b: Column) -> Column:
    """Union of two ';'-joined sets of ids, sorted; nulls are empty, nothing at all gives null."""
    parts = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ";"), lambda y: y != "")
    return F.nullif(F.array_join(F.array_sort(F.array_union(parts(a), parts(b))), ";"), F.lit(""))
