"""Evidence joins: what lies near a contact in place and time, fills from other tables, agreement of two sets of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import geo
from pelagos.functions.scalars import wilson
from pelagos.operators import around, proximity


def _micros(c) -> Column:
    return F.unix_micros(c)


def next_look(points: DataFrame, passes: DataFrame, key: str, at: str, not_before: Column | None = None, cell: float = 1.0) -> DataFrame:
    """``points`` with next_start and next_pass: the first planned pass after the point's time (and ``not_before``) whose box holds the point.

    Passes that are past do not count. Boxes go to the cells they touch, so points meet only boxes near them.
    """
    p = passes.where(F.coalesce(F.col("status") != "past", F.lit(True)))
    if not_before is not None:
        p = p.where(F.col("start") > not_before)
    rows = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    p = p.withColumn("_cx", rows("west", "east")).withColumn("_cy", rows("south", "north"))
    x = points.select(key, "lon", "lat", F.col(at).alias("_at")).withColumns({"_cx": F.floor(F.col("lon") / cell), "_cy": F.floor(F.col("lat") / cell)})
    inside = (F.col("lon") > F.col("west")) & (F.col("lon") < F.col("east")) & (F.col("lat") > F.col("south")) & (F.col("lat") < F.col("north"))
    hit = x.join(p.select("_cx", "_cy", "pass_group", "start", "west", "south", "east", "north"), ["_cx", "_cy"]).where(inside & (F.col("_at").isNull() | (F.col("start") > F.col("_at"))))
    best = hit.groupBy(key).agg(F.min(F.struct("start", "pass_group")).alias("_b")).select(key, F.col("_b.start").alias("next_start"), F.col("_b.pass_group").alias("next_pass"))
    return points.join(best, key, "left")


def near_in_span(points: DataFrame, other: DataFrame, at: str, other_key: str, start: str, stop: str, km: float, hours: float, name: str, count: bool = False) -> DataFrame:
    """``points`` with ``name``: the sorted ids (with ``count`` their number) of other rows within ``km`` whose span, padded by ``hours``, holds the point's time."""
    return around.in_span(points, other, at, other_key, start, stop, km * 1000, int(hours * 3_600_000_000), name, count)


def persistence_pairs(leads: DataFrame, pool: DataFrame, km: float = 2.0, hours: float = 72.0, min_gap_s: float = 600.0, name: str = "persist", count: bool = False) -> DataFrame:
    """``leads`` (det_id, lon, lat, acq, pass_id) with ``name``: sorted ids (with ``count`` their number) of other contacts within ``km`` and ``hours``, more than ``min_gap_s`` apart and of another pass."""
    return around.seen_again(leads, pool, km * 1000, int(hours * 3_600_000_000), int(min_gap_s * 1_000_000), name, count)


def fill_from(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` filled, where null or missing, from the first right row per key in ``order``."""
    one = right.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    out = left.join(one, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col("_r")[c]) if c in left.columns else F.col("_r")[c] for c in columns}).drop("_r")


def agreement(a: DataFrame, b: DataFrame, radii: tuple[float, ...], boxes, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Per box, direction and radius: how many points (id, lon, lat) of one set have one of the other in the same box within the radius, with a score interval.

    The box 'All' holds every point; boxes may overlap.
    """
    widest = max(radii)

    def boxed(df: DataFrame) -> DataFrame:
        hits = [F.when((F.col("lon") >= w) & (F.col("lon") < e) & (F.col("lat") >= s) & (F.col("lat") < n), F.lit(name)) for name, w, s, e, n in boxes]
        return df.select("id", "lon", "lat", F.explode(F.array_compact(F.array(F.lit("All"), *hits))).alias("box"))

    out = None
    for left, right, name in ((a, b, f"{names[0]}_near_{names[1]}"), (b, a, f"{names[1]}_near_{names[0]}")):
        each = around.nearest(boxed(left), boxed(right), "id", widest, extra=("box",)).groupBy("box", "id").agg(F.min("nearest_m").alias("d"))
        counts = each.groupBy("box").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("d") <= r, 1)).alias(f"k{i}") for i, r in enumerate(radii)))
        rows = F.explode(F.array(*(F.struct(F.lit(float(r)).alias("radius_m"), F.col(f"k{i}").alias("k")) for i, r in enumerate(radii)))).alias("x")
        part = counts.select("box", "n", rows).select("box", F.lit(name).alias("direction"), "x.radius_m", "x.k", "n")
        out = part if out is None else out.unionByName(part)
    low, high = wilson(F.col("k"), F.col("n"))
    return out.withColumns({"share": F.col("k") / F.col("n"), "low": low, "high": high})


def cell_type(points: DataFrame, cells: DataFrame, key: str, day: str, reach_m: float = 1000.0) -> DataFrame:
    """``points`` with the one type of the cells of its date within reach ('mixed' if several, null if none), their number and detections, and single."""
    pairs = proximity.within(points.select(key, "lon", "lat", day), cells.select("lon", "lat", day, "type", "detections"), reach_m, extra=(day,))
    got = pairs.groupBy(key).agg(F.min("r_type").alias("lo"), F.max("r_type").alias("hi"), F.count("*").alias("n_cells"), F.sum(F.coalesce("r_detections", F.lit(0))).alias("n_detections"), F.min("dist_m").alias("nearest_m"))
    kind = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("n_cells") > 0, "mixed")
    out = points.join(got.select(key, kind.alias("type"), "n_cells", "n_detections", "nearest_m"), key, "left").na.fill(0, ["n_cells", "n_detections"])
    return out.withColumn("single", F.col("n_detections") == 1)


def lit_same_night(points: DataFrame, lights: DataFrame, key: str, night: str, reach_m: float = 1000.0) -> DataFrame:
    """``points`` with lit: whether a light of the same night lies within reach (seen hours apart, so never a match)."""
    hit = proximity.within(points.select(key, "lon", "lat", night), lights.select("lon", "lat", night), reach_m, extra=(night,)).select(key).distinct().withColumn("lit", F.lit(True))
    return points.join(hit, key, "left").na.fill(False, ["lit"])


def point_class(distance_m: Column, length_m: Column, radius_m: float = 50.0, ambiguous_m: float = 150.0) -> Column:
    """vessel within the radius, ambiguous within three quarters of the label's length or the wider radius, else clutter."""
    return F.when(distance_m <= radius_m, "vessel").when(distance_m <= F.greatest(F.lit(ambiguous_m), 0.75 * F.coalesce(length_m, F.lit(0.0))), "ambiguous").otherwise("clutter")


def mutual_distances(a: DataFrame, b: DataFrame, reach_m: float) -> tuple[DataFrame, DataFrame]:
    """Each set (id, lon, lat) with its nearest point of the other within reach: nearest_id, nearest_m."""
    return proximity.nearest(a, b, "id", "id", reach_m), proximity.nearest(b, a, "id", "id", reach_m)


def fuse_channels(vv: DataFrame, vh: DataFrame, scene: str, radius_px: float = 3.0) -> DataFrame:
    """One list of objects (scene, id, row, col, length_m) from two channels: a VV object takes its nearest VH object within the radius, the first of two in id order; the rest stand alone."""
    cell = lambda c: F.floor(F.col(c) / radius_px)
    steps = F.sequence(F.lit(-1), F.lit(1))
    # Distance depends on the place alone, so places meet, each with its first VH object; objects of one place share the answer.
    spots = vv.select(scene, "row", "col").distinct()
    a = spots.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumns({"_x": cell("col") + F.col("_dx"), "_y": cell("row") + F.col("_dy")})
    first = vh.groupBy(scene, "row", "col").agg(F.min(F.struct(F.col("id").alias("h_id"), F.col("length_m").alias("h_length"))).alias("_h"))
    b = first.select(F.col(scene).alias("_scene"), "_h.h_id", F.col("row").alias("h_row"), F.col("col").alias("h_col"), "_h.h_length", cell("col").alias("_hx"), cell("row").alias("_hy"))
    d = F.sqrt(F.pow(F.col("row") - F.col("h_row"), 2) + F.pow(F.col("col") - F.col("h_col"), 2))
    pairs = a.join(b, (a[scene] == b["_scene"]) & (a["_x"] == b["_hx"]) & (a["_y"] == b["_hy"])).withColumn("_d", d).where(F.col("_d") < radius_px)
    near = pairs.groupBy(scene, "row", "col").agg(F.min(F.struct("_d", "h_id", "h_length")).alias("b")).select(scene, "row", "col", "b.h_id", "b.h_length")
    won = vv.select(scene, "id", "row", "col").join(near, [scene, "row", "col"]).groupBy(scene, "h_id").agg(F.min(F.struct("id", "h_length")).alias("_w")).select(scene, "_w.id", "h_id", "_w.h_length")
    both = vv.join(won, [scene, "id"], "left")
    left = both.select(scene, "id", "h_id", "row", "col", F.greatest("length_m", "h_length").alias("length_m"), F.when(F.col("h_id").isNotNull(), "VV+VH").otherwise("VV only").alias("pol_class"))
    right = vh.join(won.select(scene, F.col("h_id").alias("id")), [scene, "id"], "left_anti")
    return left.unionByName(right.select(scene, F.lit(None).cast(dict(vv.dtypes)["id"]).alias("id"), F.col("id").alias("h_id"), "row", "col", "length_m", F.lit("VH only").alias("pol_class")))


def recurring(lights: DataFrame, clear_nights: Column, radius_m: float = 500.0, share: float = 0.3, least: int = 3) -> DataFrame:
    """``lights`` (light_id, lon, lat, night) with nights_seen within the radius and the class: persistent where the nights reach the share of clear ones and ``least``."""
    x = lights.select("light_id", "lon", "lat", "night")
    n = proximity.within(x, x, radius_m).groupBy("light_id").agg(F.count_distinct("r_night").alias("nights_seen"))
    need = F.greatest(F.lit(least), F.ceil(share * clear_nights))
    return lights.join(n, "light_id").withColumn("light_class", F.when(F.col("nights_seen") >= need, "persistent_light").otherwise("lit_vessel_candidate"))


def compare_points(ours: DataFrame, theirs: DataFrame, radius_m: float = 500.0, max_hours: float = 1.0) -> DataFrame:
    """``ours`` (id, lon, lat, acq) with the nearest of ``theirs`` (other, lon, lat, ts) whose time is within the hours of our rounded hour: near_id, near_m, within."""
    hour = F.timestamp_seconds(F.floor((F.unix_seconds("acq") + 1800) / 3600) * 3600)
    x = ours.withColumn("_h", hour)
    pairs = proximity.space_time(x.select("id", "lon", "lat", "_h"), theirs.select("other", "lon", "lat", "ts"), radius_m, int(max_hours * 3600), "_h", "ts")
    best = pairs.groupBy("id").agg(F.min(F.struct("dist_m", F.col("r_other").alias("o"))).alias("b")).select("id", F.col("b.o").alias("near_id"), F.col("b.dist_m").alias("near_m"))
    return ours.join(best, "id", "left").withColumn("within", F.col("near_id").isNotNull())


def cells_at_objects(ours: DataFrame, hourly: DataFrame, res: float = 0.01, max_hours: float = 1.0) -> DataFrame:
    """``ours`` (id, lon, lat, acq) with the detections of the hourly cells (lon, lat, ts, detections, matched, type) of the same cell, day and hour within ``max_hours``, how many unmatched, and the cells' one type of the day or 'mixed'."""
    keys = {"_cx": F.floor(F.col("lon") / res), "_cy": F.floor(F.col("lat") / res)}
    x = ours.select("id", "lon", "lat", "acq").withColumns(keys).withColumns({"_day": F.to_date("acq"), "_h": F.hour("acq") + F.minute("acq") / 60})
    y = hourly.withColumns(keys).select("_cx", "_cy", F.to_date("ts").alias("_day"), F.hour("ts").alias("_hour"), "detections", "matched", "type")
    pairs = x.join(y, ["_cx", "_cy", "_day"]).where(F.abs(F.col("_h") - F.col("_hour")) <= max_hours)
    sums = pairs.groupBy("id").agg(F.sum("detections").alias("detections"), F.sum(F.when(F.coalesce("matched", F.lit(True)), 0).otherwise(F.col("detections"))).alias("unmatched"), F.max(F.coalesce("matched", F.lit(False))).alias("any_matched"))
    kinds = y.where("type is not null").groupBy("_cx", "_cy", "_day").agg(F.when(F.min("type") == F.max("type"), F.min("type")).otherwise("mixed").alias("day_type"))
    out = x.join(kinds, ["_cx", "_cy", "_day"], "left").select("id", "day_type").join(sums, "id", "left")
    return ours.join(out, "id").na.fill(0, ["detections", "unmatched"])


def align_prior(rows: DataFrame, prior: DataFrame, key: str, same: list[str], value: str) -> DataFrame:
    """``rows`` with prior_value and prior_status: a prior row counts only if its key is single and ``same`` agree exactly."""
    single = prior.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1")
    p = single.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in same), F.col(value).alias("_value"))
    out = rows.join(p, key, "left")
    agree = F.col("_value").isNotNull()
    for c in same:
        agree = agree & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    status = F.when(agree, "match").when(F.col("_value").isNotNull(), "position_differs").otherwise("none")
    return out.withColumns({"prior_status": status, "prior_value": F.when(agree, F.col("_value"))}).drop("_value", *(f"_{c}" for c in same))


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a key that must be single on either side; a repeated key is an error when the rows are read."""

    def single(df: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        return df.withColumn("_ok", F.when(F.col(key).isNotNull() & (n > 1), F.raise_error(F.concat(F.lit(f"{key} is not single: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).where("_ok").drop("_ok")

    return single(left).join(single(right), key, how)


def nearest_site(points: DataFrame, sites: DataFrame, key: str, reach_m: float = 500.0, radius: float = 6_371_000.0, at_lat: float = 10.0) -> DataFrame:
    """``points`` with the nearest site (site_id, lon, lat) within reach on a plane whose scale is that of ``at_lat``."""
    pairs = proximity.within(points.select(key, "lon", "lat"), sites.select("site_id", "lon", "lat"), reach_m * 1.05, earth_m=radius)
    flat = geo.equirectangular_m(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat"), F.lit(at_lat), radius)
    best = pairs.withColumn("_d", flat).where(F.col("_d") <= reach_m).groupBy(key).agg(F.min(F.struct(F.col("_d").alias("site_m"), F.col("r_site_id").alias("site_id"))).alias("b"))
    return points.join(best.select(key, "b.site_id", "b.site_m"), key, "left")


def cited_rows(full: DataFrame, lean: DataFrame, cited: DataFrame, key: str) -> DataFrame:
    """Rows of the full table that leads cite and the lean table lacks."""
    return full.join(cited.select(key).distinct(), key, "left_semi").join(lean.select(key), key, "left_anti")


def inverted_index(leads: DataFrame, lead: str, evidence: str, kind: str) -> DataFrame:
    """(id, leads): which leads cite each evidence id of the kind; ``evidence`` is an array of structs (type, id)."""
    each = leads.select(lead, F.explode(evidence).alias("e")).where(F.col("e.type") == kind)
    return each.groupBy(F.col("e.id").alias("id")).agg(F.array_sort(F.collect_set(lead)).alias("leads"))


def with_stubs(tables: list[DataFrame], referenced: DataFrame, key: str) -> DataFrame:
    """Identity rows of the first table that has a key, then of the next; referenced keys that none has become stubs."""
    out = tables[0].withColumn("origin", F.lit("table0"))
    for n, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.join(out.select(key), key, "left_anti").withColumn("origin", F.lit(f"table{n}")), allowMissingColumns=True)
    stubs = referenced.select(key).where(F.col(key).isNotNull()).distinct().join(out.select(key), key, "left_anti").withColumn("origin", F.lit("stub"))
    return out.unionByName(stubs, allowMissingColumns=True)


def nearest_valid_cell(points: DataFrame, cells: DataFrame, key: str, max_km: float) -> DataFrame:
    """``points`` with cell_no of the nearest valid cell (cell_no, lon, lat, valid) within reach, else -1."""
    out = proximity.nearest(points, cells.where("valid"), key, "cell_no", max_km * 1000)
    return out.withColumn("cell_no", F.coalesce("nearest_id", F.lit(-1).cast("long"))).drop("nearest_id", "nearest_m")


def events_with_contacts(events: DataFrame, contacts: DataFrame, km: float, hours: float) -> DataFrame:
    """Events (event_key, lon, lat, start, stop) with a contact (lon, lat, acq) within ``km`` and their padded span."""
    pad = int(hours * 3_600_000_000)
    pairs = proximity.within(events, contacts.select("lon", "lat", "acq"), km * 1000)
    ok = (_micros("r_acq") >= _micros("start") - pad) & (_micros("r_acq") <= _micros("stop") + pad)
    return events.join(pairs.where(ok).select("event_key").distinct(), "event_key", "left_semi")


def in_interval(rows: DataFrame, intervals: DataFrame, at: str, slack_s: float, key: str) -> DataFrame:
    """``rows`` with interval_id: the interval (interval_id, t0, t1) that holds the time within the slack, the earliest if several; hour buckets make it an equi-join."""
    slot = lambda c: F.floor(_micros(c) / 3_600_000_000)
    pad = F.make_dt_interval(secs=F.lit(slack_s))
    b = intervals.select("interval_id", (F.col("t0") - pad).alias("_a"), (F.col("t1") + pad).alias("_b")).withColumn("_s", F.explode(F.sequence(slot("_a"), slot("_b"))))
    hit = rows.select(key, F.col(at).alias("_t")).withColumn("_s", slot("_t")).join(b, "_s").where("_t between _a and _b")
    best = hit.groupBy(key).agg(F.min(F.struct("_a", "interval_id")).alias("_m")).select(key, F.col("_m.interval_id").alias("interval_id"))
    return rows.join(best, key, "left")


def gap_sides(contacts: DataFrame, gaps: DataFrame, max_km: float, max_h: float) -> DataFrame:
    """Per gap (event_key, off_lon, off_lat, start, on_lon, on_lat, stop): contacts near its beginning, near its end, and inside the circle between them while it lasted."""
    pad = int(max_h * 3_600_000_000)
    c = contacts.select("det_id", "lon", "lat", "acq")
    counts = []
    for side, t in (("off", "start"), ("on", "stop")):
        at = gaps.select("event_key", F.col(f"{side}_lon").alias("lon"), F.col(f"{side}_lat").alias("lat"), F.col(t).alias("_t"))
        near = proximity.within(at, c, max_km * 1000).where(F.abs(_micros("r_acq") - _micros("_t")) <= pad)
        counts.append(near.groupBy("event_key").agg(F.count("*").alias(f"n_{side}")))
    half = geo.haversine_m(F.col("off_lon"), F.col("off_lat"), F.col("on_lon"), F.col("on_lat")) / 2
    centre = gaps.withColumns({"_reach": half + max_km * 1000, "lon": (F.col("off_lon") + F.col("on_lon")) / 2, "lat": (F.col("off_lat") + F.col("on_lat")) / 2})
    # Circles of like size share a grid: a class's circles are at most twice as wide as its least.
    centre = centre.withColumn("_class", F.ceil(F.log2(F.col("_reach") / (max_km * 1000)) - 1e-9))
    between = None
    for (k,) in centre.where("_class is not null").select("_class").distinct().collect():  # no more than the doublings up to half the Earth
        part = proximity.within(centre.where(F.col("_class") == k).select("event_key", "lon", "lat", "start", "stop", "_reach"), c, max_km * 1000 * 2.0**k)
        part = part.where((F.col("dist_m") <= F.col("_reach")) & F.col("r_acq").between(F.col("start"), F.col("stop")))
        part = part.groupBy("event_key").agg(F.count("*").alias("n_between"))
        between = part if between is None else between.unionByName(part)
    out = gaps.select("event_key")
    for x in (*counts, *([between] if between is not None else [])):
        out = out.join(x, "event_key", "left")
    return out.na.fill(0)


def merge_identity(own: DataFrame, registry: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """All keys of either table: each field from the report, else from the registry, and where it came from."""
    r = registry.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in fields))
    x = own.join(r, own[key] == r["_key"], "full").withColumn(key, F.coalesce(key, "_key"))
    source = F.when(F.col("_key").isNull(), "report").when(F.coalesce(*(F.col(c).cast("string") for c in fields)).isNull(), "registry").otherwise("both")
    return x.select(key, source.alias("source"), *(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in fields))


def identity_differences(rows: DataFrame, table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``rows`` with found, and differs: the names of the fields in which the table's row says otherwise, sorted; a field that either lacks does not differ."""
    t = table.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in fields))
    x = rows.join(t, rows[key] == t["_key"], "left")
    odd = F.array_compact(F.array(*(F.when(F.col(c) != F.col(f"_{c}"), F.lit(c)) for c in sorted(fields))))
    return x.withColumns({"found": F.col("_key").isNotNull(), "differs": odd}).drop("_key", *(f"_{c}" for c in fields))
