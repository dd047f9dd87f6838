"""Queries on tables larger or denser than the test tables, as the findings of round 2 met them."""

from datetime import UTC, datetime
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pelagos.operators import around, assign, claims, dedupe, evidence, matching, proximity, rivals, scenes, temporal, tracks
from pelagos.plans import leads, registry


def _run_both(spark, folder, name):
    """The query's rows and its SQL's on the tables of a folder."""
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return registry.QUERIES[name](spark, str(folder)).toPandas(), c.execute(registry.ORACLES[name]).df()


def test_light_ids_of_more_digits_than_the_id_holds(spark, same, tmp_path):
    spark.range(999_990, 1_000_020).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got, want = _run_both(spark, tmp_path, "encode_light_ids")
    assert got["idx"].max() > 1_000_000
    same(got, want)


@pytest.mark.parametrize("name", ["bracket_interpolate", "lights_near", "events_near", "nearest_presence", "review_neighbours", "band_join_space_time", "agreement_by_box", "persistence_pairs", "sky_at_lights", "within_radius_distinct"])
def test_no_table_of_pairs(spark, sf, name):
    """Pairs, whose number grows with the square of a place's rows, are neither joined nor shuffled, and nothing is broadcast."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_leads_count_what_they_would_cite(spark, sf):
    cited = leads.build(spark, sf).select("lead_id", "n_evidence", F.size("evidence").cast("long").alias("size"), "priority").collect()
    counted = leads.build(spark, sf, cite=False)
    assert "collect_set" not in counted._jdf.queryExecution().executedPlan().toString()
    assert {(r.lead_id, r.n_evidence, r.priority) for r in counted.collect()} == {(r.lead_id, r.size, r.priority) for r in cited} == {(r.lead_id, r.n_evidence, r.priority) for r in cited}


def test_around_equals_all_pairs(spark):
    """Repeated places and ids, nulls, points beyond the radius by little, against a loop."""
    rng = np.random.default_rng(3)
    t0 = 1_700_000_000_000_000
    here = [(i, float(x), float(y), int(t)) for i, (x, y, t) in enumerate(zip(np.round(rng.normal(105, 0.05, 120), 2), np.round(rng.normal(60, 0.03, 120), 2), t0 + rng.integers(0, 4, 120) * 3_600_000_000, strict=True))]
    here += [(900, None, 60.0, t0), (901, 105.0, None, t0), (902, 105.0, 60.0, None)]
    there = [(f"r{n % 70}", lon, lat, t) for n, lon, lat, t in here[::-1]] + [(None, 105.0, 60.0, t0)]
    kind = "lon double, lat double, t timestamp"
    moment = lambda rows: [(*r[:3], None if r[3] is None else datetime.fromtimestamp(r[3] / 1e6, UTC)) for r in rows]
    a = spark.createDataFrame(moment(here), f"k long, {kind}")
    b = spark.createDataFrame(moment(there), f"id string, {kind}")
    metres = lambda p, q: float(around._haversine(p[1], p[2], q[1], q[2], 6371008.8))
    near = {p[0]: [(metres(p, q), q) for q in there if None not in (p[1], p[2], q[1], q[2]) and metres(p, q) <= 3000] for p in here}
    got = {r.k: r for r in around.nearest(a, b.dropna(subset=["id"]), "id", 3000).collect()}
    for p in here:
        best = min(((d, q[0]) for d, q in near[p[0]] if q[0]), default=(None, None))
        assert got[p[0]].nearest_id == best[1] and (best[0] is None or abs(got[p[0]].nearest_m - best[0]) < 1e-6)
    seen = {r.k: r.ids for r in around.in_span(a, b, "t", "id", "t", "t", 3000, 3_600_000_000, "ids").collect()}
    assert len(got) == len(seen) == len(here)
    for p in here:
        assert seen[p[0]] == sorted({q[0] for _, q in near[p[0]] if q[0] and p[3] is not None and q[3] is not None and abs(p[3] - q[3]) <= 3_600_000_000})
    n = {r.k: r.n for r in around.count_different(a, b, "id", 3000, "n").collect()}
    assert n == {p[0]: len({q[0] for _, q in near[p[0]] if q[0]}) for p in here}
    assert n == {r.k: r.n for r in around.in_span(a.withColumn("t", F.lit("2023-11-15").cast("timestamp")), b.na.drop(subset=["id"]).withColumn("t", F.lit("2023-11-15").cast("timestamp")), "t", "id", "t", "t", 3000, 0, "n", count=True).collect()}


def test_channels_of_one_place(spark):
    """Four thousand objects in two places of a scene: sixteen million pairs at the places, none of them made."""
    vv = spark.range(4000).select(F.lit(1).alias("scene"), "id", (F.col("id") % 2 * 50.0).alias("row"), F.lit(3.0).alias("col"), F.col("id").cast("double").alias("length_m"))
    vh = vv.withColumn("id", F.col("id") + 10_000).withColumn("row", F.col("row") + 1)
    out = evidence.fuse_channels(vv, vh, "scene")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 3
    got = {r.pol_class: r["count"] for r in out.groupBy("pol_class").count().collect()}
    assert got == {"VV+VH": 2, "VV only": 3998, "VH only": 3998}
    assert {(r.id, r.h_id, r.length_m) for r in out.where("pol_class = 'VV+VH'").collect()} == {(0, 10_000, 0.0), (1, 10_001, 1.0)}


def test_a_component_wider_than_a_table(monkeypatch, spark):
    """A chain whose table of rows and columns would exceed the limit, while its pairs do not."""
    monkeypatch.setattr(assign, "MOST_CELLS", 1000)
    pairs = [(a, b, float((a * 7 + b * 13) % 17)) for a in range(300) for b in (a, a + 1, a + 2)]
    got = assign.optimal(spark.createDataFrame(pairs, "ia long, ib long, cost double"), 12.0).collect()
    assert len({r.ia for r in got}) == len({r.ib for r in got}) == len(got)
    # The chain by dynamic programming over which of the next two columns are taken.
    best = {(False, False): 0.0}
    cost = {(a, b): c for a, b, c in pairs if c <= 12}
    for a in range(300):
        nxt: dict = {}
        for (x, y), c in best.items():
            free = [not x, not y, True]
            for k in (None, 0, 1, 2):
                if k is None or (free[k] and (a, a + k) in cost):
                    state = (y or k == 1, k == 2)
                    nxt[state] = min(nxt.get(state, 1e9), c + (12.0 if k is None else cost[a, a + k]))
        best = nxt
    assert sum(r.cost for r in got) + 12.0 * (300 - len(got)) == pytest.approx(min(best.values()))


def test_works_of_one_title_are_compared_by_kind(spark):
    """Repeated records give links in proportion to their number, with every record's reason."""
    n = 600
    one = spark.range(n).select("id", F.lit(None).cast("string").alias("doi"), F.lit("A long enough title of a work on the sea").alias("title"), (F.lit(2015) + F.col("id") % 2).alias("year"), F.when(F.col("id") % 3 == 0, "preprint").otherwise("article").alias("kind"), F.lit("Sea").alias("venue"), F.lit(None).cast("string").alias("source_type"), F.lit("Nguyen An").alias("author"), F.lit(1).alias("cited"))
    assert dedupe.work_edges(one).count() < 6 * n
    got = dedupe.dedupe_works(one).collect()
    assert {r.survivor for r in got} == {2} and all(r.reason == "same_title_year" for r in got if r.id != 2)


def test_points_of_one_place_pair_off_first(monkeypatch, spark, tmp_path):
    """Sixty contacts and sixty reports on one spot, which no task may hold as pairs; elsewhere the total is that over all pairs."""
    period = 2_534_250  # ids this far apart lie on one spot
    monkeypatch.setattr(assign, "MOST_CELLS", 1000)
    when = F.lit("2024-01-01").cast("timestamp")
    spark.range(60).select((F.col("id") * period * 7).alias("l_orderkey"), F.lit(0).alias("l_linenumber"), when.alias("l_shipdate"), *(F.lit(1.0).alias(c) for c in ("l_quantity", "l_discount", "l_tax")), F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.lit(1).alias("l_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(60).select((F.col("id") * period).alias("event_id"), F.col("id").alias("user_id"), when.alias("ts"), F.lit(1.0).alias("value"), F.lit("x").alias("event_type")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["optimal_assignment"](spark, str(tmp_path)).collect()
    assert len(got) == len({r.ia for r in got}) == len({r.ib for r in got}) == 60 and {r.cost for r in got} == {0.0}
    rng = np.random.default_rng(11)
    points = lambda name, n: spark.createDataFrame([(i, 100 + float(x) / 250, float(y) / 250) for i, (x, y) in enumerate(rng.integers(0, 7, (n, 2)))] + [(n, None, 1.0)], f"{name} long, lon double, lat double")
    monkeypatch.undo()
    a, b = points("ia", 60).repartition(3), points("ib", 70)
    got = assign.optimal_places(a.unionByName(a), b, 700.0).collect()
    assert len(got) == len({r.ia for r in got}) == len({r.ib for r in got})
    near = proximity.within(a, b, 700.0)
    want = assign.optimal(near.select("ia", F.col("r_ib").alias("ib"), F.col("dist_m").alias("cost")), 700.0).collect()
    total = lambda rows: sum(r.cost for r in rows) - 700.0 * len(rows)
    assert total(got) == pytest.approx(total(want), rel=1e-9) and any(r.cost > 0 for r in got)


def test_the_rest_of_a_greedy_assignment_is_walked(monkeypatch, spark):
    """One walk, or rounds before it, give the same pairs."""
    rng = np.random.default_rng(5)
    pairs = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in rng.integers(0, 12, (300, 3))], "ia long, ib long, cost double")
    walked = {tuple(r) for r in assign.greedy(pairs).collect()}
    monkeypatch.setattr(assign, "WALKED", 20)
    assert walked == {tuple(r) for r in assign.greedy(pairs).collect()}
    assert walked == {tuple(r) for r in assign.greedy(pairs, max_rounds=40).collect()}


def test_places_of_vessels_are_worked_out_once_a_scene(monkeypatch, spark):
    """Fifty contacts of a scene among twenty vessels: twenty places, not a thousand; the pairs are those of the walk."""
    asked = []
    own = tracks.track_position
    monkeypatch.setattr(tracks, "track_position", lambda t, at, *rest: asked.append(at.count()) or own(t, at, *rest))
    rng = np.random.default_rng(2)
    t = datetime(2024, 1, 15, 6, 10, tzinfo=UTC)
    c = [(f"K{i}", i, 105 + float(x) / 1000, 10 + float(y) / 1000, t) for i, (x, y) in enumerate(rng.integers(0, 40, (50, 2)))]
    p = [(i, i, t, 105 + float(x) / 1000, 10 + float(y) / 1000) for i, (x, y) in enumerate(rng.integers(0, 40, (20, 2)))]
    got = tracks.pair_presence(spark.createDataFrame(c, "det_id string, ia long, lon double, lat double, acq timestamp"), spark.createDataFrame(p, "vessel long, ib long, ts timestamp, lon double, lat double")).collect()
    assert asked == [20]
    metres = lambda a, b: float(around._haversine(a[2], a[3], b[3], b[4], 6371008.8))
    want, used = {}, set()
    for d, i, j in sorted((metres(a, b), a[1], b[1]) for a in c for b in p if metres(a, b) <= 3000):
        if i not in want and j not in used:
            want[i] = j
            used.add(j)
    assert {r.det_id: r.vessel for r in got} == {f"K{i}": j for i, j in want.items()} and len(want) > 10


def test_rivals_without_a_table_of_pairs(spark, sf):
    """No join of contacts with vessels; ties, repeated places, nulls and several tiles give what the table of pairs gives."""
    plan = registry.QUERIES["pair_ambiguity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "_col" in line]
    rng = np.random.default_rng(7)
    pick = lambda options, n: [options[k] for k in rng.integers(0, len(options), n)]
    place = lambda n: [(105 + float(x) / 250, 10 + float(y) / 250) for x, y in rng.integers(0, 60, (n, 2))]
    c = [(i % 2, f"K{i}", *xy, length, grade) for i, (xy, length, grade) in enumerate(zip(place(900), pick([None, 20.0, 120.0], 900), pick([None, "fixed", "high"], 900), strict=True))]
    c += [(0, "lost", None, 10.0, 20.0, "high"), (None, "adrift", 105.0, 10.0, 20.0, "high")]
    v = [(i % 2, 201_000_000 + i, *xy, "interp", 1.0, sog, speed, length) for i, (xy, sog, speed, length) in enumerate(zip(place(900), pick([None, 0.0, 9.0], 900), pick([None, 3.0], 900), pick([None, 0.0, 60.0, 300.0], 900), strict=True))]
    contacts = spark.createDataFrame(c, "scene_id long, det_id string, lon double, lat double, length_m double, confidence string")
    placed = spark.createDataFrame(v, "scene_id long, mmsi long, lon double, lat double, method string, dt_s double, sog_kn double, speed_kn double, length_m double")
    pairs = matching.candidate_pairs(contacts, placed)
    first = lambda key, other: F.row_number().over(Window.partitionBy("scene_id", key).orderBy("dist_m", other)) == 1
    taken = pairs.withColumn("_a", first("det_id", "mmsi")).withColumn("_b", first("mmsi", "det_id")).where("_a and _b").select("scene_id", "det_id", "mmsi", "dist_m")
    shape = lambda df: sorted((r.scene_id, r.det_id, r.mmsi, r.ambiguous, r.alt_dist_m and round(r.alt_dist_m, 6), r.candidates) for r in df.collect())
    want = shape(matching.ambiguity(pairs, taken))
    assert len(want) > 200 and {r[3] for r in want} == {True, False}
    assert shape(rivals.ambiguous_pairs(contacts, placed, tile=0.05)) == shape(rivals.ambiguous_pairs(contacts, placed)) == want


def test_presence_pairs_look_at_every_contact(spark, sf):
    """The query pairs contacts whatever their number, not those of one number in twenty."""
    got = registry.QUERIES["presence_pairs"](spark, sf).collect()
    assert len(got) == len({r.det_id for r in got}) == len({r.vessel for r in got})
    assert any(int(r.det_id[1:]) % 20 for r in got)


@pytest.mark.parametrize("claimed", [1, 16])
def test_claims_give_the_walk_over_all_pairs(monkeypatch, spark, claimed):
    """Vessels and contacts of repeated places in two scenes, with few contacts for many vessels and the reverse, against a walk over all pairs."""
    monkeypatch.setattr(claims, "CLAIMS", claimed)
    rng = np.random.default_rng(13)
    t = [datetime(2024, 1, 15, h, 10, tzinfo=UTC) for h in (6, 7)]
    place = lambda n, wide: [(105 + float(x) / 1000, 10 + float(y) / 1000) for x, y in rng.integers(0, wide, (n, 2))]
    for n, m in ((150, 40), (25, 90)):
        c = [(i, t[i % 2], *xy) for i, xy in enumerate(place(n, 60))]
        v = [(j, at, *xy, j % 3 / 10, place(2, 60)) for j in range(m) for at, xy in zip(t, place(2, 60), strict=True)]
        metres = lambda a, b: float(around._haversine(*a, *b, 6371008.8))
        pairs = sorted((metres(x[2:], y[2:4]) / 1000 + y[4], x[0], y[0]) for x in c for y in v if x[1] == y[1] and metres(x[2:], y[2:4]) <= 3000 and any(metres(x[2:], p) <= 2500 for p in y[5]))
        want, used = {}, set()
        for _, i, j in pairs:
            if i not in want and j not in used:
                want[i] = j
                used.add(j)
        a = spark.createDataFrame([*c, (n, None, 105.0, 10.0), (None, t[0], 105.0, 10.0)], "ia long, acq timestamp, lon double, lat double")
        b = spark.createDataFrame([*v, (m, t[0], None, 10.0, 0.0, [(105.0, 10.0)])], "ib long, acq timestamp, lon double, lat double, slow double, own array<struct<lon:double,lat:double>>")
        got = claims.cheapest_first(a, b, 3000.0, 2500.0).collect()
        assert {r.ia: r.ib for r in got} == want and len(got) == len(want) > 20


def test_a_few_nearest_give_the_least_cost_of_all():
    """Rows that know only their first one or two columns reach the total that all pairs give."""
    rng = np.random.default_rng(17)
    looked = []
    for n, m, few in [(6, 4, 1), (4, 6, 1), (40, 25, 2), (25, 60, 2), (60, 60, 1)]:
        for _ in range(20):
            price = np.where(rng.random((n, m)) < 0.5, rng.integers(0, 30, (n, m)), np.inf)
            gate = rng.integers(10, 25, n).astype(float)
            price[price > gate[:, None]] = np.inf
            every = [[j for j in np.lexsort((np.arange(m), p)) if np.isfinite(p[j])] for p in price]
            whole = lambda i: looked.append(i) or ([int(j) for j in every[i]], [float(price[i, j]) for j in every[i]], float("inf"))  # noqa: E731, B023
            start = [(whole(i)[0][:few], whole(i)[1][:few], whole(i)[1][few - 1] if len(every[i]) > few else float("inf")) for i in range(n)]
            looked.clear()
            pick = scenes.cheapest(start, gate.tolist(), m, whole)
            assert len({j for j in pick if j >= 0}) == sum(j >= 0 for j in pick)
            first = np.cumsum([0, *map(len, every)]).tolist()
            to = [int(j) for e in every for j in e]
            want = assign._shortest_paths(first, to, [float(price[i, j]) for i in range(n) for j in every[i]], gate.tolist())
            total = lambda taken: sum(price[i, j] if j >= 0 else gate[i] for i, j in enumerate(taken))  # noqa: E731, B023
            assert total(pick) == total([to[e] if e >= 0 else -1 for e in want]) < np.inf
    assert looked


def test_scenes_are_matched_without_a_table_of_pairs(monkeypatch, spark, sf):
    """The query makes no pairs; repeated places, nulls and crowded scenes give the least total and the judgement that the table of pairs gives."""
    pairs_of = matching.candidate_pairs
    monkeypatch.setattr(matching, "candidate_pairs", None)
    assert registry.QUERIES["match_scenes"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    rng = np.random.default_rng(19)
    pick = lambda options, n: [options[k] for k in rng.integers(0, len(options), n)]
    place = lambda n: [(105 + float(x) / 250, 10 + float(y) / 250) for x, y in rng.integers(0, 12, (n, 2))]
    c = [(i % 2, f"K{i}", *xy, length, grade) for i, (xy, length, grade) in enumerate(zip(place(260), pick([None, 20.0, 120.0], 260), pick([None, "fixed", "high"], 260), strict=True))]
    c += [(0, "lost", None, 10.0, 20.0, "high"), (None, "adrift", 105.0, 10.0, 20.0, "high"), (7, "alone", 105.0, 10.0, 20.0, "high")]
    v = [(i % 2, 201_000_000 + i, *xy, "interp", float(i % 400), sog, speed, length) for i, (xy, sog, speed, length) in enumerate(zip(place(300), pick([None, 0.0, 9.0], 300), pick([None, 3.0], 300), pick([None, 0.0, 60.0, 300.0], 300), strict=True))]
    contacts = spark.createDataFrame(c, "scene_id long, det_id string, lon double, lat double, length_m double, confidence string")
    placed = spark.createDataFrame(v, "scene_id long, mmsi long, lon double, lat double, method string, dt_s double, sog_kn double, speed_kn double, length_m double")
    got = scenes.matched(contacts, placed).collect()
    assert sorted(r.det_id for r in got) == sorted(x[1] for x in c)
    pairs = pairs_of(contacts, placed)
    near = {(r.det_id, r.mmsi): r for r in pairs.collect()}
    # With limits below zero no rival counts, so nothing is held back and the vessels show.
    bold = matching.Match(margin_m=-1e9, ratio=-1.0)
    taken = [(r.scene_id, r.det_id, r.mmsi, r.dist_m) for r in scenes.matched(contacts, placed, bold).collect() if r.mmsi is not None]
    assert len(taken) == len({x[1] for x in taken}) == len({x[2] for x in taken}) > 150
    total = lambda rows: sum(d - near[k, j].gate_m for _, k, j, d in rows)
    want = [(r.scene_id, r.det_id, r.mmsi, r.dist_m) for r in assign.least_cost(pairs, ["scene_id"], "mmsi", "det_id", "dist_m", "gate_m").collect()]
    assert total(taken) == pytest.approx(total(want), abs=1e-6)
    judged = {r.det_id: (r.ambiguous, r.alt_dist_m and round(r.alt_dist_m, 6), r.candidates) for r in matching.ambiguity(pairs, spark.createDataFrame(taken, "scene_id long, det_id string, mmsi long, dist_m double")).collect()}
    assert {r.det_id: (r.ambiguous, r.alt_dist_m and round(r.alt_dist_m, 6), r.candidates) for r in got if r.det_id in judged} == judged and {x[0] for x in judged.values()} == {True, False}
    assert all(not r.ambiguous and r.mmsi is None for r in got if r.det_id not in judged)


@pytest.mark.parametrize("slots", [1, 8])
def test_brackets_across_the_ends_of_buckets(monkeypatch, spark, slots):
    """Reports go to one bucket, or to two near an end; equal times, targets at reports and times before 1970 give what a loop gives."""
    monkeypatch.setattr(temporal, "SLOTS", slots)
    rng = np.random.default_rng(23)
    at = lambda s: datetime.fromtimestamp(int(s), UTC)
    points = [(int(k), n, int(t), float(n), float(-n)) for n, (k, t) in enumerate(zip(rng.integers(0, 6, 300), rng.integers(-40, 80, 300) * 600, strict=True))]
    asked = [(n, int(t) * 300) for n, t in enumerate(rng.integers(-90, 170, 60))]
    p = spark.createDataFrame([(k, e, at(t), lon, lat) for k, e, t, lon, lat in points] + [(1, 900, None, 0.0, 0.0)], "k long, e long, ts timestamp, lon double, lat double")
    a = spark.createDataFrame([(n, at(t)) for n, t in asked] + [(900, None)], "n long, at timestamp")
    want = {}
    for n, now in asked:
        for k in range(6):
            before = min(((now - t, e, lon, lat) for v, e, t, lon, lat in points if v == k and 0 <= now - t <= 1800), default=None)
            after = min(((t - now, e, lon, lat) for v, e, t, lon, lat in points if v == k and 0 < t - now <= 1800), default=None)
            if before and after and before[0] <= 1200 and after[0] <= 1200:
                share = before[0] / (before[0] + after[0])
                want[n, k] = (round(before[2] + share * (after[2] - before[2]), 6), "interpolated")
            elif before or after:
                want[n, k] = (min(x for x in (before and (before[0], 0, before[2]), after and (after[0], 1, after[2])) if x)[2], "nearest")
    got = temporal.bracket(p, a, "k", "ts", "at", "e", 1800, 1200.0).collect()
    assert {(r.n, r.k): (round(r.lon, 6), r.method) for r in got} == want and len(got) == len(want) and {m for _, m in want.values()} == {"interpolated", "nearest"}


@pytest.mark.parametrize("name", ["lights_near", "events_near"])
def test_searches_carry_what_the_result_needs(spark, sf, name):
    """Of a contact only its id, place and time are shuffled."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "cnn_score" not in plan and "wind_ms" not in plan
