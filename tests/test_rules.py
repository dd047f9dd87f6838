"""Rules and joins on small made-up cases."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pelagos.functions import parsers, scalars
from pelagos.operators import assign, evidence, leads, matching, passages, temporal


def test_passages_without_long_words_and_at_the_edges(spark):
    docs = spark.createDataFrame([(1, "xx prefixsome words hereby and so onsuffix yy"), (2, "日本語 の 文章 です"), (3, "a b"), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "some words hereby and so on"), (11, "の 文章 で"), (12, "a b"), (13, ""), (14, None), (15, "not there at all")], "item_id long, text string")
    got = {tuple(r) for r in passages.containing(docs, items).collect()}
    assert got == {(1, 10), (2, 11), (3, 12)}


def test_nearest_in_time_keeps_rows_with_nulls(spark):
    left = spark.createDataFrame([(1, None, "2024-01-01 10:00:00"), (2, "x", "2024-01-01 12:00:00"), (3, None, None), (1, None, "2024-01-01 10:00:00")], "id long, other string, t string").withColumn("t", F.col("t").cast("timestamp"))
    right = spark.createDataFrame([(7, "2024-01-01 10:00:30"), (6, "2024-01-01 09:59:30"), (8, "2024-01-01 11:00:00"), (9, None)], "rid long, u string").withColumn("u", F.col("u").cast("timestamp"))
    got = sorted((r.id, r.near_id, r.near_dt_s) for r in temporal.nearest_in_time(left, right, "t", "u", "rid", 1800).collect())
    assert got == [(1, 6, 30.0), (1, 6, 30.0), (2, None, None), (3, None, None)]


@pytest.mark.parametrize("k,mean", [(0, 0.5), (3, 2.0), (399, 400.0), (401, 400.0), (1000, 900.0), (100_000, 100_400.0), (5, 5000.0), (9000, 5000.0)])
def test_poisson_of_large_counts(spark, k, mean):
    got = spark.range(1).select(scalars.poisson_cdf(F.lit(k).cast("long"), F.lit(mean)).alias("p")).first().p
    want = min(1.0, math.fsum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k + 1)))
    assert got == pytest.approx(want, rel=1e-7, abs=1e-12)


def test_least_cost_against_all_assignments(spark):
    rng = random.Random(3)
    rows = []
    for scene in range(12):
        for a, b in itertools.product(range(rng.randrange(1, 5)), range(rng.randrange(1, 5))):
            if rng.random() < 0.7:
                rows.append((scene, a, b, float(rng.randrange(1, 30)), 10.0 + 5 * a))
    got = {}
    for r in assign.least_cost(spark.createDataFrame(rows, "scene long, a long, b long, cost double, gate double"), ["scene"], "a", "b", "cost", "gate").collect():
        got.setdefault(r.scene, []).append((r.a, r.b, r.cost))
    for scene in range(12):
        own = {(a, b): c for s, a, b, c, g in rows if s == scene and c <= g}
        gates = {a: g for s, a, _, _, g in rows if s == scene}
        if not own:
            assert scene not in got
            continue
        left, right = sorted(gates), sorted({b for _, b in own})
        least = min(sum(own.get((a, b), gates[a] if b is None else 1e9) for a, b in zip(left, pick, strict=True)) for pick in itertools.permutations([*right, *[None] * len(left)], len(left)))
        mine = got.get(scene, [])
        assert len({a for a, _, _ in mine}) == len({b for _, b, _ in mine}) == len(mine)
        assert sum(c for _, _, c in mine) + sum(gates[a] for a in left if a not in {x for x, _, _ in mine}) == pytest.approx(least)


def test_a_component_that_is_too_large_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(assign, "MOST_CELLS", 3)
    pairs = spark.createDataFrame([(a, b, 1.0) for a in range(2) for b in range(2)], "ia long, ib long, cost double")
    with pytest.raises(Exception, match="too large"):
        assign.optimal(pairs, 5.0).collect()


def test_rafted_vessels_are_ambiguous_and_a_clear_pair_is_not(spark):
    pairs = spark.createDataFrame([(1, "a", 11, 100.0), (1, "a", 12, 120.0), (1, "b", 13, 50.0), (1, "b", 12, 400.0), (1, "c", 14, 30.0), (1, "c", 15, 60.0), (1, "d", 15, 10.0)], "scene_id long, det_id string, mmsi long, dist_m double")
    taken = spark.createDataFrame([(1, "a", 11, 100.0), (1, "b", 13, 50.0), (1, "c", 14, 30.0), (1, "d", 15, 10.0)], "scene_id long, det_id string, mmsi long, dist_m double")
    got = {r.det_id: (r.ambiguous, r.alt_dist_m, r.candidates) for r in matching.ambiguity(pairs, taken).collect()}
    assert got["a"] == (True, 120.0, "11;12") and got["b"][0] is False
    assert got["c"] == (True, 60.0, "14;15")  # the other vessel's own pair is nearer, but not by a clear margin
    assert got["d"][0] is True


def test_speed_aware_gate(spark):
    row = spark.range(1).select(*(matching.gate_metres(F.lit(x).cast("double")).alias(f"g{i}") for i, x in enumerate((None, 0.0, 10.0, 60.0)))).first()
    assert row.g0 == 2000.0 and row.g1 == 500.0 and row.g2 == pytest.approx(500 + 125 * 10 * 0.514444) and row.g3 == 2000.0


def test_factor_points_sum_clip_and_bands(spark):
    cols = "cnn_score double, both boolean, wind_ms double, deep_convection boolean, n_lights int, n_events int, ais_reach double, n_ais_10km int, n_persist int, region_box string"
    df = spark.createDataFrame([(1.0, True, 3.0, False, 1, 1, 1.0, 99, 1, "x"), (None, None, None, None, 0, 0, None, None, 0, "other"), (0.75, False, 12.0, False, 0, 2, 0.5, 5, 0, "x")], cols)
    got = leads.with_priority(leads.contact_points(df, {"x": 40})).collect()
    assert [r.priority for r in got] == [100, 0, 10 + 10 + 6 + 4 + 10]
    assert [r.priority_band for r in got] == ["high", "low", "medium"]


def test_a_repeated_key_is_an_error(spark):
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string"), spark.createDataFrame([(1, "c"), (1, "d")], "k long, y string")
    assert evidence.one_to_one(one, one.select("k"), "k").count() == 2
    with pytest.raises(Exception, match="not single"):
        evidence.one_to_one(one, two, "k").collect()


def test_negative_positions_are_skipped(spark):
    row = spark.createDataFrame([('{"a": [0], "b": [-4, 1]}',)], "x string").select(parsers.abstract_of(F.col("x")).alias("t")).first()
    assert row.t == "a b"


@pytest.mark.parametrize("chunk", [2_000_000, 50, 7])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, chunk):
    """Numbers and texts, contracted at once, in pieces, and by rounds alone, against a walk."""
    from pelagos.operators import graph

    monkeypatch.setattr(graph, "CHUNK", chunk)
    rng = random.Random(chunk)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (None, 3)]
    near = {}
    for a, b in pairs:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        stack = [n]
        while stack and n not in want:
            stack, seen = [n], {n}
            while stack:
                for m in near[stack.pop()] - seen:
                    seen.add(m)
                    stack.append(m)
            want.update(dict.fromkeys(seen, min(seen)))
    frame = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.root for r in graph.connected_components(frame).collect()} == want
    text = frame.select(F.lpad(F.col("a").cast("string"), 4, "0").alias("a"), F.lpad(F.col("b").cast("string"), 4, "0").alias("b"))
    assert {int(r.node): int(r.root) for r in graph.connected_components(text).collect()} == want
