"""Operators on small fixtures: edge rules, ties, nulls, empty frames, and brute force where SQL has no say."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pelagos.functions import geo, scalars
from pelagos.operators import aggregate, assign, dedupe, filters, graph, paging, proximity, temporal


def test_components_chain_star_and_nulls(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (10, 12), (10, 13), (20, 20), (None, 5), (4, 1)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 13: 10}


def test_components_random_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_greedy_equals_the_walk(spark):
    rng = random.Random(5)
    pairs = list({(rng.randrange(30), rng.randrange(30)): rng.randrange(8) / 2 for _ in range(200)}.items())
    rows = [(a, b, c) for (a, b), c in pairs] + [(None, 1, 0.0)]
    got = sorted((r.ia, r.ib, r.cost) for r in assign.greedy(spark.createDataFrame(rows, "ia long, ib long, cost double")).collect())
    used_a, used_b, want = set(), set(), []
    for c, a, b in sorted((c, a, b) for (a, b), c in pairs):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.append((a, b, c))
    assert got == sorted(want)


def test_optimal_cost_against_all_assignments(spark):
    rng = random.Random(7)
    rows, want = [], 0.0
    for block in range(6):
        own = [(block * 10 + a, block * 10 + b, float(rng.randrange(1, 12))) for a, b in itertools.product(range(3), range(3)) if rng.random() < 0.8]
        rows += own
        near = [p for p in own if p[2] <= 9]
        want += assign.brute_force_cost(near, 9.0) if near else 0
    frame = spark.createDataFrame(rows, "ia long, ib long, cost double")
    got = assign.optimal(frame, 9.0).collect()
    assert len({r.ia for r in got}) == len(got) == len({r.ib for r in got})
    linked = {a for a, _, c in rows if c <= 9}
    assert sum(r.cost for r in got) + 9.0 * (len(linked) - len(got)) == pytest.approx(want)


def test_within_against_brute_force(spark):
    rng = random.Random(1)
    a = [(i, rng.uniform(99, 101), rng.uniform(60, 62)) for i in range(80)] + [(99, None, 1.0)]
    b = [(i, rng.uniform(99, 101), rng.uniform(60, 62)) for i in range(80)]
    left, right = spark.createDataFrame(a, "id long, lon double, lat double"), spark.createDataFrame(b, "id long, lon double, lat double")
    got = {(r.id, r.r_id) for r in proximity.within(left, right, 15_000).collect()}
    cross = left.crossJoin(right.toDF("r_id", "r_lon", "r_lat")).where(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat")) <= 15_000)
    assert got == {(r.id, r.r_id) for r in cross.collect()} and got


def test_session_starts_only_beyond_the_gap(spark):
    rows = [(1, 0, 1), (1, 1800, 2), (1, 3601, 3), (2, 0, 4)]
    df = spark.createDataFrame(rows, "k long, t long, id long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.id: r.session for r in temporal.sessionise(df, ["k"], "ts", 1800, "id").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1}


def test_bins_closed_on_either_side(spark):
    df = spark.createDataFrame([(25.0,), (50.0,), (0.0,), (None,)], "x double")
    left = [r[0] for r in df.select(scalars.length_bin(F.col("x"), [0, 25, 50])).collect()]
    right = [r[0] for r in df.select(scalars.length_bin(F.col("x"), [0, 25, 50], "right")).collect()]
    assert left == ["25-50", None, "0-25", None] and right == ["0-25", "25-50", None, None]


def test_wilson_and_unknowns(spark):
    low, high = scalars.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(5, 10), (0, 0)], "k long, n long").select(low.alias("a"), high.alias("b")).collect()
    assert r[0].a == pytest.approx(0.23659, abs=1e-5) and r[0].b == pytest.approx(0.76341, abs=1e-5) and r[1].a is None


def test_waterfall_counts_unknown_as_failed(spark):
    df = spark.createDataFrame([(True, True), (True, None), (False, True)], "a boolean, b boolean")
    r = aggregate.waterfall(df, {"a": F.col("a"), "b": F.col("b")}).first()
    assert r.asDict() == {"n_all": 3, "left_a": 2, "fail_a": 1, "left_b": 1, "fail_b": 1}


def test_parameters_are_refused():
    for bad in ("1,2,3", "a,b,c,d", "5,0,1,1"):
        with pytest.raises(filters.BadParameter):
            filters.parse_bbox(bad)
    assert filters.parse_bool("yes") is True and filters.parse_bool("") is None
    with pytest.raises(filters.BadParameter):
        filters.parse_bool("perhaps")


def test_order_puts_nulls_last_either_way(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7), (4, 5)], "id long, x long")
    assert [r.id for r in paging.order_by(df, "-x", ("x",), "id").collect()] == [3, 2, 4, 1]
    assert [r.id for r in paging.page(paging.order_by(df, "x", ("x",), "id"), 2, 1).collect()] == [4, 3]
    with pytest.raises(filters.BadParameter):
        paging.order_by(df, "y", ("x",), "id")


def test_conform_drops_nan_and_adds_columns(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, extra long")
    rows = paging.conform(df, {"x": "double", "y": "string"}).collect()
    assert [(r.x, r.y) for r in rows] == [(None, None), (2.0, None)]


def test_resolve_takes_the_first_reason_and_best_rank(spark):
    rows = [(1, "a", "t", 2020), (2, "a", "u", 2019), (3, "b", "u", 2021), (4, None, None, 2000), (5, "c", "z", 2001)]
    df = spark.createDataFrame(rows, "id long, doi string, title string, year long")
    got = {r.id: (r.survivor, r.reason) for r in dedupe.resolve(df, "id", [("doi", F.col("doi")), ("title", F.col("title"))], [F.col("year")]).collect()}
    assert got == {1: (2, "doi"), 2: (2, "doi"), 3: (2, "title"), 4: (4, None), 5: (5, None)}


def test_issn_and_titles(spark):
    d = spark.createDataFrame([("0378595",), ("2434561",)], "d string").select(scalars.issn_check_digit(F.col("d"))).collect()
    assert [r[0] for r in d] == ["5", "X"]
    t = spark.createDataFrame([("A <i>Big</i>  Title!",)], "t string").select(scalars.normalise_title(F.col("t"))).first()[0]
    assert t == "a big title"


def test_polygon(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    df = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (-1.0, 5.0)], "lon double, lat double")
    assert [r[0] for r in df.select(geo.in_polygon(F.col("lon"), F.col("lat"), square)).collect()] == [True, False, False]
