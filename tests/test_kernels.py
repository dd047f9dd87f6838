"""Array kernels and fitted models against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagos.operators import kernels as k
from pelagos.operators import models as m


def test_box_sums_and_gamma_limit():
    x = np.random.default_rng(1).random((23, 17))
    got = k.box_sum(x, 5)
    for r in range(23):
        for c in range(17):
            assert got[r, c] == pytest.approx(x[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3].sum())
    assert k.gamma_limit(1e-6, 1.0) == pytest.approx(-math.log(1e-6), rel=1e-9)
    two = k.gamma_limit(1e-4, 2.0) * 2  # (1 + x) exp(-x) is the upper tail for two looks
    assert (1 + two) * math.exp(-two) == pytest.approx(1e-4, rel=1e-9)


def scene(seed=2, size=120):
    rng = np.random.default_rng(seed)
    image = rng.gamma(4.4, 1 / 4.4, (size, size)).astype("<f4")
    for r, c in ((30, 40), (70, 71), (95, 20), (60, 60)):
        image[r : r + 3, c : c + 5] = 60
    return image


def test_objects_are_found_and_tiles_agree_with_the_whole(spark):
    image, valid, margin, step = scene(), np.ones((120, 120), bool), 20, 40
    hit, mean = k.cfar(image, valid, 9, 31)
    found = k.objects(hit, image, mean)
    assert sorted((round(o["row"]), round(o["col"])) for o in found) == [(31, 42), (61, 62), (71, 73), (96, 22)] and all(o["n_pixels"] == 15 and o["length_m"] == pytest.approx(50) for o in found)
    padded, known = np.pad(image, margin), np.pad(valid, margin)
    rows = []
    for r in range(0, 120, step):
        for c in range(0, 120, step):
            part = (slice(r, r + step + 2 * margin), slice(c, c + step + 2 * margin))
            rows.append((1, r, c, step + 2 * margin, step + 2 * margin, bytearray(padded[part].astype("<f4").tobytes()), bytearray(known[part].astype(np.uint8).tobytes())))
    tiles = spark.createDataFrame(rows, "scene long, tile_row long, tile_col long, height int, width int, pixels binary, valid binary")
    got = sorted((round(r.row, 6), round(r.col, 6), r.n_pixels) for r in k.tile_objects(tiles, margin, guard=9, background=31).collect())
    assert got == sorted((round(o["row"], 6), round(o["col"], 6), o["n_pixels"]) for o in found)
    assert 3 < k.looks_of(image, valid) < 9


def test_a_point_of_light_is_found_and_an_edge_is_not(spark):
    rng = np.random.default_rng(3)
    image = (0.3 + 0.02 * rng.standard_normal((40, 40))).astype("<f4")
    image[12, 30] = 9
    image[:, 5] = 8  # an edge: bright neighbours along it
    got = k.spikes(image, np.ones((40, 40), bool))
    assert [(s["row"], s["col"]) for s in got] == [(12, 30)]
    tiles = spark.createDataFrame([(4, 100, 200, 40, 40, bytearray(image.tobytes()), bytearray(np.ones((40, 40), np.uint8).tobytes()))], "scene long, tile_row long, tile_col long, height int, width int, pixels binary, valid binary")
    assert [(r.row, r.col) for r in k.tile_spikes(tiles, 0).collect()] == [(112, 230)]


def test_chips_are_scored_in_batches(spark):
    chips = spark.createDataFrame([(i, bytearray(np.full((4, 4), i, "<f4").tobytes())) for i in range(10)], "id long, pixels binary")
    got = {r.id: r.score for r in k.score_chips(chips, lambda x: x.mean((1, 2)), 4, batch=3).collect()}
    assert got == {i: float(i) for i in range(10)}


def test_poisson_regression_against_newton(spark):
    rng = np.random.default_rng(4)
    x, e = rng.normal(size=(400, 2)), rng.uniform(1, 5, 400)
    y = rng.poisson(e * np.exp(-0.5 + 0.4 * x[:, 0] - 0.2 * x[:, 1]))
    z, beta = np.column_stack([np.ones(400), x]), np.zeros(3)
    for _ in range(50):
        mu = e * np.exp(z @ beta)
        beta += np.linalg.solve((z * mu[:, None]).T @ z, z.T @ (y - mu))
    df = spark.createDataFrame([(int(n), float(a), *map(float, f)) for n, a, f in zip(y, e, x, strict=True)], "n long, x double, a double, b double")
    got = np.array([r.p for r in df.select(m.poisson_regression(["a", "b"], "n", "x")(df).alias("p")).collect()])
    assert np.allclose(got, e * np.exp(z @ beta), rtol=1e-5)


def test_least_absolute_and_rising_fits(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(10, 300, 301)
    y = 2 * x**0.8 * np.exp(rng.laplace(0, 0.05, 301))
    y[:20] *= 5  # outliers do not move the line
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    line = m.least_absolute("x", "y")(df)
    pred = np.array([r.p for r in df.select(line.alias("p")).collect()])
    assert np.abs(pred - (math.log(2) + 0.8 * np.log(x))).max() < 0.1
    step = m.rising("x", "y", 16)(df)
    order = np.argsort(x)
    values = np.array([r.p for r in df.select(step.alias("p")).collect()])[order]
    assert (np.diff(values) >= -1e-9).all()
    best, errors = m.select_model(df.withColumn("f", F.floor(F.col("x")) % 4), "f", "y", {"ratio": m.median_ratio("x", "y"), "line": m.least_absolute("x", "y")})
    assert best == "line" and errors["line"] < errors["ratio"]


def test_shuffling_moves_groups_of_features_together(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("fold"), F.col("id").alias("a"), (F.col("id") * 10).alias("b"))
    rows = m.shuffled(df, ["a", "b"], "fold", "id", 7).collect()
    assert all(r.b == 10 * r.a and r.a % 3 == r.fold for r in rows) and sorted(r.a for r in rows) == list(range(200)) and sum(r.a != r.id for r in rows) > 150
