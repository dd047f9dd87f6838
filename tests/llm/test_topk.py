import math
import random

import pytest
from pyspark.sql import functions as F

from pelagos.llm import topk as t


def brute(rows, k, every):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block,group,pivots", [(1024, 256, 64), (7, 3, 5), (16, 2, 1)])
def test_against_brute_force(spark, monkeypatch, block, group, pivots):
    monkeypatch.setattr(t, "BLOCK_ROWS", block)
    monkeypatch.setattr(t, "GROUP_ROWS", group)
    monkeypatch.setattr(t, "LEAST_QUERIES", group)
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [float(c + rng.gauss(0, 0.1)) for c in centres[i % 4]]) for i in range(230)]
    rows += [(300 + i, list(rows[0][1])) for i in range(30)]  # copies, so ties
    rows += [(400, None), (410, []), (420, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (430, [math.nan] * 6), (440, [math.inf] * 6), (None, [1.0] * 6), (450, [1.0, 2.0]), (460, [0.5, 0.5]), (470, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in t.top_k(df, F.col("vec_id") % 10 == 0, n_pivots=pivots).collect())
    assert got == brute(rows, 10, 10)


def test_repeated_query_ids(spark):
    """A tight cell of copies of a query under its own id holds none of its results, and must not count towards its bound."""
    rng = random.Random(6)
    rows = [(0, [50.0, 0.1 * (i % 4)]) for i in range(40)] + [(i, [rng.uniform(0, 40), rng.uniform(-5, 5)]) for i in range(1, 150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in t.top_k(df, F.col("vec_id") == 0, n_pivots=30).collect())
    merged = sorted((-s, j) for _, _, j, s in brute(rows, 1000, 1000))[:10]  # rows of one query id are ranked together
    assert got == [(0, r, j, -s) for r, (s, j) in enumerate(merged, 1)]


def test_oracle(spark, sf, duck, same):
    same(t.op6_topk(spark, sf).toPandas(), duck.execute(t.oracle()).df())


def test_empty_and_few(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert t.top_k(empty, F.col("vec_id") % 100 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in t.top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]


def test_bounds_hold_and_prune(spark):
    """Cells left out hold no result: with far clusters only some cells are wanted, and the result is still exact."""
    rng = random.Random(4)
    rows = [(i, [100.0 * (i % 5 == c) + rng.random() for c in range(5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in t.top_k(df, F.col("vec_id") % 50 == 0, n_pivots=20).collect()) == brute(rows, 10, 50)
