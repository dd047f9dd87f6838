import random

import pytest

from pelagos.llm import mixing as m


def fill(sizes, weights, cap):
    """Water-filling by repeated clamping."""
    total, held = sum(sizes), {}
    while True:
        rest, free = total - sum(held.values()), [i for i in range(len(sizes)) if i not in held]
        level = rest / sum(weights[i] for i in free) if free else 0
        over = [i for i in free if cap * sizes[i] < level * weights[i]]
        if not over:
            return [held.get(i, level * weights[i]) for i in range(len(sizes))]
        held |= {i: cap * sizes[i] for i in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_words_taken(spark, seed):
    rng = random.Random(seed)
    names = sorted(f"s{rng.randrange(1000)}" for _ in range(8)) + [None]
    rows = []
    for k, name in enumerate(names):
        for _ in range(rng.choice([2, 40, 300])):
            rows.append((len(rows), "w " * rng.randrange(1, 60), name))
    got = m.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    distinct = sorted({n for n in names if n}) + [None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in distinct]
    want = fill(sizes, [(1, 2, 3)[i % 3] for i in range(len(distinct))], 3)
    for n, size, target in zip(distinct, sizes, want, strict=True):
        own = got[got.source.isna()] if n is None else got[got.source == n]
        assert own.target.iloc[0] == pytest.approx(target, rel=1e-12) and own.source_size.iloc[0] == size
        assert abs(own.taken.sum() - target) <= 30 and (own.taken <= 3 * own["size"]).all()
    again = m.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_ranks_over_partitions(spark):
    names = spark.createDataFrame([(f"n{i:03d}",) for i in range(50)] + [(None,)], "source string").repartition(7)
    got = {r.source: r.place for r in m.ranked(names, "source", "place").collect()}
    assert got == {f"n{i:03d}": i for i in range(50)} | {None: 50}


def test_oracle(spark, sf, duck, same):
    same(m.op5_mixing(spark, sf).toPandas(), duck.execute(m.oracle()).df())


def test_messy(messy, empty):
    out = m.mix(messy("target"))
    rows = out.collect()
    assert len(rows) == 10 and {r["size"] for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert all((r.source_size, r.target) == (3, 9.0) for r in rows if r.source is None)
    twice = [r.repeats for r in rows if r.doc_id == 2]
    assert twice[0] == twice[1]
    assert m.mix(empty).count() == 0


def test_plan_has_no_python(spark, sf):
    plan = m.op5_mixing(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
