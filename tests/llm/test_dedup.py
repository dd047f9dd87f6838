import numpy as np
import pyarrow as pa
import pytest

from pelagos.llm import dedup

WORDS = 200


def changed(words, kind, k, rng):
    other = [f"o{x}" for x in rng.integers(0, 10**9, k)]
    return {"appended": words + other, "truncated": words[: len(words) - k], "block": words[:50] + other + words[50 + k :]}[kind]


@pytest.mark.parametrize("kind", ["appended", "truncated", "block"])
def test_contiguous_changes_are_found(spark, kind):
    rng, rows, close = np.random.default_rng(5), [], []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**9, WORDS)]
        texts = [" ".join(words), " ".join(changed(words, kind, 10 + i % 4 * 8, rng))]
        one, two = (set(dedup.shingle_set(t, 5).tolist()) for t in texts)
        close.append(len(one & two) >= 0.8 * len(one | two))
        rows += [(2 * i, texts[0]), (2 * i + 1, texts[1])]
    kept = {r.doc_id for r in dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(close) >= 15
    assert [2 * i + 1 not in kept for i in range(60)] == close


def test_similar_sets_share_a_prefix_in_any_order():
    rng = np.random.default_rng(6)
    frequent = np.arange(0, 400, 7)
    for often in (np.zeros(0, int), rng.integers(1, 9, len(frequent))):
        for _ in range(500):
            one = np.unique(rng.choice(400, rng.integers(1, 60)))
            two = np.unique(np.concatenate([rng.permutation(one)[rng.integers(0, len(one) // 5 + 1) :], rng.choice(400, rng.integers(0, len(one) // 5 + 1))]))
            if len(np.intersect1d(one, two)) >= 0.8 * len(np.union1d(one, two)):
                a, b = (dedup.prefix(x, frequent[: len(often)], often, 0.8) for x in (one, two))
                assert len(np.intersect1d(a, b))


@pytest.mark.parametrize("step", [1, 50, 1000])
def test_runs_across_batches(step):
    key = np.repeat([1, 2, 3, 4], [2, 16, 17, 300])
    node = np.arange(len(key))
    ten, first = pa.array(np.full(len(key), 10, np.int32)), pa.array(np.zeros(len(key), np.int32))
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), ten, first], names=["key", "node", "n", "place"])
    out = pa.Table.from_batches(dedup._candidates(0.8)(rows.slice(at, step) for at in range(0, len(key), step))).to_pandas()
    pairs, chain = out[out.kind == dedup.PAIR], out[out.kind == dedup.LONG]
    want = {(a, b) for a in node for b in node if a < b and key[a] == key[b] <= 2}
    assert set(zip(pairs.a, pairs.b, strict=True)) == want
    assert sorted(zip(chain.a, chain.b, strict=True)) == [(n, k) for n, k in zip(node, key, strict=True) if k > 2]


def test_long_runs_are_compared(spark, monkeypatch):
    monkeypatch.setattr(dedup, "RUN", 2)
    rng = np.random.default_rng(7)
    words = [f"w{x}" for x in rng.integers(0, 10**9, WORDS)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(300)] + [(300, " ".join(words[:100]))]
    assert {r.doc_id for r in dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0, 300}


def test_loose_groups_in_long_runs(spark, monkeypatch):
    """Windows of one text that are similar to their neighbours only, in runs that are dealt out as blocks."""
    monkeypatch.setattr(dedup, "RUN", 1)
    monkeypatch.setattr(dedup, "BLOCK", 3)
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 10**9, 400)]
    rows = [(i, " ".join(words[15 * i : 15 * i + WORDS])) for i in range(12)] + [(12, " ".join(words[300:]))]
    assert {r.doc_id for r in dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0, 12}


def test_bitmaps_never_reject_similar_sets():
    rng = np.random.default_rng(9)
    for n in (1, 5, 60, 63, 64, 65, 300, 5000):
        for _ in range(40):
            one = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
            two = np.unique(np.concatenate([one[rng.integers(0, max(1, n // 9)) :], rng.integers(-(1 << 63), 1 << 63, rng.integers(0, n // 9 + 1))]))
            bits = [dedup.bitmap(x) for x in (one, two)]
            assert dedup.fold(bits[0], 32) == dedup.fold(dedup.fold(bits[0], max(32, len(bits[0]) // 2)), 32)
            differ = len(np.setxor1d(one, two))
            run = dedup._Bits(np.sort([len(one), len(two)]), [b for _, b in sorted(zip((len(one), len(two)), bits, strict=True))], 0.8)
            if len(np.intersect1d(one, two)) >= 0.8 * len(np.union1d(one, two)):
                assert np.isfinite(run.distance(0, np.array([1])))[0]
                assert run.distance(0, np.array([1]))[0] <= differ / dedup.most_bits(len(one) + len(two), 0.8) + 1e-9


def brute(rows):
    """The smallest id of each component of texts whose sets are similar, by all pairs."""
    sets, root = {}, {}
    for i, t in rows:
        sets.setdefault(dedup.node_of(t), (set(dedup.shingle_set(t, 5).tolist()), []))[1].append(i)
    keys = list(sets)

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    pairs = 0
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            one, two = sets[a][0], sets[b][0]
            if min(len(one), len(two)) >= 0.8 * max(len(one), len(two)) and one and len(one & two) >= 0.8 * len(one | two):
                root[find(a)] = find(b)
                pairs += 1
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).extend(sets[k][1])
    return {min(g) for g in groups.values()}, pairs


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want, pairs = brute([tuple(r) for r in docs.collect()])
    assert {r.doc_id for r in dedup.drop_near_duplicates(docs).collect()} == want


def test_a_large_group_of_near_copies(spark):
    """Copies with some words changed, below, at and above the similarity."""
    rng = np.random.default_rng(10)
    words, rows = [f"w{x}" for x in rng.integers(0, 10**9, 60)], []
    for i in range(400):
        own = list(words)
        for at in rng.integers(0, len(own), rng.integers(0, 4)):
            own[at] = f"c{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(own)))
    want, pairs = brute(rows)
    assert pairs > 1000
    assert {r.doc_id for r in dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
