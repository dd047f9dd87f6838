import random

import numpy as np
import pytest
import xxhash

from pelagos.llm import dedup, golay
from pelagos.llm import simhash as s


def test_golay_code():
    words = golay._codewords()
    assert sorted(np.unique(np.bitwise_count(words))) == [0, 7, 8, 11, 12, 15, 16, 23] and (golay.syndrome(words) == 0).all()
    table = golay.key_table(23)
    far = np.bitwise_count(words[table[:5000, 0]] ^ np.arange(5000))
    assert far.max() == 3
    for row in range(0, 5000, 97):
        near = set(np.flatnonzero(np.bitwise_count(words ^ row) <= 4))
        assert set(table[row][table[row] != golay.NO_KEY].tolist()) == near


def test_two_errors_share_a_key():
    table, rng = golay.key_table(23), np.random.default_rng(0)
    for x in rng.integers(0, 1 << 23, 200):
        a, b = rng.choice(23, 2, replace=False)
        y = int(x) ^ 1 << int(a) ^ 1 << int(b)
        assert (set(table[x]) - {golay.NO_KEY}) & set(table[y])


def test_fingerprints_within_four_bits_share_a_key():
    rng = random.Random(1)
    for trial in range(400):
        x = rng.getrandbits(64)
        bits = [16 * k + rng.randrange(16) for k in range(4)] if trial % 3 == 0 else rng.sample(range(64), rng.randrange(5))
        y = x
        for b in bits:
            y ^= 1 << b
        pair = np.array([x, y], np.uint64).view(np.int64)
        row, key = s.fuzzy_keys(pair)
        assert set(key[row == 0]) & set(key[row == 1])


def brute(texts, size=4):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
        sh = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def components(ids, fps, bits=4):
    root = dict(zip(ids, ids, strict=True))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op4_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    fps = brute([docs[i] for i in ids])
    want = components(ids, fps)
    got = s.op4_simhash(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in zip(ids, fps, strict=True)}
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("limit", [20_000, 50, 7])
def test_links_of_a_dense_group_keep_its_components(spark, limit):
    """A chain and a ball of fingerprints, with runs dealt out as pairs of blocks at the smaller limits."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(150):
        fps.add(base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    step = rng.getrandbits(64)
    for _ in range(12):
        fps.add(step)
        for b in rng.sample(range(64), 4):
            step ^= 1 << b
    values = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in values], "node long, fp long")
    links, _ = s.find_links(lambda: s.key_rows(nodes), 4, limit)
    from pelagos.operators.graph import connected_components

    got = {r.node: r.root for r in connected_components(links).collect()}
    want = components(values, [f & (1 << 64) - 1 for f in values])
    assert {k: got.get(k, k) for k in values} == want


def test_messy(messy, empty):
    rows = s.near_duplicates(messy("fp")).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and by[1].fp == by[2].fp and by[2].component_id == 1
    assert by[3].fp == by[4].fp == by[5].fp == 0 and by[5].component_id == 3
    assert s.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        s.near_duplicates(empty, tolerance=5)


def test_drop_near_duplicates(spark, messy, empty):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for i in range(30):
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(200)] = "changed"
        rows.append((100 - i, " ".join(own)))
    rows += [(200 + i, " ".join(rng.choice(words) for _ in range(120))) for i in range(20)]
    docs = spark.createDataFrame([(a, t, "x") for a, t in rows], "doc_id long, text string, _keeper string").drop("_keeper")
    kept = [r.doc_id for r in dedup.drop_near_duplicates(docs).collect()]
    assert sorted(kept) == [71, *range(200, 220)]
    out = dedup.drop_near_duplicates(messy("root"))
    assert out.columns == messy("root").columns
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 3, 6, 7, 8]
    assert dedup.drop_near_duplicates(empty).count() == 0


def test_drop_near_duplicates_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: set(dedup.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and (dedup.node_of(texts[a]) == dedup.node_of(texts[b]) or both and both / len(sets[a] | sets[b]) >= 0.8):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {i for i in texts if find(i) == i}
    got = {r.doc_id for r in dedup.drop_near_duplicates(docs).select("doc_id").collect()}
    assert len(got ^ want) <= 0.02 * len(want)
