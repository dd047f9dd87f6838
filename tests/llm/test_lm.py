import collections
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagos.llm import lm
from pelagos.llm.elias_fano import EliasFano, Trie


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (900, 1 << 20), (900, 1100), (3000, 1 << 62)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, top, n).astype(np.uint64))
    shape, parts = EliasFano.encode(v)
    e = EliasFano(parts["low"], parts["high"], shape["bits"], shape["size"], shape["buckets"])
    assert (e.values() == v).all()
    q = np.concatenate([v, v + np.uint64(1), rng.integers(0, top, 300).astype(np.uint64)])
    at, found = e.successor(q)
    assert (at == np.searchsorted(v, q)).all() and (found == np.isin(q, v)).all()


def test_elias_fano_is_compact():
    v = np.cumsum(np.random.default_rng(1).integers(1, 40, 20_000)).astype(np.uint64)
    _, parts = EliasFano.encode(v)
    assert sum(x.nbytes for x in parts.values()) * 8 / len(v) < 2 + math.log2(20) + 1.1


def test_successors_of_the_largest_numbers():
    v = np.array([1 << 62, (1 << 63) + 5, (1 << 64) - 9], np.uint64)
    shape, parts = EliasFano.encode(v)
    e = EliasFano(parts["low"], parts["high"], shape["bits"], shape["size"], shape["buckets"])
    q = np.array([0, (1 << 63) + 5, (1 << 63) + 6, (1 << 64) - 1], np.uint64)
    assert [x.tolist() for x in e.successor(q)] == [[0, 1, 2, 3], [False, True, False, False]]
    shape, parts = EliasFano.encode(np.zeros(0, np.uint64))
    at, found = EliasFano(parts["low"], parts["high"], 0, 0, 1).successor(q)
    assert not found.any() and (at == 0).all()


@pytest.mark.parametrize("folder", ["own", "/no/such/folder"])
def test_trie_finds_successors_by_context(tmp_path, folder):
    rng = np.random.default_rng(3)
    rows = np.unique(rng.integers(0, 40, (900, 3)), axis=0)
    roots = np.unique(rows[:, 0])
    pairs, at = np.unique(rows[:, :2], axis=0, return_inverse=True)
    where = str(tmp_path) if folder == "own" else folder
    trie = Trie(roots, [(np.searchsorted(roots, pairs[:, 0]), pairs[:, 1]), (at.ravel(), rows[:, 2])], {"value": np.arange(len(rows)).astype(np.uint16)}, 40, where)
    assert bool(os.listdir(tmp_path)) == (folder == "own")
    known = {tuple(r) for r in rows.tolist()}
    q = rng.integers(0, 45, (3000, 3))
    place, hit = trie.root(q[:, 0])
    place, hit = trie.find(0, place, hit, q[:, 1])
    place, hit = trie.find(1, place, hit, q[:, 2])
    low = (q < 40).all(1)
    assert (hit[low] == [tuple(r) in known for r in q[low].tolist()]).all()
    assert (rows[trie.codes["value"][place[hit & low]]] == q[hit & low]).all()
    for n, parent in enumerate((np.searchsorted(roots, pairs[:, 0]), at.ravel())):
        begins = trie.levels[f"pointers{n}"].values().astype(np.int64)
        assert (np.diff(begins) == np.bincount(parent, minlength=len(begins) - 1)).all()
    trie.close()
    assert not os.listdir(tmp_path)


def test_codes_keep_rare_and_frequent_probabilities():
    p = np.array([1.0, 0.999, 0.5, 1e-3, 3.3e-9, 1e-12, 7e-40, 0.0])
    got = lm.restore(lm.quantise(p))
    assert np.allclose(got, p, rtol=0.0012, atol=0)
    x = np.array([0, 1, 255, 256, 70_000, 1 << 40, (1 << 64) - 1], np.uint64)
    for k in range(1, len(x) + 1):
        assert (lm.loosen(lm.squeeze(x[:k])) == x[:k]).all()
    assert len(lm.loosen(lm.squeeze(x[:0]))) == 0


def model(texts, held, share):
    """The model in plain Python, without quantisation."""
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None] for i, t in texts}
    learned = [ws for i, ws in words.items() if i not in held]
    uni = collections.Counter(w for ws in learned for w in ws)
    least = max(1, math.ceil(sum(uni.values()) * share))
    grams = [collections.Counter(p for ws in learned for p in zip([None, *ws], ws)), collections.Counter(p for ws in learned for p in zip([None, *ws], ws, ws[1:]) if uni[p[0]] >= least and uni[p[1]] >= least)]
    total, freed = collections.Counter(), collections.Counter()
    for level in grams:
        for g, n in level.items():
            total[g[:-1]] += n
            freed[g[:-1]] += lm.DISCOUNTS[min(n, 3) - 1]
    n, v = sum(uni.values()), len(uni)

    def up(level, g, below):
        if not total[g[:-1]]:
            return below
        c = grams[level][g]
        return ((c - lm.DISCOUNTS[min(c, 3) - 1] if c else 0) + freed[g[:-1]] * below) / total[g[:-1]]

    out = {}
    for i, ws in words.items():
        base = [(uni[w] + 1) / (n + v + 1) for w in ws]
        p = [up(0, (a, w), b) for a, w, b in zip([None, *ws], ws, base, strict=False)]
        p = p[:1] + [up(1, g, x) for g, x in zip(zip([None, *ws], ws, ws[1:]), p[1:], strict=False)]
        out[i] = (len(ws), sum(uni[w] > 0 for w in ws), n, sum(map(math.log10, base)), sum(map(math.log10, p)))
    return out


@pytest.mark.parametrize("batch,shard,share", [(8 << 20, 1_500_000, 1e-3), (40_000, 4_000, 0.0), (40_000, 700, 1e-5), (40_000, 700, 1e-4)])
def test_scores_against_the_plain_model(spark, sf, batch, shard, share):
    """One batch and shard, then many, with frequent words in parts; the scores are the plain model's within the quantiser's error."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    want = model(texts, held, share)
    rows = lm.score_documents(docs, batch_bytes=batch, shard_tokens=shard, min_share=share).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, r.doc_id in held)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=0.001, abs=0.001 * n)
    new = [r for r in rows if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)


def test_messy(messy, empty):
    rows = lm.score_documents(messy("batch")).collect()
    assert len(rows) == 10
    nothing = [r for r in rows if r.doc_id in (3, 4, 5)]
    assert {r.n_tokens for r in nothing} == {1} and len({r.score for r in nothing}) == 1
    assert all(r.score <= 0 and r.base_score < 0 for r in rows) and next(r for r in rows if r.doc_id is None).held_out is False
    assert lm.score_documents(empty).count() == 0


def test_no_training_documents(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score_documents(df, held=F.lit(True)).first()
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_rare_pairs_are_contexts_in_a_larger_corpus(spark):
    """More than 100,000 training tokens, where a share of 1e-5 would let no pair of two words that occur once be a context."""
    docs = [(i, " ".join(f"w{(i * 37 + k * k) % 911}" for k in range(1000))) for i in range(150)] + [(1000, "rare pair follows"), (1001, "rare pair follows")]
    held = {1001}
    rows = lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), held=F.col("doc_id") == 1001).collect()
    want = model(docs, held, 0.0)
    assert want[1001][2] > 100_000 and model(docs, held, 1e-5)[1001][4] < want[1001][4] - 0.1
    for r in rows:
        assert r.score == pytest.approx(want[r.doc_id][4], rel=0.001, abs=0.001 * r.n_tokens)
