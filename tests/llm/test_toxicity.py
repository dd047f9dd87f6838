import math
import random
import zlib

import numpy as np
import pytest

from pelagos.llm import toxicity as x

BAD = ["foul", "vile", "crude"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeimnrst") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    rows = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 400))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randrange(1, 4)):
                own[rng.randrange(len(own))] = rng.choice(BAD) + rng.choice(["", ",", "!"])
        rows.append((i, " ".join(own), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in x.score(docs, x.train(docs, labels)).collect()}
    new = [(got[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = sum(p != y for p, y in new)
    assert len(new) > 400 and wrong <= 0.02 * len(new)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_are_never_used(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    a = x.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = x.train(docs, spark.createDataFrame(turned, "doc_id long, toxic int"))
    assert a.words == b.words and (a.ratios == b.ratios).all()


def test_continuation_counts(spark):
    sample = spark.createDataFrame([("a b a b c b", 0, 0), ("a b", 0, 1), ("b b", 1, 0)], "text string, y int, half int")
    got = {r.word: (r.k0, r.k1, r.k2, r.k3, r.c0, r.c1) for r in x._contexts(sample).collect()}
    assert got == {"a": (2, 1, 0, 0, 2, 0), "b": (2, 1, 2, 0, 2, 2), "c": (1, 0, 0, 0, 1, 0)}


def test_ratio_grows_with_evidence_and_rare_words_share_the_backoff():
    c = x.Counts(["often", "rare", "both"], np.array([0.0, 0, 50]), np.array([60.0, 2, 5]), ({50: 1, 1: 400}, {60: 1, 2: 1, 5: 1, 1: 100}))
    ratio, rest = x.log_ratios(c, 2.0)
    assert ratio[0] > ratio[1] == pytest.approx(rest) and ratio[0] > 2 and ratio[2] < ratio[0]
    for d in x.DISCOUNTS:  # each class's words and the shared mass sum to one
        total = 50 + 400
        freed = (min(50, d) + 400 * min(1, d)) / total
        assert max(50 - d, 0) / total + 400 * max(1 - d, 0) / total + freed == pytest.approx(1)


def plain_ratios(rows, discount):
    """Class-conditional Kneser-Ney by sets of pairs, in plain Python: (log ratio of every word, that of words at or below the discount)."""
    pairs = [set(), set()]
    for text, y in rows:
        words = x.words_of(text)
        pairs[y] |= set(zip(["", *words], words, strict=False))
    counts = [{}, {}]
    for own, found in zip(counts, pairs, strict=True):
        for _, w in found:
            own[w] = own.get(w, 0) + 1
    types = len(counts[0]) + len(counts[1])
    total = [sum(c.values()) for c in counts]
    freed = [sum(min(n, discount) for n in c.values()) / t for c, t in zip(counts, total, strict=True)]
    p = lambda y, w: max(counts[y].get(w, 0) - discount, 0) / total[y] + freed[y] * ((w in counts[0]) + (w in counts[1])) / types
    return {w: math.log(p(1, w) / p(0, w)) for w in counts[0].keys() | counts[1].keys()}, math.log(freed[1] / freed[0])


def test_scores_against_the_plain_model(spark):
    rows = corpus(400, seed=5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "unseenword")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = x.train(docs, labels)
    learned = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    ratios, rest = plain_ratios(learned, model.discount)
    mean, scale, w = model.weights
    for r in x.score(docs, model).collect():
        own = sorted((ratios.get(word, rest) for word in x.words_of(r.text)), reverse=True)
        top = [max(v, 0.0) for v in own[:3]]
        f = [sum(own) / len(own), *(sum(top[:k]) / k for k in (1, 2, 3))] if own else [0.0] * 4
        z = w[0] + sum(b * (v - m) / s for b, v, m, s in zip(w[1:], f, mean, scale, strict=True))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_features():
    assert x.text_features(np.array([])) == [0.0] * 4
    assert x.text_features(np.array([3.0, -1.0])) == [1.0, 3.0, 1.5, 1.0]
    assert x.text_features(np.array([1.0, 5.0, -2.0, 3.0, 0.0])) == pytest.approx([1.4, 5.0, 4.0, 3.0])


def test_messy_and_without_labels(spark, messy, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (999, 1), (3, 0), (3, 1), (4, 7)], "doc_id long, toxic int")
    for labels in (none, odd):
        rows = x.score(messy("predicted"), x.train(messy(), labels)).collect()
        assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert x.score(empty, x.train(empty, none)).count() == 0
