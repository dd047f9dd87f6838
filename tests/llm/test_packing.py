import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pelagos.llm import packing as p
from pelagos.llm.tokens import encoder


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_plan_uses_every_piece_once(counts):
    runs = p.plan_sequences(counts, 40)
    used = Counter()
    for pattern, n in runs:
        assert sum(k * v for k, v in pattern.items()) <= 40 and n > 0
        for length, k in pattern.items():
            used[length] += k * n
    assert used == Counter(counts)


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_near_the_bound(seed):
    rng = random.Random(seed)
    counts = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    sequences = sum(n for _, n in p.plan_sequences(dict(counts)))
    assert sequences <= -(-sum(k * n for k, n in counts.items()) // 2048) * 1.001 + 1


def test_exact_complements_are_taken():
    assert sum(n for _, n in p.plan_sequences({1000: 5, 1048: 5})) == 5
    assert sum(n for _, n in p.plan_sequences({1024: 4, 700: 4, 324: 4})) == 4
    assert sum(n for _, n in p.plan_sequences({1000: 3, 500: 3, 300: 3, 248: 3})) == 3
    assert p.plan_sequences({}) == []


def test_pair_counts_stay_right():
    rng = random.Random(4)
    stock = p.Stock({k: rng.randrange(1, 4) for k in rng.sample(range(1, 60), 25)}, 60)
    for _ in range(40):
        alive = np.flatnonzero(stock.left)
        if not len(alive):
            break
        stock.take(int(rng.choice(alive)), 1)
        left = stock.left
        want = [sum(1 for a in range(1, s // 2 + 1) if left[a] >= 1 + (2 * a == s) and left[s - a] >= 1) for s in range(61)]
        assert list(stock.pairs) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name, messy):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    e, plain = encoder(public_tokenizers.path(name)), encoder(public_tokenizers.path(name), special_as_text=False)
    texts = [r.text for r in messy().collect()] + ["a <|endoftext|> b", "<|startoftext|>a<|endoftext|>", "<|end", "a  b\n\n c \t", "I'll don't 12 3,4", "ΑΣ ς", "\x1c x", "é É", " lead", "x\u00a0y", "ǅ İ"]
    for own, as_text in ((plain, False), (e, True)):  # the library as it is, and with special tokens as text
        t.encode_special_tokens = as_text
        for text in texts:
            assert list(np.frombuffer(own.encode(text), "<u4")) == t.encode(text or "", add_special_tokens=False).ids


def test_pack(messy, empty):
    rows = p.pack(messy("piece"), capacity=512).collect()
    by_doc = Counter()
    for r in rows:
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= 512
        by_doc[r.doc_id] += r.length
    assert by_doc[3] == by_doc[4] == 1 and by_doc[2] == 2 * by_doc[1]
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 6)
    assert [x[2] for x in long[1:]] == [512] * (len(long) - 1) and [x[1] for x in long] == list(np.cumsum([0, *[x[2] for x in long[:-1]]]))
    assert p.pack(empty).count() == 0


def test_pack_against_the_library(spark, sf):
    t = Tokenizer.from_file(public_tokenizers.path(p.TOKENIZER))
    t.encode_special_tokens = True
    rows = p.op3_packing(spark, sf).toPandas()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total = 0
    for doc_id, own in rows.groupby("doc_id"):
        ids = np.array([*t.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        own, at = own.sort_values("piece"), 0
        for k, r in enumerate(own.itertuples()):
            assert (r.piece, r.start) == (k, at) and 1 <= r.length <= 2048 and (len(own) == 1 or k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
    assert set(rows.doc_id) == set(texts) and rows.sequence_id.nunique() <= -(-total // 2048) + 1


def test_triples_are_looked_for_among_all_lengths():
    """Forty lengths have more copies than the only triple that fits, and no partner."""
    counts = {1000 + 2 * k: 9 for k in range(1, 41)} | {1700: 1, 101: 1, 117: 1, 130: 1}
    runs = p.plan_sequences(counts)
    assert ({1700: 1, 101: 1, 117: 1, 130: 1}, 1) in runs
