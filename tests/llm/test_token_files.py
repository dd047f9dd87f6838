import io
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pelagos.llm import token_files as t


def library(text):
    tok = Tokenizer.from_file(public_tokenizers.path(t.TOKENIZER))
    tok.encode_special_tokens = True
    return [*tok.encode(text or "", add_special_tokens=False).ids, t.END_ID]


def test_frames_are_independent_and_checked():
    out = io.BytesIO()
    w = t.TokenFileWriter(out)
    docs = [np.arange(n, dtype="<u4") for n in (1, 5, 1000, 3)]
    for i, ids in enumerate(docs):
        w.add(i * 10, ids.tobytes())
    w.close()
    raw = out.getvalue()
    f = t.TokenFile(io.BytesIO(raw))
    assert len(f) == 4 and f.find(20) == [2] and all((f.read(k) == d).all() for k, d in enumerate(docs))

    class Counting(io.BytesIO):
        bytes_read = 0

        def read(self, n=-1):
            got = super().read(n)
            self.bytes_read += len(got)
            return got

    one = Counting(raw)
    f = t.TokenFile(one)
    before = one.bytes_read
    f.read(0)
    assert one.bytes_read - before == f.entries["packed"][0]
    damaged = bytearray(raw)
    damaged[int(f.at[2]) + 20] ^= 1
    bad = t.TokenFile(io.BytesIO(bytes(damaged)))
    assert (bad.read(1) == docs[1]).all()
    with pytest.raises(Exception):  # noqa: B017, PT011  zstandard's own error, or ours by the checksum
        bad.read(2)


def test_wide_ids():
    out = io.BytesIO()
    w = t.TokenFileWriter(out, width=4)
    w.add(1, np.array([70_000], "<u4").tobytes())
    w.close()
    assert t.TokenFile(io.BytesIO(out.getvalue())).read(0).tolist() == [70_000]


def test_round_trip(spark, messy, empty, tmp_path):
    path = f"file://{tmp_path}/ids"
    manifest = t.write_token_files(messy("start"), path, roll_bytes=200)
    rows = t.read_token_files(manifest, with_ids=True).collect()
    texts = [(r.doc_id, r.text) for r in messy().collect()]
    assert len(rows) == len(texts) and manifest.count() > 1
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8]
    want = {i: library(x) for i, x in texts}
    assert all(np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] for r in rows)
    files = [r.file for r in manifest.collect()]
    assert [x.tolist() for x in t.read_documents(spark, files, 7)] == [want[7]]
    assert not [f for f in os.listdir(tmp_path / "ids") if f.startswith(".")]
    assert t.read_token_files(t.write_token_files(empty, f"file://{tmp_path}/none")).count() == 0


def test_op10(spark, sf):
    rows = t.op10_token_files(spark, sf).orderBy("doc_id").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at = 0
    for r in rows:
        ids = np.array(library(texts[r.doc_id]), "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(rows) == len(texts)
