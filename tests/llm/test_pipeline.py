import pytest

import corpus_pipeline as c
from pelagos.llm import dedup, mixing, toxicity


@pytest.fixture(scope="module")
def kept(spark, sf):
    """What each stage keeps of the test documents, by name."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in c.STAGES:
        docs = c.materialise(stage(spark, docs, sf), f"test-{name}")
        out[name] = docs
    return out


def test_stages(spark, sf, kept):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["toxicity", "simhash", "mixing", "packing"]
    for name in ("toxicity", "simhash", "mixing"):
        assert kept[name].columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    judge = model.scorer()
    clean = {r.doc_id for r in docs.collect() if judge(r.text) < toxicity.THRESHOLD}
    assert {r.doc_id for r in kept["toxicity"].collect()} == clean


def test_no_similar_texts_stay(kept):
    texts = {r.doc_id: r.text for r in kept["simhash"].collect()}
    sets = {i: set(dedup.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    ids = sorted(sets)
    close = [(a, b) for a in ids for b in ids if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert not close
    before = {r.doc_id for r in kept["toxicity"].collect()}
    assert set(ids) <= before


def test_repeats_follow_the_mixture(kept):
    want = {r.doc_id: r.repeats for r in mixing.mix(kept["simhash"]).collect() if r.repeats}
    assert {r.doc_id: r["count"] for r in kept["mixing"].groupBy("doc_id").count().collect()} == want


def test_packing_and_run(spark, sf, kept):
    rows = kept["packing"].toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    pieces = rows.groupby("doc_id").size()
    assert set(pieces.index) == {r.doc_id for r in kept["mixing"].select("doc_id").distinct().collect()}
    again = c.run(spark, sf).toPandas()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, rows[cols].values.tolist())) == sorted(map(tuple, again[cols].values.tolist()))


@pytest.mark.parametrize("extra", ["extra", "target", "score", "size", "_node", "predicted", "a.b", "_copy"])
def test_messy_documents_pass_every_stage(spark, messy, empty, tmp_path, extra):
    """Nothing is toxic here; of the equal texts, and of those without words, the first stays; the columns keep their values."""
    spark.createDataFrame([(1, 0), (8, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (messy(extra), empty):
        at, kept = docs, {}
        for name, stage in c.STAGES:
            at = kept[name] = c.materialise(stage(spark, at, str(tmp_path)), "messy")
        if docs is not empty:
            rows = docs.collect()
            assert sorted(map(str, kept["toxicity"].collect())) == sorted(map(str, rows))
            first = [rows[i] for i in (0, 3, 6, 7, 8, 9)]  # documents 1, 3, null, 6, 7 and 8
            assert kept["simhash"].columns == docs.columns and sorted(map(str, kept["simhash"].collect())) == sorted(map(str, first))
            assert set(map(str, kept["mixing"].collect())) <= set(map(str, first)) and kept["mixing"].columns == docs.columns
            packed = {r.doc_id for r in kept["packing"].collect()}
            assert packed == {r.doc_id for r in kept["mixing"].collect()}
        else:
            assert all(x.isEmpty() for x in kept.values())
