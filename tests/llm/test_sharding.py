import pytest
from pyspark.sql import functions as F

from pelagos.llm import sharding as h


def test_oracle(spark, sf, duck, same):
    same(h.op9_sharding(spark, sf).toPandas(), duck.execute(h.oracle()).df())


@pytest.mark.parametrize("limit", [200, 5_000])
def test_every_shard_fits(spark, sf, limit):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = h.assign(docs, limit=limit).toPandas()
    assert len(rows) == docs.count()
    sums = rows.groupby("shard").n_bytes.agg(["sum", "count"])
    assert ((sums["sum"] <= limit) | (sums["count"] == 1)).all()
    shards = sorted(rows.shard.unique())
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))
    parents = rows[rows.depth > 0].shard.str[:-1].unique()
    for p in parents:  # a bucket split only if it was too large
        own = rows[rows.shard.str.startswith(p)]
        assert own.n_bytes.sum() > limit


def test_one_id_with_too_many_rows(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text"))
    rows = h.assign(docs, limit=2_000).toPandas()
    assert len(rows) == 3000 and (rows.groupby("shard").n_bytes.sum() <= 2_000).all() and not rows.oversized.any()


def test_messy(spark, messy, empty, tmp_path):
    rows = h.assign(messy("shard"), limit=50).collect()
    assert len(rows) == 10 and all(r.shard_bytes <= 50 or r.shard_docs == 1 for r in rows)
    assert next(r for r in rows if r.doc_id == 6).oversized and next(r for r in rows if r.doc_id == 3).n_bytes == 0
    assert h.assign(empty).count() == 0
    h.write_shards(messy(), str(tmp_path / "s"), limit=100)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 10
