import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline as c
from pelagos.llm import common, packing, tokens

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def plain(spark):
    """A session with Spark's own sizes of batches."""
    for key in common.BATCH:
        spark.conf.unset(key)
    yield spark
    for key in common.BATCH:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", ["mixing", "packing"])
def test_stages_hand_long_texts_to_python_in_small_batches(plain, name):
    docs = plain.range(1500, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 4000) as text", "'a' as source")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    largest = lambda: max(r.n for r in docs.mapInArrow(sizes, "n long").collect())
    dict(c.STAGES)[name](plain, docs, "")
    assert largest() <= 2 * common.BATCH[KEY]


def test_smaller_batches_of_the_session_stay(plain):
    plain.conf.set(KEY, "1m")
    common.small_batches(plain)
    assert plain.conf.get(KEY) == "1m"
    plain.conf.set(KEY, "48m")
    common.small_batches(plain)
    assert int(plain.conf.get(KEY).rstrip("b")) == common.BATCH[KEY]


def test_encoders_of_earlier_tasks_go():
    tokens.encoder(public_tokenizers.path(packing.TOKENIZER)).encode("some text")
    common.give_back()
    assert tokens.encoder.cache_info().currsize == 0
