"""What the operators share: input tables, words and Arrow helpers."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos.storage import materialise, shared_dir

__all__ = ["WORD", "WORD_BYTES", "give_back", "lower_ascii", "materialise", "shared_dir", "sliced", "small_batches", "table", "word_count"]

#: A word: a run of anything but space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of a batch for Python, and rows of a batch that a Parquet reader decodes.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 1024}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what Python makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands whole texts to Python and reads them from Parquet in pieces of a few MB, however long they are.

    By default a batch is 10,000 rows or 64 MB, which JVM and worker hold at once and whose memory both keep. Only how rows are grouped changes;
    smaller values that the session has stay.
    """
    for key, most in BATCH.items():
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """In a worker: return what earlier tasks left and this one does not use, that is encoders with their caches and what the allocators keep."""
    if tokens := sys.modules.get("pelagos.llm.tokens"):
        tokens.encoder.cache_clear()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def word_count(text):
    """Native word count of a text column; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(col):
    """Lower-case A to Z only, as the word-based operators ask."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
