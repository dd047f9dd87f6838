"""Extendible hashing: a directory over hash-prefix bits in which only oversized buckets split further.

Sums of bytes by a prefix some bits longer than the expected depth give the bytes of every shorter
prefix, so one pass over the keys settles most of the directory; cells still above the limit take
eight more bits in the next round, over their own rows only. A document whose key hash cannot be
told from others by all 60 bits (repeated ids) goes on by row: such a cell is dealt out over salts and
each salt is cut into parts that fit.

Defined cases: null text has 0 bytes; a null id is hashed as the empty string; a bucket with a single
document is a shard even if that document alone is above the limit (``oversized``); an empty table
gives an empty result; columns that the operator adds replace columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

LIMIT_BYTES = 1 << 20
BITS, STEP = 60, 8
#: Rows of equal ids for each salt on average, so that a salt's running sum stays in one task.
SALT_ROWS = 50_000


def key_hash(column: str):
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def prefix_text(prefix, depth):
    """``depth`` bits of ``prefix`` as text, the empty text for the root."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, "0"))


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Split ``rows`` (h, n_bytes) into leaves.

    Returns the leaves (cell, bits, depth, prefix, shard_bytes, shard_docs), where a row belongs to the leaf whose
    ``cell`` equals its hash's first ``bits`` bits, and the cells that all bits leave oversized, or None.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(20, max(1, math.ceil(math.log2(max(2, total / limit))) + 6))
    low, heavy, found = 0, None, []
    while True:
        here = rows if heavy is None else rows.join(heavy, F.shiftright("h", BITS - low) == heavy["heavy"], "left_semi")
        cells = materialise(here.groupBy(F.shiftright("h", BITS - bits).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "cells")
        steps = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("depth"))
        steps = steps.withColumn("prefix", F.expr(f"shiftright(cell, cast({bits} - depth as int))"))
        sums = steps.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
        least = steps.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "shard_bytes", "shard_docs"), "depth").alias("leaf"))
        leaves = materialise(cells.select("cell").join(least, "cell", "left").select("cell", F.lit(bits).alias("bits"), "leaf.*"), "leaves")
        found.append(leaves.where("depth is not null"))
        over = leaves.where("depth is null")
        if over.isEmpty():
            heavy = None
            break
        heavy, low = over.select(F.col("cell").alias("heavy")), bits
        if bits == BITS:
            break
        bits = min(BITS, bits + STEP)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out, heavy, total


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """``docs`` with n_bytes, shard (its prefix bits), depth, shard_bytes, shard_docs and oversized."""
    added = ("n_bytes", "shard", "depth", "shard_bytes", "shard_docs", "oversized")
    docs = docs.drop(*(c for c in added if c not in (key, text)))
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("_h", key_hash(key))
    rows = materialise(sized.select(F.col("_h").alias("h"), "n_bytes"), "keys")
    leaves, heavy, _ = directory(rows, limit)
    leaves = materialise(leaves, "directory")
    lengths = [r[0] for r in leaves.select("bits").distinct().collect()]  # at most one per round
    out = None
    for bits in sorted(lengths):
        own = leaves.where(F.col("bits") == bits).drop("bits")
        part = sized.join(own, F.shiftright("_h", BITS - bits) == own["cell"]).drop("cell")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = sized.where(F.lit(False)).select("*", *(F.lit(None).cast("long").alias(c) for c in ("depth", "prefix", "shard_bytes", "shard_docs")))
    out = out.withColumn("shard", prefix_text(F.col("prefix"), F.col("depth").cast("int"))).withColumn("depth", F.col("depth").cast("long")).drop("prefix")
    if heavy is not None:
        out = out.unionByName(_by_rows(sized, heavy, limit))
    return out.withColumn("oversized", F.col("shard_bytes") > limit).drop("_h")


def _by_rows(sized: DataFrame, heavy: DataFrame, limit: int) -> DataFrame:
    """Rows of equal hash: a salt from the row's number, then parts of at most ``limit`` bytes by a running sum within the salt."""
    same = materialise(sized.join(heavy, F.col("_h") == heavy["heavy"], "left_semi").withColumn("_row", F.monotonically_increasing_id()), "equal")
    rows = same.groupBy(F.col("_h").alias("_key")).agg(F.ceil(F.count("*") / SALT_ROWS).alias("_salts"))
    same = same.join(rows, same["_h"] == rows["_key"]).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts"))).drop("_row", "_key", "_salts")
    group = Window.partitionBy("_h", "_salt")
    order = group.orderBy("n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    step = F.greatest(F.lit(1), F.lit(limit) - F.max("n_bytes").over(group))
    parts = same.withColumn("_part", F.floor(F.coalesce(F.sum("n_bytes").over(order), F.lit(0)) / step))
    by = Window.partitionBy("_h", "_salt", "_part")
    return (
        parts.withColumn("shard_bytes", F.sum("n_bytes").over(by)).withColumn("shard_docs", F.count("*").over(by)).withColumn("depth", F.lit(BITS).cast("long"))
        .withColumn("shard", F.concat_ws(".", prefix_text(F.col("_h"), F.lit(BITS)), F.col("_salt").cast("string"), F.col("_part").cast("string"))).drop("_salt", "_part")
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> None:
    """Write each shard as a folder ``shard=<bits>`` of Parquet files."""
    assign(docs, key, text, limit).withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document with its shard."""
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", "oversized")


def oracle(limit: int = LIMIT_BYTES) -> str:
    """DuckDB SQL: the bytes of every prefix of every document, then the shortest that fits. Holds where no two rows share a hash and are oversized together."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS h FROM documents),
p AS (SELECT k AS depth, h >> ({BITS} - k) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM d, generate_series(0, {BITS}) g(k) GROUP BY ALL HAVING sum(n_bytes) <= {limit} OR count(*) = 1),
m AS (SELECT d.doc_id, d.n_bytes, d.h, min(p.depth) AS depth FROM d JOIN generate_series(0, {BITS}) g(k) ON true JOIN p ON p.depth = g.k AND p.prefix = d.h >> ({BITS} - g.k) GROUP BY ALL)
SELECT m.doc_id, m.n_bytes, CASE WHEN m.depth = 0 THEN '' ELSE right(lpad(bin(p.prefix), 64, '0'), m.depth::INTEGER) END AS shard, m.depth::BIGINT AS depth, p.shard_bytes, p.shard_docs, p.shard_bytes > {limit} AS oversized
FROM m JOIN p ON p.depth = m.depth AND p.prefix = m.h >> ({BITS} - m.depth)"""
