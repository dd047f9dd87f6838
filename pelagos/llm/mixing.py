"""Mix sources to target weights by capped water-filling, with DataFrame functions only.

Each source asks for a share of ``share`` times all words in proportion to its weight. A source whose
ask is above ``max_epochs`` times its own size is clamped there, and the excess is dealt anew by
weight among the others until none is above. A document is then taken ``floor(target / size)`` times
and once more if its seeded hash is at or below its source's cut-off, which makes the words taken
come within half a document of the target.

Defined cases: null text has size 0; a null source is a source of its own, last in code-point order;
sources of size 0 get target 0; sources take weights in turn by that order; rows that agree in doc_id
and text have equal hashes and are taken or left together; an empty table gives an empty result;
columns that are not read pass through ``mix`` unless they bear the names it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table, word_count

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (1, 2, 3), 1.0, 3, 42
HASH_BITS, BUCKET_BITS = 60, 12


def ranked(names: DataFrame, column: str, position: str) -> DataFrame:
    """``names`` with the position of each row in the order of ``column``, from 0, nulls last.

    Range partitions are counted and the counts summed up, so no task holds all rows.
    """
    key = F.col(column).asc_nulls_last()
    dealt = materialise(names.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()), "ranked")
    inner = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1)
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return inner.join(F.broadcast(before), "_part").withColumn(position, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def water_fill(sources: DataFrame, total: int) -> DataFrame:
    """``sources`` (name, source_size, weight, cap) with ``target``.

    Each round clamps every source that the present share lifts above its cap; only sums come to the driver.
    """
    level, clamped = 0.0, F.lit(False)
    while True:
        free = ~clamped
        row = sources.agg(
            F.sum(F.when(clamped, F.col("cap"))).alias("held"), F.sum(F.when(free, F.col("weight"))).alias("weight"), F.sum(F.when(clamped, 1)).alias("n")
        ).first()
        if not row["weight"]:
            break
        level = (total - (row["held"] or 0)) / row["weight"]
        above = clamped | (F.col("cap") < level * F.col("weight"))
        more = sources.agg(F.sum(F.when(above, 1))).first()[0] or 0
        if more == (row["n"] or 0):
            break
        clamped = F.col("cap") < level * F.col("weight")  # the level only rises, so earlier ones stay below
    return sources.withColumn("target", F.when(clamped, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight")))


def hash_of(seed: int):
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, repeats and taken."""
    docs = docs.drop("size", "source_size", "target", "repeats", "taken")
    low_bits = HASH_BITS - BUCKET_BITS
    narrow = materialise(docs.select("source", word_count(F.col("text")).alias("size"), hash_of(seed).alias("h")), "sizes")
    buckets = materialise(narrow.groupBy("source", F.shiftright("h", low_bits).alias("b")).agg(F.sum("size").alias("words")), "buckets")
    sources = ranked(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), "source", "place")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialise(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    filled = water_fill(sources, total if share == 1 else share * total)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    filled = materialise(filled.withColumn("whole", rate.cast("long")).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size")), "targets")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
    running = buckets.withColumn("upto", upto)
    asked = filled.select("source", "want")
    open_buckets = running.join(asked, same(running, asked)).drop(asked["source"]).where("want > 0 and upto - words <= want and upto > want")
    open_buckets = open_buckets.select("source", "b", (F.col("want") - (F.col("upto") - F.col("words"))).alias("left"))
    spread = narrow.withColumn("b", F.shiftright("h", low_bits))
    near = spread.join(open_buckets, same(spread, open_buckets) & (spread["b"] == open_buckets["b"])).select(spread["source"], spread["b"], "h", "size", "left")
    ties = near.groupBy("source", "b", "h", "left").agg(F.sum("size").alias("size"))
    inside = ties.withColumn("sofar", F.sum("size").over(Window.partitionBy("source", "b").orderBy("h")))
    cut = inside.groupBy("source", "b").agg(F.max(F.when(F.col("sofar") - F.col("size") / 2 <= F.col("left"), F.col("h"))).alias("at"))
    cut = cut.select("source", F.coalesce("at", F.shiftleft("b", low_bits) - 1).alias("cutoff"))
    plan = filled.join(cut, same(filled, cut), "left").select(filled["source"].alias("_source"), "source_size", "target", "whole", F.coalesce("cutoff", F.lit(-1).cast("long")).alias("cutoff"))
    plan = materialise(plan, "plan")
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn("_h", hash_of(seed))
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["_source"]))
    out = joined.withColumn("repeats", F.col("whole") + F.when(F.col("_h") <= F.col("cutoff"), 1).otherwise(0))
    return out.withColumn("taken", F.col("size") * F.col("repeats")).drop("_h", "_source", "whole", "cutoff")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def oracle(weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL: the water level from sorted caps instead of rounds, the cut-off from one ordered sum."""
    k = HASH_BITS // 4
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, {k}))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, list_value({", ".join(map(str, weights))})[k + 1] AS weight, source_size * {max_epochs} AS cap, (SELECT sum(size) FROM d)::BIGINT AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS k2, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS held,
    sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS free FROM w),
l AS (SELECT coalesce(arg_min((total - held)::DOUBLE / free, k2) FILTER (WHERE cap >= (total - held)::DOUBLE / free * weight), 'inf'::DOUBLE) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN cap < level * weight THEN cap::DOUBLE ELSE level * weight END AS target FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
c AS (SELECT g.source, g.h, g.size, r.target - r.whole * r.source_size AS want, sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h) AS sofar FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source),
x AS (SELECT source, max(h) AS cutoff FROM c WHERE sofar - size / 2 <= want AND want > 0 GROUP BY source)
SELECT d.doc_id, d.size, r.source_size, r.target, (d.size * (r.whole + CASE WHEN d.h <= coalesce(x.cutoff, -1) THEN 1 ELSE 0 END))::BIGINT AS taken,
    (r.whole + CASE WHEN d.h <= coalesce(x.cutoff, -1) THEN 1 ELSE 0 END)::BIGINT AS repeats
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source"""
