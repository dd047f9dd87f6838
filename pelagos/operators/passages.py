"""Which documents hold which passages, word for word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passages without an inner token that are compared with every document; more are an error.
MOST_SHORT = 10_000


def containing(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id) for every document whose text holds the passage's text; null and empty passages match nothing.

    A token inside a passage, neither its first nor its last, stands between white space wherever the passage stands, so a document that holds
    the passage has that token. Each passage is looked up by its rarest inner token among all passages' (the longest of equals). Passages of one or two tokens
    have none and are compared directly; they must be few.
    """
    b = passages.where(F.coalesce(F.col(text) != "", F.lit(False))).select(item_id, F.col(text).alias("_passage"))
    d = docs.where(F.col(text).isNotNull()).select(doc_id, F.col(text).alias("_text"))
    tokens = lambda c: F.split(F.col(c), r"\s+")
    inner = b.withColumn("_tokens", tokens("_passage"))
    inner = inner.withColumn("_inner", F.array_distinct(F.slice("_tokens", F.lit(2), F.greatest(F.size("_tokens") - 2, F.lit(0)))))
    each = inner.select(item_id, "_passage", F.explode("_inner").alias("_w"))
    counts = each.groupBy("_w").agg(F.count("*").alias("_n"))
    keys = each.join(counts, "_w").groupBy(item_id, "_passage").agg(F.min_by("_w", F.struct("_n", -F.length("_w"), "_w")).alias("_w"))
    held = d.select(doc_id, "_text", F.explode(F.array_distinct(tokens("_text"))).alias("_w")).join(keys.select("_w").distinct(), "_w", "left_semi")
    found = held.join(keys, "_w").where(F.col("_text").contains(F.col("_passage"))).select(doc_id, item_id)
    short = inner.where(F.size("_inner") == 0).select(item_id, "_passage").limit(MOST_SHORT + 1).collect()
    if len(short) > MOST_SHORT:
        raise ValueError("too many passages without an inner token")
    if short:
        table = F.array(*(F.struct(F.lit(r[item_id]).alias("item"), F.lit(r["_passage"]).alias("p")) for r in short))
        hits = F.explode(F.filter(table, lambda s: F.col("_text").contains(s["p"])))
        found = found.unionByName(d.select(doc_id, hits.alias("_h")).select(doc_id, F.col("_h.item").alias(item_id)))
    return found.distinct()
