"""Graph operators on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.storage import discard, materialise


#: Edges that a task contracts at once.
CHUNK = 2_000_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as the stars of what hangs together among up to CHUNK of them: no more edges than nodes, and the same components."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        x, y = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while True:
            least = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], least)
            np.minimum.at(new, root[y], least)
            while (new[new] != new).any():
                new = new[new]
            new = new[root]
            if (new == root).all():
                break
            root = new
        own = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= CHUNK:
            yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _settled(edge: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: every u has one v, and no v is a u."""
    ends = edge.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edge.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the component's smallest node.

    Each task first contracts its own edges (whole numbers only), so what follows has no more edges than nodes a task. Then two star
    contractions alternate, one towards larger and one towards smaller neighbours, until the edges are stars. Sums by node are partial on the map side, a hub's join is split at run time, and a round's table
    is deleted when the next one is written. Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    edge = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    edge = edge.distinct()
    kind = edge.schema["u"].dataType.simpleString()
    if kind in ("bigint", "int"):
        edge = edge.mapInArrow(_contracted, f"u {kind}, v {kind}").distinct()
    edge = materialise(edge, "edges")
    if kind in ("bigint", "int") and edge.count() <= CHUNK:  # what one task contracts is settled at once
        first, edge = edge, materialise(edge.coalesce(1).mapInArrow(_contracted, f"u {kind}, v {kind}"), "stars")
        discard(first)
    for _ in range(max_rounds):
        if _settled(edge):
            break
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edge = edge, materialise(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "stars")
        discard(before, large)
    else:
        raise RuntimeError("components did not settle")
    roots = edge.select("v").distinct()
    return edge.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
