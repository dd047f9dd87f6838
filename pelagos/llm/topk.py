"""Exact top-k inner products as a Voronoi kNN join.

Pivots are a seeded, bounded choice of vectors; every vector belongs to its nearest pivot's cell, queries
as well as data. A cell's summary is its count, its radius and its largest norm. From these, a query
group's bound on its k-th score follows: cells whose least possible score is high, taken until they
hold k candidates. A cell goes to a group only if its largest possible score reaches that bound,
packed in blocks of bounded size; each (group, block) pair is solved locally by one matrix product,
and what the blocks give is merged per query.

With q in a group of centre c and radius s, and v in a cell of pivot p and radius r,
|q.v - c.p| <= s|p| + |c|r + sr, and |q.v| <= (|c| + s) * norm.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part;
vectors of different lengths never meet; a query's own id is no candidate, repeated ids of others
are candidates each, and the rows of one query id are ranked together; ties go to the smaller id; fewer candidates than k give fewer rows; an empty table
gives an empty result. Scores are exact while they stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

K, EVERY, SCALE = 10, 100, 1024
PIVOTS, GROUP_ROWS, BLOCK_ROWS, SEED = 64, 1024, 1024, 42
#: Queries that a group should have at least: fewer pivots group the queries than the data, so that blocks go to few groups.
LEAST_QUERIES = 128


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width).astype(np.float64)


def _blocks(rows: DataFrame, key: list[str], width: int) -> DataFrame:
    """Rows (vec_id, v, *key), clustered by ``key``, as (*key, ids, vectors) of at most BLOCK_ROWS rows each, as bytes."""
    dealt = rows.repartition(*key).sortWithinPartitions(*key, "vec_id").select("vec_id", "v", *key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [b.column(2 + i).to_numpy() for i in range(len(key))]
            change = np.zeros(b.num_rows, bool)
            for x in keys:
                change[1:] |= x[1:] != x[:-1]
            ids, vectors = b.column(0).to_numpy().astype("<i8"), _matrix(b.column(1), width)
            out: list[list] = [[] for _ in range(len(key) + 2)]
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(change)):
                for at in range(0, len(part), BLOCK_ROWS):
                    own = part[at : at + BLOCK_ROWS]
                    for i, x in enumerate(keys):
                        out[i].append(int(x[own[0]]))
                    out[-2].append(ids[own].tobytes())
                    out[-1].append(vectors[own].tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:-2]), pa.array(out[-2], pa.binary()), pa.array(out[-1], pa.binary())], names=[*key, "ids", "vectors"])

    return dealt.mapInArrow(run, ", ".join(f"{k} long" for k in key) + ", ids binary, vectors binary")


def _cells(rows: DataFrame, pivots: np.ndarray, homes: int) -> DataFrame:
    """Adds the nearest pivot (``cell``) and the distance to it, the norm, and the nearest of the first ``homes`` pivots with its distance."""
    width = pivots.shape[1]
    square = (pivots * pivots).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(2), width)
            cell = np.argmin(square - 2 * (v @ pivots.T), axis=1)
            home = np.argmin(square[:homes] - 2 * (v @ pivots[:homes].T), axis=1)
            far, spread = (np.sqrt(((v - pivots[x]) ** 2).sum(1)) for x in (cell, home))
            more = [pa.array(cell.astype(np.int64)), pa.array(far), pa.array(np.sqrt((v * v).sum(1))), pa.array(home.astype(np.int64)), pa.array(spread)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "cell", "far", "norm", "home", "spread"])

    return rows.select("vec_id", "query", "v").mapInArrow(run, "vec_id long, query boolean, v array<long>, cell long, far double, norm double, home long, spread double")


def _wanted(groups: DataFrame, pivots: np.ndarray, cells: list, k: int, own_rows: int) -> DataFrame:
    """(cell, salt, target): the cells that may hold one of a group's k best, by the summaries alone; a query's id has ``own_rows`` rows at most."""
    at = np.array([c["cell"] for c in cells], np.int64)
    count, radius, norm = (np.array([c[x] for c in cells], float) for x in ("n", "radius", "norm"))
    own = pivots[at]
    length = np.sqrt((own * own).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, salt, spread = (b.column(i).to_numpy() for i in range(3))
            rows: list[tuple[int, int, int]] = []
            for h, g, s in zip(home, salt, spread, strict=True):
                c = pivots[h]
                size = np.sqrt(c @ c)
                mid, slack = own @ c, s * length + size * radius + s * radius
                slack = slack * (1 + 1e-9) + 1e-6  # rounding only widens the bounds
                low, high = np.maximum(mid - slack, -(size + s) * norm), np.minimum(mid + slack, (size + s) * norm * (1 + 1e-9))
                order = np.argsort(-low)
                enough = np.searchsorted(np.cumsum(count[order]), k + own_rows)  # so many may be the query's own
                bound = low[order[enough]] if enough < len(order) else -np.inf
                rows += [(int(h), int(g), int(t)) for t in at[high >= bound]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["home", "salt", "cell"])

    return groups.mapInArrow(run, "home long, salt long, cell long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, n_pivots: int = PIVOTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    clean = vectors.where(usable(F.col("embedding"))).select("vec_id", F.coalesce(is_query, F.lit(False)).alias("query"), scaled(F.col("embedding"), scale).alias("v"))
    clean = materialise(clean.where("vec_id is not null"), "vectors")
    widths = sorted(r[0] for r in clean.where("query").select(F.size("v")).distinct().collect())
    out = None
    for width in widths:
        part = _top_k(clean.where(F.size("v") == width), width, k, n_pivots, seed)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _top_k(rows: DataFrame, width: int, k: int, n_pivots: int, seed: int) -> DataFrame:
    # Distinct vectors only, or copies of one vector could be all pivots.
    chosen = rows.select("v", F.xxhash64("v", F.lit(seed)).alias("h")).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(n_pivots).collect()
    pivots = np.array([r["v"] for r in chosen], float)
    homes = max(1, min(len(pivots), rows.where("query").count() // LEAST_QUERIES))
    placed = materialise(_cells(rows, pivots, homes), "cells")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm")).collect()  # a row per pivot
    asked = {r["home"]: r["n"] for r in placed.where("query").groupBy("home").agg(F.count("*").alias("n")).collect()}
    salts = F.create_map(*(F.lit(x) for c, n in asked.items() for x in (int(c), -(-n // GROUP_ROWS))))
    queries = placed.where("query").withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts[F.col("home")]))
    groups = queries.groupBy("home", "salt").agg(F.max("spread").alias("spread"))
    repeats = placed.groupBy("vec_id").agg(F.count("*").alias("n"), F.max("query").alias("query")).where("query").agg(F.max("n")).first()[0] or 1
    wanted = _wanted(groups, pivots, cells, k, repeats)
    spare = {r["cell"]: r["n"] for r in cells}
    parts = F.create_map(*(F.lit(x) for c, n in spare.items() for x in (int(c), -(-n // BLOCK_ROWS))))
    data = _blocks(placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), parts[F.col("cell")])), ["cell", "block"], width)
    blocks = materialise(data, "blocks")
    asks = materialise(_blocks(queries, ["home", "salt"], width).withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"}), "queries")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = wanted.join(asks, ["home", "salt"]).join(blocks, "cell").select("q_ids", "q_vectors", "ids", "vectors").repartition(n)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, q, ids, v in zip(*(b.column(i) for i in range(4)), strict=True):
                q_ids, ids = np.frombuffer(q_ids.as_py(), "<i8"), np.frombuffer(ids.as_py(), "<i8")
                q, v = np.frombuffer(q.as_py()).reshape(-1, width), np.frombuffer(v.as_py()).reshape(-1, width)
                score = q @ v.T
                score[q_ids[:, None] == ids[None, :]] = -np.inf
                # Rows are sorted by id, so a stable order by score puts the smaller id first among ties.
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                got = np.take_along_axis(score, best, 1)
                keep = np.isfinite(got)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, keep.sum(1))), pa.array(ids[best[keep]]), pa.array(got[keep].astype(np.int64))], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best vectors for each vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % EVERY == 0)


def oracle(k: int = K, every: int = EVERY, scale: int = SCALE) -> str:
    good = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {good}),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % {every} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= {k}"""
