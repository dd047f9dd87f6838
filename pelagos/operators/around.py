"""What lies around each point, without a table of pairs.

Right rows go to the cells that their circle touches, left rows to their own, so all that lies within the radius of a left row is in one group
of cell (and of the ``extra`` keys). A group is worked in blocks of BLOCK pairs and gives the left rows with new columns: what is shuffled grows with
the rows, however dense they lie, and only a group's rows, never its pairs, are in memory. Left rows are not joined back; those without a place or key meet nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pelagos.functions.geo import EARTH_M, KM_PER_DEGREE
from pelagos.operators.proximity import _covering

#: Pairs of a block.
BLOCK = 2_000_000
#: How far a product of unit vectors may be off; closer cases take the exact distance.
SLACK = 4e-15


def _haversine(lon1, lat1, lon2, lat2, earth_m: float) -> np.ndarray:
    """Metres, term by term as ``geo.haversine_m``."""
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * earth_m * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    x, y = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)])


def column(table: pa.Table, name: str) -> np.ndarray:
    """A column of numbers or times as an array; nulls are NaN in floats and the least value in whole numbers."""
    c = table.column(name).combine_chunks()
    if pa.types.is_timestamp(c.type):
        c = c.cast(pa.int64())
    if pa.types.is_floating(c.type):
        return pc.fill_null(c, float("nan")).to_numpy(zero_copy_only=False)
    return pc.fill_null(c.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Whole numbers that are equal where the values of the columns are; -1 for null."""
    every = pc.dictionary_encode(pa.chunked_array([c for col in columns for c in col.chunks], columns[0].type).combine_chunks())
    if isinstance(every, pa.ChunkedArray):
        every = every.combine_chunks()
    flat = pc.fill_null(every.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(flat, np.cumsum([len(c) for c in columns])[:-1])


class Near:
    """Blocks of left rows with the right rows within the radius."""

    def __init__(self, left: pa.Table, right: pa.Table, radius_m: float, earth_m: float):
        self.left, self.right, self.radius_m, self.earth_m = left, right, radius_m, earth_m
        self.a, self.b = [[column(t, c).astype(float) for c in ("lon", "lat")] for t in (left, right)]
        self.cut = 1 - 2 * np.sin(min(radius_m / earth_m, np.pi) / 2) ** 2

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact metres of pairs of rows."""
        return _haversine(self.a[0][i], self.a[1][i], self.b[0][j], self.b[1][j], self.earth_m)

    def blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(left rows, products of their unit vectors with the right ones, whether within the radius)."""
        n, m = self.left.num_rows, self.right.num_rows
        step = max(1, BLOCK // max(1, m))
        ua, ub = _unit(*self.a).T.copy(), _unit(*self.b)
        for at in range(0, n, step):
            rows = slice(at, min(n, at + step))
            dot = ua[rows] @ ub
            hit = dot >= self.cut - SLACK
            i, j = np.divmod(np.flatnonzero(hit & (dot < self.cut + SLACK)), max(1, m))
            if len(i):
                hit[i, j] = self.distances(i + at, j) <= self.radius_m
            yield rows, dot, hit


#: Gives the new columns of a block of left rows; the right rows come in the order of ``by``.
Work = Callable[[Near], Iterator[tuple[slice, dict[str, pa.Array]]]]


def _cells(lon: Column, lat: Column, res: float) -> list[Column]:
    return [F.floor(lat / res).alias("_row"), F.floor(lon / res).alias("_col")]


def around(left: DataFrame, right: DataFrame, radius_m: float, work: Work, fields: str, by: tuple[str, ...] = (), extra: tuple[str, ...] = (), earth_m: float = EARTH_M) -> DataFrame:
    """``left`` (lon, lat) with the columns ``fields`` that ``work`` gives for each row and the rows of ``right`` (lon, lat) within the radius and equal in ``extra``.

    The right rows of a group come sorted by ``by``, nulls first.
    """
    res = max(0.01, 2 * radius_m / 1000 / KM_PER_DEGREE)
    rows, cols = _covering(F.col("lon"), F.col("lat"), radius_m, res)
    keys = [f"_key_{n}" for n in range(len(extra))]
    named = [F.col(c).alias(k) for c, k in zip(extra, keys, strict=True)]
    placed = right.where("lon is not null and lat is not null").dropna(subset=list(extra)) if extra else right.where("lon is not null and lat is not null")
    kept = [c for c in right.columns if c not in extra]
    b = placed.withColumn("_row", F.explode(rows)).withColumn("_col", F.explode(cols)).select("_row", "_col", *named, F.struct(*kept).alias("_right"))
    # Rows without a place are dealt out, so that they are no group of their own.
    astray = -(1 << 40) - F.pmod(F.xxhash64(*(c for c, t in left.dtypes if not t.startswith("map"))), F.lit(997))
    row, col = _cells(F.col("lon"), F.col("lat"), res)
    lost = F.col("lon").isNull() | F.col("lat").isNull()
    a = left.select(F.when(lost, astray).otherwise(row).alias("_row"), F.coalesce(col, F.lit(0)).alias("_col"), *named, F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("_left"), F.lit(None).cast(b.schema["_right"].dataType).alias("_right"))
    both = a.unionByName(b.withColumn("_left", F.lit(None).cast(a.schema["_left"].dataType)))
    out = StructType([*left.schema.fields, *StructType.fromDDL(fields).fields])
    names, new = left.columns, StructType.fromDDL(fields).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, theirs = [], []
        for batch in batches:
            for held, name in ((mine, "_left"), (theirs, "_right")):
                c = batch.column(batch.schema.get_field_index(name))
                c = c.filter(c.is_valid())
                if len(c):
                    held.append(pa.RecordBatch.from_arrays(c.flatten(), names=[f.name for f in c.type]))
                if name == "_right":
                    right_kind = pa.schema(list(c.type))
        if not mine:
            return
        table = pa.Table.from_batches(mine).combine_chunks()
        other = pa.Table.from_batches(theirs).combine_chunks() if theirs else right_kind.empty_table()
        if by and other.num_rows:
            other = other.take(pc.sort_indices(other, sort_keys=[(c, "ascending") for c in by], null_placement="at_start"))
        for part, found in work(Near(table, other, radius_m, earth_m)):
            rows = table.slice(part.start, part.stop - part.start).combine_chunks()
            arrays = [rows.column(c).combine_chunks() for c in names] + [found[c] for c in new]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *new])

    # Few bytes can be much work, so the partitions keep their number, which adaptive execution would lower.
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "_row", "_col", *keys).groupBy("_row", "_col", *keys).applyInArrow(run, out)


def first_of_equals(code: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)


def merged(hit: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Columns joined by runs: whether any of a run is hit."""
    if len(starts) == hit.shape[1]:
        return hit
    return np.logical_or.reduceat(hit, starts, axis=1)


def lists(hit: np.ndarray, ids: pa.Array) -> pa.Array:
    """Per row the ids of the columns that are hit, in their order."""
    flat = np.flatnonzero(hit)
    width = max(1, hit.shape[1])
    offsets = np.r_[0, np.cumsum(np.count_nonzero(hit, axis=1))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), ids.take(pa.array(flat % width)))


def closest(near: Near, rows: slice, dot: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of a block the nearest hit column, the first of equals (-1 if none), and its exact distance."""
    n, m = hit.shape
    best, metres = np.full(n, -1), np.full(n, np.nan)
    if m == 0:
        return best, metres
    dot = np.where(hit, dot, -2.0)
    i, j = np.divmod(np.flatnonzero((dot >= dot.max(axis=1, keepdims=True) - SLACK) & hit), m)
    d = near.distances(i + rows.start, j)
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    at = first_of_equals(i)
    best[i[at]], metres[i[at]] = j[at], d[at]
    return best, metres


def picked(column: pa.ChunkedArray, at: np.ndarray) -> pa.Array:
    """Values at places; null where the place is -1."""
    out = column.combine_chunks().take(pa.array(np.maximum(at, 0), mask=at < 0))
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def floats(x: np.ndarray) -> pa.Array:
    """Floats with NaN as null."""
    return pa.array(x, mask=np.isnan(x))


def nearest(left: DataFrame, right: DataFrame, right_key: str, radius_m: float, also: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with nearest_id, the id of the nearest right row within the radius (ties to the smaller id), nearest_m, and near_<c> for its columns ``also``; nulls if none."""
    kinds = dict(right.dtypes)
    fields = ", ".join([f"nearest_id {kinds[right_key]}", "nearest_m double", *(f"near_{c} {kinds[c]}" for c in also)])

    def work(near: Near) -> Iterator[tuple[slice, dict[str, pa.Array]]]:
        for rows, dot, hit in near.blocks():
            at, d = closest(near, rows, dot, hit)
            yield rows, {"nearest_id": picked(near.right.column(right_key), at), "nearest_m": floats(d)} | {f"near_{c}": picked(near.right.column(c), at) for c in also}

    columns = dict.fromkeys([right_key, "lon", "lat", *also, *extra])
    return around(left, right.select(*columns), radius_m, work, fields, by=(right_key,), extra=extra)


def count_different(left: DataFrame, right: DataFrame, counted: str, radius_m: float, name: str = "n_within", extra: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with ``name``: how many different known values of ``counted`` lie within the radius."""

    def work(near: Near) -> Iterator[tuple[slice, dict[str, pa.Array]]]:
        starts = first_of_equals(codes(near.right.column(counted))[0])
        for rows, _, hit in near.blocks():
            yield rows, {name: pa.array(np.count_nonzero(merged(hit, starts), axis=1).astype(np.int64))}

    return around(left, right.where(F.col(counted).isNotNull()).select(counted, "lon", "lat", *extra), radius_m, work, f"{name} long", by=(counted,), extra=extra)


def _ids_or_counts(hit: np.ndarray, starts: np.ndarray, ids: pa.ChunkedArray, name: str, count: bool) -> dict[str, pa.Array]:
    hit = merged(hit, starts)
    if count:
        return {name: pa.array(np.count_nonzero(hit, axis=1).astype(np.int64))}
    return {name: lists(hit, ids.combine_chunks().take(pa.array(starts)))}


def in_span(left: DataFrame, right: DataFrame, at: str, right_key: str, start: str, stop: str, radius_m: float, pad_us: int, name: str, count: bool = False) -> DataFrame:
    """``left`` with ``name``: the sorted different ids (text), or with ``count`` their number, of right rows within the radius whose span, padded, holds the time ``at``."""
    other = right.select(F.col(right_key).cast("string").alias("id"), "lon", "lat", F.unix_micros(F.col(start)).alias("t0"), F.unix_micros(F.col(stop)).alias("t1")).dropna(subset=["id", "t0", "t1"])

    def work(near: Near) -> Iterator[tuple[slice, dict[str, pa.Array]]]:
        starts = first_of_equals(codes(near.right.column("id"))[0])
        t0, t1, t = column(near.right, "t0") - pad_us, column(near.right, "t1") + pad_us, column(near.left, at)
        for rows, _, hit in near.blocks():
            hit &= (t[rows, None] >= t0) & (t[rows, None] <= t1)
            yield rows, _ids_or_counts(hit, starts, near.right.column("id"), name, count)

    return around(left, other, radius_m, work, f"{name} long" if count else f"{name} array<string>", by=("id",))


def seen_again(left: DataFrame, pool: DataFrame, radius_m: float, most_us: int, least_us: int, name: str, count: bool = False) -> DataFrame:
    """``left`` (det_id, acq, pass_id) with ``name``: the sorted different ids, or with ``count`` their number, of rows of the pool within the radius, other than itself and of another pass, more than ``least_us`` and at most ``most_us`` apart in time."""
    other = pool.select("det_id", "lon", "lat", "acq", "pass_id").dropna(subset=["det_id", "acq"])

    def work(near: Near) -> Iterator[tuple[slice, dict[str, pa.Array]]]:
        starts = first_of_equals(codes(near.right.column("det_id"))[0])
        (a, b), (p, q) = (codes(near.left.column(c), near.right.column(c)) for c in ("det_id", "pass_id"))
        t, u = column(near.left, "acq"), column(near.right, "acq")
        known = (a >= 0) & (t != np.iinfo(np.int64).min)
        for rows, _, hit in near.blocks():
            dt = np.abs(t[rows, None] - u)
            hit &= (dt <= most_us) & (dt > least_us) & (a[rows, None] != b) & ((p[rows, None] != q) | (p[rows, None] < 0)) & known[rows, None]
            yield rows, _ids_or_counts(hit, starts, near.right.column("det_id"), name, count)

    return around(left, other, radius_m, work, f"{name} long" if count else f"{name} array<string>", by=("det_id",))


def nearest_few(left: DataFrame, right: DataFrame, entity: str, left_ts: str, right_ts: str, radius_m: float, seconds: int, n: int, name: str = "near") -> DataFrame:
    """``left`` with ``name``: the ``n`` nearest different values of ``entity`` within the radius and ``seconds``, each by its nearest row, as structs (id, dist_m) by distance, then id."""
    unit = seconds * 1_000_000
    slot = lambda c: F.floor(F.unix_micros(F.col(c)) / unit)
    other = right.dropna(subset=[entity, right_ts]).select(F.col(entity).alias("id"), "lon", "lat", F.col(right_ts).alias("_t"), F.explode(F.sequence(slot(right_ts) - 1, slot(right_ts) + 1)).alias("_slot"))
    kind = dict(other.dtypes)["id"]

    def work(near: Near) -> Iterator[tuple[slice, dict[str, pa.Array]]]:
        code = codes(near.right.column("id"))[0]
        starts = first_of_equals(code)
        vessel = np.cumsum(np.r_[False, code[1:] != code[:-1]]) if len(code) else code
        t, u = column(near.left, left_ts), column(near.right, "_t")
        ids = near.right.column("id").combine_chunks()
        for rows, dot, hit in near.blocks():
            many = hit.shape[0]
            hit &= np.abs(t[rows, None] - u) <= unit
            i = j = np.zeros(0, np.int64)
            d = np.zeros(0)
            if len(starts):
                # The n-th best of the entities' best products bounds what may be among the nearest.
                best = np.maximum.reduceat(np.where(hit, dot, -2.0), starts, axis=1)
                bound = np.partition(best, -n, axis=1)[:, -n] if best.shape[1] > n else best.min(axis=1)
                i, j = np.divmod(np.flatnonzero(hit & (dot >= bound[:, None] - SLACK)), hit.shape[1])
                d = near.distances(i + rows.start, j)
                order = np.lexsort((d, vessel[j], i))
                i, j, d = i[order], j[order], d[order]
                own = first_of_equals(i * (int(vessel[-1]) + 1) + vessel[j])
                i, j, d = i[own], j[own], d[own]
                order = np.lexsort((vessel[j], d, i))
                i, j, d = i[order], j[order], d[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, d = i[rank < n], j[rank < n], d[rank < n]
            offsets = np.searchsorted(i, np.arange(many + 1)).astype(np.int32)
            yield rows, {name: pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([ids.take(pa.array(j)), pa.array(d)], names=["id", "dist_m"]))}

    out = around(left.withColumn("_slot", slot(left_ts)), other, radius_m, work, f"{name} array<struct<id:{kind},dist_m:double>>", by=("id",), extra=("_slot",))
    return out.drop("_slot")


def meetings(df: DataFrame, entity: str, ts: str, radius_m: float, seconds: int) -> DataFrame:
    """``df`` with n and nearest_m: how many rows of other entities lie within the radius and ``seconds``, before or after, and the least distance (null if none)."""
    unit = seconds * 1_000_000
    t = F.unix_micros(F.col(ts))
    other = df.select(F.col(entity).alias("e"), "lon", "lat", t.alias("t")).dropna(subset=["e", "t"])
    # Slots of twice the window: a row's window touches two.
    other = other.withColumn("_slot", F.explode(F.sequence(F.floor((F.col("t") - unit) / (2 * unit)), F.floor((F.col("t") + unit) / (2 * unit)))))

    def work(near: Near) -> Iterator[tuple[slice, dict[str, pa.Array]]]:
        e, f = codes(near.left.column(entity), near.right.column("e"))
        t, u = column(near.left, ts), column(near.right, "t")
        for rows, dot, hit in near.blocks():
            hit &= (u >= t[rows, None] - unit) & (u <= t[rows, None] + unit) & (e[rows, None] != f) & (e[rows, None] >= 0)
            _, d = closest(near, rows, dot, hit)
            yield rows, {"n": pa.array(np.count_nonzero(hit, axis=1).astype(np.int64)), "nearest_m": floats(d)}

    return around(df.withColumn("_slot", F.floor(t / (2 * unit))), other, radius_m, work, "n long, nearest_m double", by=("t",), extra=("_slot",)).drop("_slot")


def heard_by_hour(left: DataFrame, right: DataFrame, entity: str, left_ts: str, right_ts: str, reach_m: float, count_m: float, max_dh: int) -> DataFrame:
    """``left`` with near_<entity>, near_m and near_dh of the nearest row within ``reach_m`` and ``max_dh`` hours of its hour (ties to the earlier hour, then the smaller id), and n_near, how many different entities of its own hour lie within ``count_m``."""
    hour = lambda c: F.floor(F.unix_seconds(F.col(c)) / 3600)
    spread = F.explode(F.sequence(F.lit(-max_dh), F.lit(max_dh)))
    # dh counts from the left row's hour, so a row of hour h meets the left rows of h - dh.
    other = right.dropna(subset=[entity, right_ts]).select(F.col(entity).alias("id"), "lon", "lat", hour(right_ts).alias("_h")).distinct().withColumn("dh", spread).withColumn("_h", F.col("_h") - F.col("dh"))
    kind = dict(other.dtypes)["id"]

    def work(near: Near) -> Iterator[tuple[slice, dict[str, pa.Array]]]:
        dh = column(near.right, "dh")
        own = np.searchsorted(dh, [0, 1])
        code = codes(near.right.column("id"))[0]
        starts = first_of_equals(code[own[0] : own[1]])
        reach = 1 - 2 * np.sin(reach_m / near.earth_m / 2) ** 2
        counted = 1 - 2 * np.sin(count_m / near.earth_m / 2) ** 2
        for rows, dot, hit in near.blocks():
            within = []
            for metres, cut in ((reach_m, reach), (count_m, counted)):
                ok = hit & (dot >= cut - SLACK)
                i, j = np.divmod(np.flatnonzero(ok & (dot < cut + SLACK)), max(1, ok.shape[1]))
                if len(i):
                    ok[i, j] = near.distances(i + rows.start, j) <= metres
                within.append(ok)
            at, d = closest(near, rows, dot, within[0])
            n = np.count_nonzero(merged(within[1][:, own[0] : own[1]], starts), axis=1) if len(starts) else np.zeros(len(at), np.int64)
            yield rows, {f"near_{entity}": picked(near.right.column("id"), at), "near_m": floats(d), "near_dh": picked(near.right.column("dh"), at), "n_near": pa.array(n.astype(np.int64))}

    out = around(left.withColumn("_h", hour(left_ts)), other, max(reach_m, count_m), work, f"near_{entity} {kind}, near_m double, near_dh int, n_near long", by=("dh", "id"), extra=("_h",))
    return out.drop("_h")
