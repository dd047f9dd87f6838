"""Least-cost pairs of contacts and vessels of a scene and their rivals, without a table of pairs.

A scene is solved in one task, in memory that grows with its rows: each vessel starts with a few of its nearest contacts in order, and all that it may
pair with is looked up only when a path could go through one beyond them. What lies beyond costs more than the last of the few, so the total is that over all pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.functions.geo import EARTH_M
from pelagos.operators.around import BLOCK, SLACK
from pelagos.operators.matching import LIVE, Match, gate_metres, live_quality
from pelagos.operators.rivals import Tile

#: Nearest contacts that a vessel starts with.
FEW = 8

#: A row's columns and prices, cheapest first, and a price below which none is missing.
Row = tuple[list[int], list[float], float]


def cheapest(rows: list[Row], gate: list[float], m: int, whole: Callable[[int], Row]) -> list[int]:
    """Least-cost assignment of rows to ``m`` columns by shortest augmenting paths, where a row may stay without one for its gate; ``whole`` gives all of a row. Returns each row's column, or -1."""
    rows = list(rows)
    owner, relief, paid = [-1] * m, [0.0] * m, [0.0] * m
    pick = [-1] * len(rows)
    inf = float("inf")
    for i in range(len(rows)):
        best: dict[int, float] = {}
        via: dict[int, tuple[int, float]] = {}
        heap: list[tuple[float, int]] = []
        used: set[int] = set()
        later: dict[int, float] = {}
        row, less, alone, most, who, end = i, 0.0, inf, inf, i, -1
        length = 0.0
        while True:
            if gate[row] - less < alone:
                alone, who = gate[row] - less, row
                most = min(most, alone)
            columns, prices, bound = rows[row]
            for j, price in zip(columns, prices, strict=True):
                if price - less >= most:  # reliefs are never positive, so what follows is no cheaper
                    break
                reduced = price - relief[j] - less
                if reduced < most and j not in used and reduced < best.get(j, inf):
                    best[j], via[j] = reduced, (row, price)
                    heapq.heappush(heap, (reduced, j))
                    if owner[j] < 0:
                        most = reduced
            if bound - less < most:
                later[row] = less
                heapq.heappush(heap, (bound - less, -1 - row))
            while heap and heap[0][1] >= 0 and (heap[0][1] in used or heap[0][0] > best[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= alone:
                length = alone
                break
            length, j = heapq.heappop(heap)
            if j < 0:
                row = -1 - j
                less = later[row]
                rows[row] = whole(row)
                continue
            if owner[j] < 0:
                end = j
                break
            used.add(j)
            row = owner[j]
            less = paid[j] - relief[j] - length
        for j in used:
            relief[j] += best[j] - length
        if end < 0:
            # ``who`` goes without; the column that it leaves goes to the row on its way.
            end = pick[who] if who != i else -1
            pick[who] = -1
        while end >= 0:
            row, price = via[end]
            before = pick[row]
            pick[row], owner[end], paid[end] = end, row, price
            end = before if row != i else -1
    return pick


class Scene(Tile):
    """Contacts and vessels of a whole scene."""

    def __init__(self, contacts: pa.Table, vessels: pa.Table, cfg: Match):
        super().__init__(contacts, vessels, cfg)
        self.by_cell_c = np.argsort(self.key_c, kind="stable")
        self.sorted_c = self.key_c[self.by_cell_c]
        self.cell_v = np.empty(len(self.key_v), np.int64)
        self.cell_v[self.by_cell] = self.key_v

    def _feasible(self, j: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of the unit vectors of vessels and contacts, and whether the pairs are feasible."""
        dot = self.uv[:, j].T @ self.uc[:, near]
        cut = self.cut[j][:, None]
        ok = dot >= cut - SLACK
        x, y = np.nonzero(ok & (dot < cut + SLACK))
        if len(x):
            ok[x, y] = self.metres(near[y], j[x]) <= self.gate[j[x]]
        ok &= ~(self.length[near] / self.hull[j][:, None] < self.cfg.min_length_ratio)
        ok &= ~(self.fixed[near] & self.under_way[j][:, None])
        return dot, ok

    def _around(self, cell: int) -> np.ndarray:
        at = [np.searchsorted(self.sorted_c, [cell + step * self.span - 1, cell + step * self.span + 2]) for step in (-1, 0, 1)]
        return np.sort(np.concatenate([self.by_cell_c[a:z] for a, z in at]))

    def whole(self, j: int) -> Row:
        """All feasible contacts of a vessel."""
        near = self._around(int(self.cell_v[j]))
        near = near[self._feasible(np.array([j]), near)[1][0]]
        d = self.metres(near, np.full(len(near), j))
        order = np.argsort(d, kind="stable")
        return near[order].tolist(), d[order].tolist(), float("inf")

    def nearest(self) -> list[Row]:
        """Each vessel's nearest feasible contacts."""
        out: list[Row] = [([], [], float("inf"))] * len(self.cell_v)
        cells, starts = np.unique(self.key_v, return_index=True)
        for cell, mine in zip(cells.tolist(), np.split(self.by_cell, starts[1:]), strict=True):
            near = self._around(cell)
            if not len(near):
                continue
            step = max(1, BLOCK // len(near))
            for n in range(0, len(mine), step):
                j = mine[n : n + step]
                dot, ok = self._feasible(j, near)
                dot = np.where(ok, dot, -2.0)
                last = np.partition(dot, -FEW, axis=1)[:, -FEW] if len(near) > FEW else np.full(len(j), -2.0)
                # What is left out has a product less by more than it may be off, so it lies beyond the last one's distance.
                bound = np.where(last > -2.0, 2 * EARTH_M * np.arcsin(np.sqrt(np.clip(1 - last, 0.0, 2.0) / 2)), np.inf)
                x, y = np.nonzero(ok & (dot >= last[:, None] - SLACK))
                d = self.metres(near[y], j[x])
                order = np.lexsort((y, d, x))
                x, y, d = x[order], near[y[order]].tolist(), d[order].tolist()
                ends = np.searchsorted(x, np.arange(len(j) + 1)).tolist()
                for k, (v, b) in enumerate(zip(j.tolist(), bound.tolist(), strict=True)):
                    out[v] = (y[ends[k] : ends[k + 1]], d[ends[k] : ends[k + 1]], b)
        return out


def matched(contacts: DataFrame, placed: DataFrame, cfg: Match = LIVE, speed: str = "speed_kn") -> DataFrame:
    """``contacts`` (scene_id, det_id, lon, lat, length_m, confidence) with mmsi, dist_m, dt_s, gate_m, method and match_quality of their placed vessel by least total distance per scene, where leaving a
    vessel unpaired costs its gate; null where the pair is ambiguous. ambiguous, alt_dist_m and candidates are as in ``matching.ambiguity``. Rows of one det_id in a scene are one contact."""
    v = placed.select("scene_id", "mmsi", "lon", "lat", F.col("length_m").cast("double").alias("length_m"), F.coalesce("sog_kn", speed).cast("double").alias("speed_kn"), "dt_s", "method").dropna(subset=["scene_id", "mmsi", "lon", "lat"])
    v = v.withColumn("gate_m", gate_metres(F.col("speed_kn"), cfg).cast("double"))
    a = contacts.select("scene_id", F.struct(*contacts.columns).alias("_c"))
    b = v.select("scene_id", F.struct(*(c for c in v.columns if c != "scene_id")).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    taken = ["mmsi", "dt_s", "method", "gate_m", "speed_kn", "length_m"]
    kinds = dict(v.dtypes)
    shape = ", ".join([*(f"`c_{c}` {k}" for c, k in contacts.dtypes), *(f"_{c} {kinds[c]}" for c in taken)]) + ", _dist_m double, ambiguous boolean, alt_dist_m double, candidates string"

    def run(group: pa.Table) -> pa.Table:
        held, v = (pa.Table.from_struct_array(x.filter(x.is_valid())).combine_chunks() for x in (group.column(n).combine_chunks() for n in ("_c", "_v")))
        held = held.sort_by("det_id").combine_chunks()
        v = v.sort_by("mmsi").combine_chunks()
        # The rows that take part, and for each row of the scene its place among them.
        code = held.column("det_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = np.flatnonzero((code >= 0) & ~np.isnan(_number(held, "lon")) & ~np.isnan(_number(held, "lat")) & held.column("scene_id").is_valid().to_numpy())
        names, first = np.unique(code[known], return_index=True)
        at = np.searchsorted(names, code)
        at[(at == len(names)) | (code < 0)] = len(names)
        inside = at < len(names)
        at[inside] = np.where(names[at[inside]] == code[inside], at[inside], len(names))
        n, m = len(names), v.num_rows
        pair_c, d_c, alt, who = np.full(n + 1, -1), np.full(n + 1, np.nan), np.full(n + 1, np.inf), np.full(n + 1, None, object)
        if n and m:
            c = held.take(pa.array(known[first])).combine_chunks()
            c = c.append_column("fixed", pc.equal(c.column("confidence"), "fixed"))
            c = c.set_column(c.column_names.index("length_m"), "length_m", c.column("length_m").cast(pa.float64()))
            s = Scene(c, v, cfg)
            pair_v = np.array(cheapest(s.nearest(), s.gate.tolist(), n, s.whole), np.int64)
            own = np.flatnonzero(pair_v >= 0)
            d_v = np.full(m, np.inf)
            d_v[own] = s.metres(pair_v[own], own)
            pair_c[pair_v[own]], d_c[pair_v[own]] = own, d_v[own]
            x, y, d = s.rivals(pair_c[:n], pair_v, np.where(pair_c[:n] >= 0, d_c[:n], np.inf), d_v)
            alt_v = np.full(m, np.inf)
            np.minimum.at(alt, x[pair_c[x] >= 0], d[pair_c[x] >= 0])
            np.minimum.at(alt_v, y[pair_v[y] >= 0], d[pair_v[y] >= 0])
            got = np.flatnonzero(pair_c >= 0)
            alt[got] = np.minimum(alt[got], alt_v[pair_c[got]])
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            ids = np.array(v.column("mmsi").cast(pa.string()).to_pylist(), object)
            got = got[np.isfinite(alt[got])]
            for k, p, lo, hi in zip(got.tolist(), pair_c[got].tolist(), np.searchsorted(x, got).tolist(), np.searchsorted(x, got, side="right").tolist(), strict=True):
                who[k] = ";".join(sorted({ids[p], *ids[y[lo:hi]]}))
        p = pair_c[at]
        mine = v.take(pa.array(np.maximum(p, 0), mask=p < 0))
        ambiguous = np.isfinite(alt[at]) & (p >= 0)
        out = {f"c_{c}": held.column(c) for c in held.column_names} | {f"_{c}": mine.column(c) for c in taken}
        return pa.table(out | {"_dist_m": pa.array(d_c[at], mask=p < 0), "ambiguous": pa.array(ambiguous), "alt_dist_m": pa.array(alt[at], mask=~ambiguous), "candidates": pa.array(np.where(ambiguous, who[at], None).tolist(), pa.string())})

    # Few bytes are much work, so the partitions keep their number, which adaptive execution would lower.
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = both.repartition(parts, "scene_id").groupBy("scene_id").applyInArrow(run, shape)
    firm = ~F.col("ambiguous")
    quality = live_quality(F.col("_dist_m"), F.col("_dt_s"), F.col("_speed_kn"), F.col("c_length_m"), F.col("_length_m"))
    return out.select(*(F.col(f"`c_{c}`").alias(c) for c in contacts.columns), "ambiguous", "alt_dist_m", "candidates", *(F.when(firm, F.col(f"_{c}")).alias(c) for c in ("mmsi", "dist_m", "dt_s", "gate_m", "method")), F.when(firm, quality).alias("match_quality"))


def _number(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
