"""Greedy one-to-one pairing of placed vessels with contacts, without a table of pairs.

The pairs have one total order, so walking them cheapest first gives what vessels give that claim their cheapest contact and, when it goes to a cheaper pair,
their next one; the order of the claims does not matter. So each round looks for a few contacts of the vessels that have none, leaving out those that hold a cheaper pair,
in circles that widen up to the radius, until no vessel without a contact finds another. Tiles of a scene are worked in blocks; what is shuffled grows with the rows, however dense they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions.geo import EARTH_M, KM_PER_DEGREE
from pelagos.operators import assign
from pelagos.operators.around import BLOCK, SLACK, _haversine, _unit, column
from pelagos.operators.proximity import _covering
from pelagos.storage import materialise

#: Contacts that a vessel claims in a round, in order; it looks for more if all are lost.
CLAIMS = 16
#: The first circle is this part of the radius, and each next one that many times wider than the one before.
FIRST, WIDER = 16, 16


def _found(contacts: DataFrame, placed: DataFrame, radius_m: float, keep_m: float, cand_m: float) -> DataFrame:
    """(ia, ib, cost): each vessel's cheapest contacts within the circle, CLAIMS at most, that hold nothing cheaper (h_cost, h_ib) and lie within ``cand_m`` of one of its reports (own)."""
    tile = max(0.05, 2 * radius_m / 1000 / KM_PER_DEGREE)
    rows, cols = _covering(F.col("lon"), F.col("lat"), radius_m, tile)
    keys = ["acq", "_row", "_col"]
    v = placed.withColumn("_row", F.explode(rows)).withColumn("_col", F.explode(cols)).select(*keys, F.struct("ib", "lon", "lat", "slow", "own").alias("_v"))
    c = contacts.select("acq", F.floor(F.col("lat") / tile).alias("_row"), F.floor(F.col("lon") / tile).alias("_col"), F.struct("ia", "lon", "lat", "h_cost", "h_ib").alias("_c"))
    both = v.unionByName(c, allowMissingColumns=True)
    cut = 1 - 2 * np.sin(min(radius_m / EARTH_M, np.pi) / 2) ** 2

    def run(group: pa.Table) -> pa.Table:
        c, v = (pa.Table.from_struct_array(x.filter(x.is_valid())) for x in (group.column(n).combine_chunks() for n in ("_c", "_v")))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        n, m = v.num_rows, c.num_rows
        if n and m:
            ia, ib, h_ib, h_cost = column(c, "ia"), column(v, "ib"), column(c, "h_ib"), column(c, "h_cost")
            h_cost = np.where(np.isnan(h_cost), np.inf, h_cost)
            (clon, clat), (vlon, vlat) = ([column(t, x) for x in ("lon", "lat")] for t in (c, v))
            slow = column(v, "slow")
            own = v.column("own").combine_chunks()
            begin = np.r_[0, np.cumsum(own.value_lengths().to_numpy())]
            rlon, rlat = (own.flatten().field(x).to_numpy() for x in ("lon", "lat"))
            uc, uv = _unit(clon, clat), _unit(vlon, vlat).T.copy()
            step = max(1, BLOCK // m)
            for at in range(0, n, step):
                x, y = np.nonzero(uv[at : at + step] @ uc >= cut - SLACK)
                x += at
                d = _haversine(clon[y], clat[y], vlon[x], vlat[x], EARTH_M)
                cost = d / 1000 + slow[x]
                # Farther pairs may round to the same cost as the circle's rim; they come with the next circle.
                ok = (d <= radius_m) & ((radius_m >= keep_m) | (cost < radius_m / 1000 + slow[x])) & ((cost < h_cost[y]) | ((cost == h_cost[y]) & (ib[x] < h_ib[y])))
                x, y, cost = x[ok], y[ok], cost[ok]
                many = begin[x + 1] - begin[x]
                pair = np.repeat(np.arange(len(x)), many)
                r = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + begin[x[pair]]
                heard = np.zeros(len(x), bool)
                heard[pair[_haversine(clon[y[pair]], clat[y[pair]], rlon[r], rlat[r], EARTH_M) <= cand_m]] = True
                x, y, cost = x[heard], y[heard], cost[heard]
                order = np.lexsort((ia[y], cost, x))
                x, y, cost = x[order], y[order], cost[order]
                first = np.arange(len(x)) - np.searchsorted(x, x) < CLAIMS
                out.append((ia[y[first]], ib[x[first]], cost[first]))
        return pa.table(dict(zip(("ia", "ib", "cost"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    # Few bytes can be much work, so the partitions keep their number, which adaptive execution would lower.
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, "ia long, ib long, cost double")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("ib").orderBy("cost", "ia"))).where(F.col("_n") <= CLAIMS).drop("_n")


def cheapest_first(contacts: DataFrame, placed: DataFrame, keep_m: float, cand_m: float) -> DataFrame:
    """(ia, ib, cost): contacts (ia, acq, lon, lat) and placed vessels (ib, acq, lon, lat, slow, own: the places of their reports) at most ``keep_m`` apart, one to one, as if all
    pairs were walked in the order (cost, ia, ib); the cost is the distance in km plus ``slow``. ia and ib are whole numbers; rows without id, time or place take no part."""
    contacts = contacts.select("ia", "acq", "lon", "lat").dropna()
    placed = placed.select("ib", "acq", "lon", "lat", "slow", "own").dropna()
    held = materialise(contacts.sparkSession.createDataFrame([], "ia long, ib long, cost double"), "held")
    radius_m = keep_m / FIRST
    while True:
        c = contacts.join(held.select("ia", F.col("cost").alias("h_cost"), F.col("ib").alias("h_ib")), "ia", "left")
        found = materialise(_found(c, placed.join(held, "ib", "left_anti"), radius_m, keep_m, cand_m), "claims")
        if radius_m >= keep_m and found.isEmpty():
            return held
        if not found.isEmpty():
            held = materialise(assign.greedy(found.unionByName(held)), "held")
        radius_m = min(keep_m, radius_m * WIDER)
