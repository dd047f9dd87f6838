"""Queries on fields of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos.functions import geo
from pelagos.operators import grids
from pelagos.plans.registry import query
from pelagos.sources import views as v

W, N, RES, COLS = 99.0, 24.0, 1.0, 24
_FIELD = "f AS (SELECT p_partkey // 24 AS row, p_partkey % 24 AS col, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey * 7919 % 1000)::DOUBLE / 10 END AS value FROM part WHERE p_partkey < 700)"


def _field(spark, sf):
    k = F.col("p_partkey")
    return v.table(spark, sf, "part").where("p_partkey < 700").select(F.expr("p_partkey div 24").alias("row"), (k % 24).alias("col"), F.when(k % 13 != 0, (k * 7919 % 1000) / F.lit(10.0)).alias("value"))


@query(f"WITH {_FIELD}, a AS ({v.SQL_AIS}) SELECT event_id, value FROM a LEFT JOIN f ON f.row = floor(24.0::DOUBLE - lat)::BIGINT AND f.col = floor(lon - 99.0::DOUBLE)::BIGINT")
def field_at_points(spark, sf):
    return grids.sample_cells(v.ais(spark, sf).select("event_id", "lon", "lat"), _field(spark, sf), W, N, RES).select("event_id", "value")


@query(f"""WITH {_FIELD}, a AS (SELECT event_id, lon - 99.0::DOUBLE - 0.5 AS x, 24.0::DOUBLE - lat - 0.5 AS y FROM ({v.SQL_AIS})), k AS (SELECT event_id, floor(y)::BIGINT + dy AS row, floor(x)::BIGINT + dx AS col, (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM a, generate_series(0, 1) g(dy), generate_series(0, 1) h(dx)),
m AS (SELECT event_id, sum(w * value) / sum(w) AS value FROM k JOIN f USING (row, col) WHERE value IS NOT NULL AND w > 0 GROUP BY 1) SELECT a.event_id, round(m.value, 6) AS value FROM a LEFT JOIN m USING (event_id)""")
def field_bilinear(spark, sf):
    return grids.bilinear(v.ais(spark, sf).select("event_id", "lon", "lat"), _field(spark, sf), "event_id", W, N, RES).select("event_id", F.round("value", 6).alias("value"))


@query(f"WITH {_FIELD} SELECT floor(row / 3)::BIGINT AS row, floor(col / 3)::BIGINT AS col, round(avg(value), 6) AS value, round(CASE WHEN count(*) > 1 THEN stddev_pop(value) END, 6) AS sd, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY ALL")
def regridded(spark, sf):
    return grids.regrid(_field(spark, sf), 3).select("row", "col", F.round("value", 6).alias("value"), F.round("sd", 6).alias("sd"), "n")


@query(f"WITH {_FIELD} SELECT floor(row / 5)::BIGINT AS row, floor(col / 5)::BIGINT AS col, round(avg(CASE WHEN value < 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY ALL")
def never_imaged_share(spark, sf):
    """The share of fine cells that were hardly seen, in each coarse cell."""
    return grids.share_of(_field(spark, sf), 5, F.col("value") < 20).withColumn("share", F.round("share", 6))


_DY = f"{geo.KM_PER_DEGREE!r}::DOUBLE"
_GRAD = f"""{_FIELD}, v AS (SELECT * FROM f WHERE value IS NOT NULL), gr AS (SELECT f.row, f.col, sqrt(pow((s.value - n.value) / (2 * {_DY}), 2) + pow((e.value - w.value) / (2 * {_DY} * cos(radians(24 - (f.row + 0.5::DOUBLE)))), 2)) AS value FROM f JOIN v s ON s.row = f.row + 1 AND s.col = f.col JOIN v n ON n.row = f.row - 1 AND n.col = f.col JOIN v e ON e.row = f.row AND e.col = f.col + 1 JOIN v w ON w.row = f.row AND w.col = f.col - 1)"""


@query(f"WITH {_GRAD} SELECT row, col, round(value, 8) AS value FROM gr")
def field_gradient(spark, sf):
    return grids.gradient(_field(spark, sf), N, RES).select("row", "col", F.round("value", 8).alias("value"))


@query(f"WITH {_FIELD}, m AS (SELECT f.row + a AS row, f.col + b AS col, f.value FROM f, generate_series(-1, 1) g(a), generate_series(-1, 1) h(b) WHERE f.value IS NOT NULL) SELECT row, col, median(value) AS value FROM m GROUP BY ALL HAVING count(*) = 9")
def field_median(spark, sf):
    return grids.median_filter(_field(spark, sf))


@query(f"""WITH RECURSIVE {_GRAD}, c AS (SELECT row, col, value FROM gr WHERE value > 0.2), e AS (SELECT a.row * 24 + a.col AS a, b.row * 24 + b.col AS b FROM c a JOIN c b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col)),
r(id, root) AS (SELECT row * 24 + col, row * 24 + col FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), k AS (SELECT id, min(root) AS root FROM r GROUP BY id), q AS (SELECT root FROM k JOIN c ON c.row * 24 + c.col = k.id GROUP BY root HAVING max(value) > 0.3 AND count(*) >= 3) SELECT id // 24 AS row, id % 24 AS col FROM k WHERE root IN (SELECT root FROM q)""")
def front_cells(spark, sf):
    """Cells of steep gradient and what hangs together with them."""
    return grids.front_cells(grids.gradient(_field(spark, sf), N, RES), 0.2, 0.3, COLS)


@query(f"""WITH RECURSIVE {_FIELD}, c AS (SELECT row, col FROM f WHERE value > 35), r(row, col) AS (SELECT row, col FROM c WHERE col = 0 UNION SELECT c.row, c.col FROM r JOIN c ON abs(c.row - r.row) + abs(c.col - r.col) = 1) SELECT row, col FROM r""")
def reachable_sea(spark, sf):
    """Sea cells that the western edge reaches."""
    c = _field(spark, sf).select("row", "col", F.coalesce(F.col("value") > 35, F.lit(False)).alias("value"))
    return grids.connected_sea(c, c.where("value and col = 0"), 64)


@query(f"""SELECT det_id, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN (k % 30)::DOUBLE ELSE greatest(CASE WHEN k % 4 <> 1 THEN (k % 30)::DOUBLE END, CASE WHEN k % 4 = 3 THEN (k % 17)::DOUBLE END) END AS scr_max, round(CASE WHEN length_m > 0 THEN k % 90 * 100 / length_m END, 6) AS fill_width, CASE WHEN pol_class IS NOT NULL THEN (pol_class = 'VV+VH')::INTEGER END AS dual, wind_ms > 0 AS windy FROM ({v.SQL_OBJECTS})""")
def covariates(spark, sf):
    """Features of contacts; what a producer lacks is null."""
    from pelagos.functions import scalars

    k = F.col("k")
    vv, vh = F.when(k % 4 != 0, (k % 30).cast("double")), F.when(k % 4 == 3, (k % 17).cast("double"))
    x = scalars.covariates(vv, vh, k % 90, F.col("length_m"), F.col("pol_class"))
    return v.objects(spark, sf).select("det_id", x["scr_max"].alias("scr_max"), F.round(x["fill_width"], 6).alias("fill_width"), x["dual"].alias("dual"), scalars.presence(F.col("wind_ms")).alias("windy"))
