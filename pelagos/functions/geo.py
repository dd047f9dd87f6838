"""Column expressions on the sphere and its grids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres; some operators take another, so it is a parameter throughout.
EARTH_M = 6371008.8
KM_PER_DEGREE = EARTH_M * math.pi / 180 / 1000
ORIGIN_LON, ORIGIN_LAT, RES, ROWS, COLS = 99.0, 24.0, 0.25, 109, 94
# Reporting boxes (name, west, south, east, north); the first that holds a point names it.
BOXES = (
    ("Gulf of Tonkin", 105.5, 17.0, 110.0, 22.5), ("North shelf", 110.0, 18.0, 118.0, 23.5), ("Gulf of Thailand", 99.0, 6.0, 105.0, 14.0),
    ("South Vietnam shelf", 105.0, 6.0, 110.0, 12.0), ("Central sea", 110.0, 6.0, 118.0, 17.0), ("Southern sea", 102.0, -3.5, 110.0, 6.0),
)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # least() would turn an unknown into 1


def sql_haversine_m(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = EARTH_M) -> str:
    return f"(2 * {radius} * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


def equirectangular_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, at_lat: Column, radius: float = EARTH_M) -> Column:
    x = F.radians(lon2 - lon1) * F.cos(F.radians(at_lat))
    return radius * F.sqrt(x * x + F.pow(F.radians(lat2 - lat1), 2))


def corner_row(lat: Column) -> Column:
    """Row of the corner-anchored grid, from the north."""
    return F.floor((ORIGIN_LAT - lat) / RES)


def corner_col(lon: Column) -> Column:
    return F.floor((lon - ORIGIN_LON) / RES)


def cell_id(lon: Column, lat: Column) -> Column:
    """``r<row>c<col>``; null outside the grid."""
    row, col = corner_row(lat), corner_col(lon)
    return F.when(row.between(0, ROWS - 1) & col.between(0, COLS - 1), F.concat(F.lit("r"), row.cast("string"), F.lit("c"), col.cast("string")))


SQL_ROW = "floor((24.0 - lat) / 0.25)::BIGINT"
SQL_COL = "floor((lon - 99.0) / 0.25)::BIGINT"
SQL_CELL = f"CASE WHEN {SQL_ROW} BETWEEN 0 AND {ROWS - 1} AND {SQL_COL} BETWEEN 0 AND {COLS - 1} THEN 'r' || {SQL_ROW} || 'c' || {SQL_COL} END"


def centre_key(x: Column, res: float) -> Column:
    """Index on the centre-anchored grid: floor(x / res + 0.5)."""
    return F.floor(x / res + 0.5)


def cell_area_km2(lat_south: Column, res: float = RES, radius: float = EARTH_M) -> Column:
    """Exact spherical area of a cell of ``res`` degrees."""
    return (radius / 1000) ** 2 * math.radians(res) * (F.sin(F.radians(lat_south + res)) - F.sin(F.radians(lat_south)))


def region_of(lon: Column, lat: Column, boxes=BOXES) -> Column:
    """First box with west <= lon < east and south <= lat < north, else 'other'."""
    out = F.lit("other")
    for name, w, s, e, n in reversed(boxes):
        out = F.when((lon >= w) & (lon < e) & (lat >= s) & (lat < n), name).otherwise(out)
    return out


def sql_region(boxes=BOXES) -> str:
    return "CASE " + " ".join(f"WHEN lon >= {w} AND lon < {e} AND lat >= {s} AND lat < {n} THEN '{name}'" for name, w, s, e, n in boxes) + " ELSE 'other' END"


def web_mercator_px(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Pixel (col, row) of 256-pixel tiles."""
    size = 256 * 2**zoom
    s = F.log(F.tan(F.radians(lat) / 2 + math.pi / 4))
    return (lon + 180) / 360 * size, (1 - s / math.pi) / 2 * size


def in_polygon(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test against a closed ring of constant vertices, as one expression."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        crosses = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        left = lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
        inside = inside != (crosses & left)
    return inside


def covering_cells(spark, box: tuple[float, float, float, float], res: float):
    """(row, col, km2): the cells from the box's north-west corner that cover it, with their areas."""
    west, south, east, north = box
    rows, cols = math.ceil((north - south) / res - 1e-9), math.ceil((east - west) / res - 1e-9)
    cells = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("row"), (F.col("id") % cols).alias("col"))
    return cells.withColumn("km2", cell_area_km2(F.lit(north) - (F.col("row") + 1) * res, res))
