"""Ordering, paging, lookup and search as the query API offers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.operators.filters import BadParameter


def order_by(df: DataFrame, sort: str, allowed: tuple[str, ...], tiebreak: str) -> DataFrame:
    """Sort by an allowed key, ``-`` for descending, nulls last either way, ties by ``tiebreak`` ascending."""
    name = sort.removeprefix("-")
    if name not in allowed:
        raise BadParameter("bad_sort", f"cannot sort by {name}")
    c = F.col(name)
    return df.orderBy(c.desc_nulls_last() if sort.startswith("-") else c.asc_nulls_last(), F.col(tiebreak))


def page(df: DataFrame, limit: int, offset: int = 0, maximum: int = 1000) -> DataFrame:
    """A page of an ordered frame; the limit is held to 0..maximum."""
    if offset < 0:
        raise BadParameter("bad_offset", "offset is negative")
    return df.offset(offset).limit(min(max(limit, 0), maximum))


def prefix_search(df: DataFrame, column: str, text: str, limit: int) -> DataFrame:
    return df.where(F.col(column).startswith(text)).orderBy(column).limit(limit)


def union_conform(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union of frames with different columns, each row tagged with its part's name."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly these columns and types; absent ones are null, non-finite numbers become null."""
    cols: list[Column] = []
    for name, kind in schema.items():
        c = F.col(name) if name in df.columns else F.lit(None)
        if name in df.columns and dict(df.dtypes)[name] in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        cols.append(c.cast(kind).alias(name))
    return df.select(*cols)
