"""Physical encodings of columns: dictionary, narrow integers, times, booleans; and their inverses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INT_TYPES = ((8, 1 << 7), (16, 1 << 15), (32, 1 << 31))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the different known values in order, from 0. Codes come from ranges of a sorted table, not from one task."""
    from pelagos.storage import materialise

    values = materialise(df.select(F.col(column).alias("value")).where("value is not null").distinct().repartitionByRange("value").sortWithinPartitions("value").withColumn("_p", F.spark_partition_id()), "dictionary")
    inner = values.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("value")) - 1)
    counts = values.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row per partition
    return inner.join(before, "_p").select("value", (F.col("_i") + F.col("_b")).alias("code"))


def numeric_spec(df: DataFrame, columns: list[str], scale: int = 1) -> DataFrame:
    """Per column: least and greatest scaled value, whether any is null, and the narrowest signed type that leaves a code for null."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.round(F.col(c) * scale).cast("long").alias("x")) for c in columns))).alias("s")).select("s.*")
    s = long.groupBy("column").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.when(F.col("x").isNull(), 1)).alias("nulls"))
    bits = F.lit(64)
    for n, limit in reversed(INT_TYPES):
        bits = F.when((F.col("low") > -limit) & (F.col("high") < limit - 1), n).otherwise(bits)
    return s.withColumn("bits", F.when(F.col("low") == F.col("high"), 0).otherwise(bits).cast("int"))


def bool_code(c: Column) -> Column:
    """0, 1, or 255 for unknown."""
    return F.coalesce(c.cast("int"), F.lit(255))


def time_codes(df: DataFrame, ts: str) -> DataFrame:
    """``df`` with seconds since the first UTC midnight of the column."""
    start = df.agg(F.date_trunc("day", F.min(ts)).alias("_start"))
    return df.crossJoin(F.broadcast(start)).withColumn("code", F.unix_timestamp(ts) - F.unix_timestamp("_start")).drop("_start")  # one row on the right


def split_id(c: Column) -> tuple[Column, Column, Column]:
    """Prefix, number and pad width of an id that ends in digits."""
    digits = F.regexp_extract(c, r"(\d+)$", 1)
    return F.regexp_extract(c, r"^(.*?)\d*$", 1), F.when(digits != "", digits.cast("long")), F.length(digits)


# Fixed value: the satellites' codes in light ids.
SATELLITES = {"Suomi NPP": "NPP", "NOAA-20": "J01", "NOAA-21": "J02"}


def light_id(satellite: Column, ts: Column, index: Column, width: int = 6) -> Column:
    """A light's id rebuilt from its satellite, time and index; null for an unknown satellite."""
    code = F.lit(None).cast("string")
    for name, short in SATELLITES.items():
        code = F.when(satellite == name, short).otherwise(code)
    return F.concat(F.lit("VNL_"), code, F.lit("_"), F.date_format(ts, "yyyyMMdd'T'HHmmss"), F.lit("_"), F.lpad(index.cast("string"), width, "0"))


def light_index(ident: Column, satellite: Column, ts: Column, width: int = 6, index: Column | None = None) -> Column:
    """The index if the id is what its satellite and time give, else null (the column is then kept as text).

    An id holds no more than ``width`` digits, so a longer ``index`` cannot be read back from it; where the rows have the index, it is given and only checked.
    """
    known = index if index is not None else F.regexp_extract(ident, rf"_(\d{{{width}}})$", 1).try_cast("long")
    return F.when(light_id(satellite, ts, known, width) == ident, known)


def row_references(rows: DataFrame, key: str, to: DataFrame, to_key: str, order: str) -> DataFrame:
    """``rows`` with ref: the place, from 0 in ``order``, of the row of ``to`` that has the key; 65535 where there is none. ``to`` is one part of a page, at most 65,535 rows; more are an error."""
    places = to.select(F.col(to_key).alias("_k"), (F.row_number().over(Window.orderBy(order, to_key)) - 1).alias("ref"))  # one part of a page
    places = places.withColumn("ref", F.when(F.col("ref") < 65_535, F.col("ref")).otherwise(F.raise_error(F.lit("too many rows for two-byte references")).cast("int")))
    return rows.join(places, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("ref", F.coalesce("ref", F.lit(65_535)))


def choose(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind): how each column is best stored: const, bool8, time, num, dict or str."""
    parts = []
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.count(c).alias("n"), F.count("*").alias("rows"), F.count_distinct(c).alias("different")))
    one = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("x")).select("x.*")
    number = F.col("type").isin("tinyint", "smallint", "int", "bigint", "float", "double") | F.col("type").startswith("decimal")
    const = (F.col("n") == 0) | ((F.col("different") == 1) & (F.col("n") == F.col("rows")))
    few = F.col("different") <= F.greatest(F.lit(255), F.floor(F.col("n") / 4))
    return one.select("column", F.when(const, "const").when(F.col("type") == "boolean", "bool8").when(number, "num").when(F.col("type").startswith("timestamp"), "time").when(few, "dict").otherwise("str").alias("kind"))


def tolerance(kind: Column, scale: Column) -> Column:
    """How far a decoded value may be from the stored one: half a step of scaled numbers, a second of times, nothing else."""
    return F.when(kind == "num", 0.5 / scale).when(kind == "time", 1.0).otherwise(0.0)


def scaled_code(value: Column, scale: float, bits: int) -> Column:
    """A signed integer code; the least of its width stands for null."""
    return F.coalesce(F.round(value * scale).cast("long"), F.lit(-(1 << bits - 1)))


def decode_scaled(code: Column, scale: float, bits: int) -> Column:
    return F.when(code != -(1 << bits - 1), code / scale)


def decode_bool(code: Column) -> Column:
    return F.when(code != 255, code == 1)


def decode_time(code: Column, epoch_s: Column) -> Column:
    return F.when(code != 4294967295, F.timestamp_seconds(epoch_s + code))


def decode_dictionary(rows: DataFrame, code: str, dictionary: DataFrame, name: str) -> DataFrame:
    """``rows`` with the value of each code; codes beyond the dictionary are null."""
    d = dictionary.select(F.col("code").alias(code), F.col("value").alias(name))
    return rows.join(d, code, "left")


def packed_points(lon: Column, lat: Column, scale: float = 1e5) -> tuple[Column, Column]:
    """A point quantised to whole steps of 1 / scale degrees."""
    return F.round(lon * scale).cast("long"), F.round(lat * scale).cast("long")


def packed_line(points: Column, scale: float = 1e5) -> Column:
    """A line (array of structs lon, lat) as steps: the first point quantised, then differences."""
    q = F.transform(points, lambda p: F.struct(F.round(p["lon"] * scale).cast("long").alias("x"), F.round(p["lat"] * scale).cast("long").alias("y")))
    return F.transform(q, lambda p, i: F.when(i == 0, p).otherwise(F.struct((p["x"] - F.get(q, i - 1)["x"]).alias("x"), (p["y"] - F.get(q, i - 1)["y"]).alias("y"))))


def unpacked_line(steps: Column, scale: float = 1e5) -> Column:
    """The points of ``packed_line``."""
    zero = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.array().cast("array<struct<lon:double,lat:double>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        x, y = a["x"] + p["x"], a["y"] + p["y"]
        return F.struct(x.alias("x"), y.alias("y"), F.concat(a["out"], F.array(F.struct((x / scale).alias("lon"), (y / scale).alias("lat")))).alias("out"))

    return F.aggregate(steps, zero, step, lambda a: a["out"])
