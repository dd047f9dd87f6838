"""Column expressions that read text and nested values: coordinates, ids, abstracts, API payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dms_to_degrees(text: Column) -> Column:
    """Degrees from ``12°30'36"S`` and the like; south and west are negative; null if it does not read so."""
    part = lambda i: F.regexp_extract(text, r"""^\s*(\d+)[°\s]+(\d+)['′\s]+([\d.]+)["″\s]*([NSEW])\s*$""", i)
    value = part(1).try_cast("double") + part(2).try_cast("double") / 60 + part(3).try_cast("double") / 3600
    return F.when(part(4).isin("S", "W"), -value).when(part(4) != "", value)


def utc_time(text: Column) -> Column:
    """Timestamp of ISO text; fractions beyond microseconds are cut, a text without offset means UTC."""
    clean = F.regexp_replace(F.trim(text), r"(\.\d{6})\d+", "$1")
    return F.try_to_timestamp(F.regexp_replace(clean, r"\s+UTC$", "Z"))


def abstract_of(inverted: Column, limit: int = 200_000) -> Column:
    """Text of an inverted index in JSON, {word: [positions]}; empty on bad input or a position above ``limit``; negative positions are skipped."""
    index = F.from_json(inverted, "map<string,array<int>>")
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    bad = F.exists(pairs, lambda p: p["at"].isNull() | (p["at"] > limit))
    words = F.transform(F.array_sort(F.filter(pairs, lambda p: p["at"] >= 0)), lambda p: p["word"])
    return F.when(index.isNull() | F.coalesce(bad, F.lit(True)), "").otherwise(F.array_join(words, " "))


def categories(text: Column) -> Column:
    """``Name (Q1); Other (Q2)`` as an array of structs (name, quartile)."""
    pieces = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(F.trim(F.regexp_replace(x, r"\s*\(Q[1-4]\)\s*$", "")).alias("name"), F.nullif(F.regexp_extract(x, r"\((Q[1-4])\)\s*$", 1), F.lit("")).alias("quartile")))


def product_fields(name: Column) -> Column:
    """Fields of a satellite product name: mission, mode, kind, start, stop, orbit; null where the pattern does not hold."""
    pattern = r"^(S1[A-D])_([A-Z0-9]{2})_([A-Z0-9]{4})_\w{4}_(\d{8}T\d{6})_(\d{8}T\d{6})_(\d{6})_"
    get = lambda i: F.regexp_extract(name, pattern, i)
    time = lambda i: F.try_to_timestamp(get(i), F.lit("yyyyMMdd'T'HHmmss"))
    return F.when(get(1) != "", F.struct(get(1).alias("mission"), get(2).alias("mode"), get(3).alias("kind"), time(4).alias("start"), time(5).alias("stop"), get(6).cast("int").alias("orbit")))


def issns(text: Column) -> Column:
    """The different valid ISSNs of a text in order, as NNNN-NNNC."""
    found = F.transform(F.regexp_extract_all(F.upper(text), F.lit(r"\b(\d{4}-?\d{3}[\dX])\b"), F.lit(1)), lambda x: F.regexp_replace(x, "-", ""))
    digit = lambda x, i: F.when(F.substring(x, i, 1) == "X", 10).otherwise(F.substring(x, i, 1).try_cast("int"))
    good = F.filter(found, lambda x: sum((digit(x, i) * (9 - i) for i in range(1, 9)), F.lit(0)) % 11 == 0)
    return F.array_distinct(F.transform(good, lambda x: F.concat(F.substring(x, 1, 4), F.lit("-"), F.substring(x, 5, 4))))


def report_cells(payload: DataFrame, column: str, step: float) -> DataFrame:
    """Cells of a gridded report in JSON, ``{entries: [{dataset: [cells]}]}``, snapped to the grid; empty text becomes null."""
    cell = "struct<date: string, hour: string, lat: double, lon: double, detections: double, vesselId: string>"
    entries = F.from_json(F.col(column), f"struct<entries: array<map<string, array<{cell}>>>>")["entries"]
    each = payload.select(F.explode(entries).alias("e")).select(F.explode("e")).toDF("dataset", "cells").select("dataset", F.explode("cells").alias("c")).select("dataset", "c.*")
    snap = lambda c: F.round(F.round(F.col(c) / step) * step, 6)
    return each.select("dataset", "date", F.nullif("hour", F.lit("")).alias("hour"), snap("lat").alias("lat"), snap("lon").alias("lon"), F.col("detections").cast("long").alias("detections"), F.nullif("vesselId", F.lit("")).alias("vessel_id"))


def event_rows(payload: DataFrame, column: str) -> DataFrame:
    """Events of an API payload, ``{entries: [...]}``, as one wide row each, with the duration in hours and the second vessel of encounters."""
    shape = "struct<entries: array<struct<id: string, type: string, start: string, end: string, position: struct<lat: double, lon: double>, vessel: struct<id: string, ssvid: string>, encounter: struct<vessel: struct<id: string>>, gap: struct<distanceKm: double>>>>"
    e = payload.select(F.explode(F.from_json(F.col(column), shape)["entries"]).alias("e"))
    start, end = utc_time(F.col("e.start")), utc_time(F.col("e.end"))
    hours = (F.unix_micros(end) - F.unix_micros(start)) / 3_600_000_000
    return e.select(F.col("e.id").alias("event_id"), F.col("e.type").alias("type"), start.alias("start"), end.alias("end"), hours.alias("duration_h"), F.col("e.position.lat").alias("lat"), F.col("e.position.lon").alias("lon"), F.col("e.vessel.id").alias("vessel_id"), F.col("e.encounter.vessel.id").alias("other_id"), F.col("e.gap.distanceKm").alias("gap_km"))


#: Maritime identification digits of some flags; a full table is a join on the digits.
MID = {"201": "AL", "211": "DE", "226": "FR", "232": "GB", "244": "NL", "257": "NO", "273": "RU", "338": "US", "366": "US", "412": "CN", "413": "CN", "416": "TW", "431": "JP", "440": "KR", "477": "HK", "525": "ID", "533": "MY", "548": "PH", "563": "SG", "567": "TH", "574": "VN"}


def flag_of(mmsi: Column) -> Column:
    """Flag by the first three digits of a nine-digit number, null if unknown."""
    table = F.create_map(*(F.lit(x) for pair in MID.items() for x in pair))
    return F.when(mmsi.between(100_000_000, 999_999_999), F.try_element_at(table, F.floor(mmsi / 1_000_000).cast("string")))


def gear_beacon_like(name: Column, mmsi: Column) -> Column:
    """A fishing-gear beacon by its name or by a number that no ship has."""
    odd = mmsi.isNull() | ~mmsi.between(100_000_000, 999_999_999)
    return F.coalesce(F.upper(name).rlike(r"%$|\b(NET|BUOY|BOUY)\b"), F.lit(False)) | odd
