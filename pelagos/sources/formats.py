"""Files that Spark has no reader for, read as bytes and parsed on the executors: XLSX, KML, GeoPackage; and scans and sinks of whole corpora.

``binaryFile`` hands each file to one task, so a folder of many files is read in parallel; a single file must fit a task's memory.
"""

from __future__ import annotations

import io
import json
import re
import sqlite3
import struct
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _parsed(files: DataFrame, parse: Callable[[bytes], list[dict]], columns: list[tuple[str, str]]) -> DataFrame:
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = parse(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array([r.get(c) for r in rows], kinds[k]) for c, k in columns)], names=["path", *(c for c, _ in columns)])

    return files.mapInArrow(run, "path string, " + ", ".join(f"`{c}` {k}" for c, k in columns))


def _place(reference: str) -> int:
    """Column number of a cell reference, A is 0."""
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def xlsx_rows(content: bytes, sheet: int = 1) -> list[list[str]]:
    """The cells of a sheet as text, row by row, with empty text for gaps."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    out = []
    for row in root.iter(f"{_SHEET}row"):
        cells: list[str] = []
        for n, c in enumerate(row.iter(f"{_SHEET}c")):
            at = _place(c.attrib["r"]) if "r" in c.attrib else n
            value, kind = c.find(f"{_SHEET}v"), c.attrib.get("t")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
            else:
                text = "" if value is None or value.text is None else shared[int(value.text)] if kind == "s" else value.text
            cells += [""] * (at + 1 - len(cells))
            cells[at] = text
        out.append(cells)
    return out


def xlsx_records(rows: list[list[str]], hint: str) -> list[dict[str, str]]:
    """Records below the first row that has a cell with the hint, by that row's names."""
    for n, row in enumerate(rows):
        if any(hint.lower() in c.lower() for c in row):
            return [{k: r[i] if i < len(r) else "" for i, k in enumerate(row) if k} for r in rows[n + 1 :] if any(r)]
    return []


def read_xlsx(spark: SparkSession, path: str, columns: list[str], hint: str, sheet: int = 1) -> DataFrame:
    """(path, columns) of the sheets of all files; numbers stay text."""
    return _parsed(_files(spark, path), lambda b: xlsx_records(xlsx_rows(b, sheet), hint), [(c, "string") for c in columns])


def write_xlsx(df: DataFrame, path: str, most_rows: int = 1_000_000) -> None:
    """A sheet of all rows as text on the driver's side; a sheet cannot hold more than about a million rows, more are an error."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError("more rows than a sheet holds")

    def cell(x: object) -> str:
        text = "" if x is None else str(x).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(df.columns), *rows])
    sheet = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_SHEET[1:-1]}"><sheetData>{body}</sheetData></worksheet>'
    book = f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_SHEET[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>'
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{relation}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", book)
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def kml_segments(content: bytes) -> list[dict]:
    """Placemarks of an acquisition plan: name, begin, end, the ring's longitudes and latitudes."""
    root = ElementTree.fromstring(content)
    plain = lambda tag: tag.rpartition("}")[2]
    out = []
    for p in (x for x in root.iter() if plain(x.tag) == "Placemark"):
        row: dict = {"name": None, "begin": None, "end": None, "lons": None, "lats": None}
        for x in p.iter():
            text = (x.text or "").strip()
            if plain(x.tag) in ("name", "begin", "end") and text:
                row[plain(x.tag)] = row[plain(x.tag)] or text
            elif plain(x.tag) == "coordinates" and text and row["lons"] is None:
                points = [tuple(map(float, c.split(",")[:2])) for c in text.split()]
                row["lons"], row["lats"] = [a for a, _ in points], [b for _, b in points]
        if row["lons"]:
            out.append(row)
    return out


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, begin, end, lons, lats) of all placemarks that have a ring; times as UTC timestamps."""
    df = _parsed(_files(spark, path), kml_segments, [("name", "string"), ("begin", "string"), ("end", "string"), ("lons", "array<double>"), ("lats", "array<double>")])
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in ("begin", "end")})


def point_of(blob: bytes | None) -> tuple[float | None, float | None]:
    """Longitude and latitude of a GeoPackage point; nulls for other geometries."""
    if not blob or blob[:2] != b"GP":
        return None, None
    box = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    body = blob[8 + box :]
    order = "<" if body[0] else ">"
    kind = struct.unpack_from(order + "I", body, 1)[0]
    return struct.unpack_from(order + "dd", body, 5) if kind % 1000 == 1 else (None, None)


def gpkg_point(lon: float, lat: float, srs: int = 4326) -> bytes:
    return b"GP" + bytes([0, 1]) + struct.pack("<i", srs) + struct.pack("<BIdd", 1, 1, lon, lat)


def gpkg_rows(content: bytes, layer: str, columns: list[str], where: str | None = None) -> list[dict]:
    """Rows of a layer as text with lon and lat; wanted columns that it lacks are left out. The filter runs in the file."""
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
        f.write(content)
        f.flush()
        db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        try:
            quoted = '"' + layer.replace('"', '""') + '"'
            have = [r[1] for r in db.execute(f"PRAGMA table_info({quoted})")]
            geometry = [r[0] for r in db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,))]
            wanted = [c for c in columns if c in have]
            names = ", ".join('"' + c.replace('"', '""') + '"' for c in [*wanted, *geometry]) or "1"
            rows = db.execute(f"SELECT {names} FROM {quoted}" + (f" WHERE {where}" if where else "")).fetchall()
        finally:
            db.close()
    out = []
    for r in rows:
        row = {c: None if x is None else str(x) for c, x in zip(wanted, r, strict=False)}
        row["lon"], row["lat"] = point_of(r[-1]) if geometry else (None, None)
        out.append(row)
    return out


def read_gpkg(spark: SparkSession, path: str, layer: str, columns: list[str], where: str | None = None) -> DataFrame:
    """(path, columns as text, lon, lat) of a layer of all files, with the filter pushed into them."""
    return _parsed(_files(spark, path), lambda b: gpkg_rows(b, layer, columns, where), [*((c, "string") for c in columns), ("lon", "double"), ("lat", "double")])


def write_gpkg(layers: dict[str, DataFrame], path: str, constants: dict[str, object] | None = None, most_rows: int = 1_000_000) -> None:
    """Layers with lon and lat as points in one file on the driver's side; constant columns become defaults of the table and are not stored per row. Exports are bounded; more rows are an error."""
    db = sqlite3.connect(path)
    db.execute("PRAGMA application_id = 1196444487")
    db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT)")
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326, 'undefined')")
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
    sql = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "INTEGER"}
    for name, df in layers.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"layer {name} has more than {most_rows} rows")
        own = [c for c in df.columns if c not in ("lon", "lat")]
        columns = ", ".join(f'"{c}" {sql.get(dict(df.dtypes)[c], "TEXT")}' for c in own)
        fixed = "".join(f", \"{c}\" TEXT DEFAULT '{str(x).replace(chr(39), chr(39) * 2)}'" for c, x in (constants or {}).items())
        db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY, geom BLOB, {columns}{fixed})')
        values = [(gpkg_point(r["lon"], r["lat"]) if r["lon"] is not None else None, *(r[c] if dict(df.dtypes)[c] in sql else None if r[c] is None else str(r[c]) for c in own)) for r in rows]
        db.executemany(f'INSERT INTO "{name}" (geom, {", ".join(chr(34) + c + chr(34) for c in own)}) VALUES ({", ".join("?" * (len(own) + 1))})', values)
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, 4326)", (name, name))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POINT', 4326, 0, 0)", (name,))
    db.commit()
    db.execute("VACUUM")
    db.close()


def scan(files: DataFrame, prefilter: Column, keep: Column, text_columns: list[str]) -> DataFrame:
    """Rows of many files that pass a cheap filter and then an exact test, with the file they are from; Spark reads the other columns' pages only for what the pushed filters leave."""
    return files.withColumn("_file", F.input_file_name()).where(prefilter).where(keep).select("_file", *(c for c in files.columns if c not in text_columns), *text_columns)


def scan_counts(files: DataFrame, prefilter: Column, keep: Column) -> DataFrame:
    """(file, rows, candidates, kept) per file of a scan, in one pass."""
    x = files.select(F.input_file_name().alias("file"), F.coalesce(prefilter, F.lit(False)).alias("_p"), F.coalesce(keep, F.lit(False)).alias("_k"))
    return x.groupBy("file").agg(F.count("*").alias("rows"), F.count(F.when(F.col("_p"), 1)).alias("candidates"), F.count(F.when(F.col("_p") & F.col("_k"), 1)).alias("kept"))


def resumable(spark: SparkSession, inputs: list[str], out: str, job: Callable[[str], DataFrame]) -> list[str]:
    """Runs a job per input file and writes its rows below ``out``; files whose rows are already there are passed by. What was done now."""
    done = []
    for path in inputs:
        target = f"{out.rstrip('/')}/{Path(path).name}"
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            job(path).write.mode("overwrite").parquet(target)
            done.append(path)
    return done


def by_id_or_issn(venues: DataFrame, ids: DataFrame, issns: DataFrame) -> DataFrame:
    """Rows (id, issns array, updated) whose id is listed or that have a listed ISSN; of several rows of an id the last."""
    a = venues.join(ids.select("id").distinct(), "id", "left_semi")
    hit = venues.select("id", F.explode("issns").alias("issn")).join(issns.select("issn").distinct(), "issn", "left_semi").select("id").distinct()
    both = a.unionByName(venues.join(hit, "id", "left_semi"))
    return both.groupBy("id").agg(F.max_by(F.struct(*(c for c in venues.columns if c != "id")), "updated").alias("_r")).select("id", "_r.*")


def vessels(payload: DataFrame, column: str) -> DataFrame:
    """One row per self-reported identity of an API payload: registry fields of the same vessel, or of the only record, the latest first; the last gear and ship type."""
    who = "struct<id: string, ssvid: string, shipname: string, callsign: string, flag: string, imo: string, transmissionDateFrom: string, transmissionDateTo: string, latest: boolean>"
    types = "struct<vesselId: string, shiptypes: array<struct<name: string>>, geartypes: array<struct<name: string>>>"
    e = payload.select(F.explode(F.from_json(F.col(column), f"struct<entries: array<struct<registryInfo: array<struct<vesselInfoReference: string, shipname: string, flag: string, imo: string, lengthM: double, tonnageGt: double, latestVesselInfo: boolean, transmissionDateTo: string>>, combinedSourcesInfo: array<{types}>, selfReportedInfo: array<{who}>>>>")["entries"]).alias("e"))
    each = e.select("e", F.explode("e.selfReportedInfo").alias("s"))
    own = F.filter("e.registryInfo", lambda r: r["vesselInfoReference"] == F.col("s.id"))
    records = F.when(F.size(own) > 0, own).when(F.size("e.selfReportedInfo") == 1, F.col("e.registryInfo"))
    records = F.array_sort(records, lambda a, b: F.when(F.coalesce(a["latestVesselInfo"], F.lit(False)) != F.coalesce(b["latestVesselInfo"], F.lit(False)), F.when(F.coalesce(a["latestVesselInfo"], F.lit(False)), -1).otherwise(1)).when(F.coalesce(a["transmissionDateTo"], F.lit("")) > F.coalesce(b["transmissionDateTo"], F.lit("")), -1).when(F.coalesce(a["transmissionDateTo"], F.lit("")) < F.coalesce(b["transmissionDateTo"], F.lit("")), 1).otherwise(0))
    first = lambda f: F.try_element_at(F.filter(F.transform(records, lambda r: r[f]), lambda x: x.isNotNull()), F.lit(1))
    kinds = F.filter("e.combinedSourcesInfo", lambda c: c["vesselId"] == F.col("s.id"))
    last = lambda f: F.try_element_at(F.try_element_at(kinds, F.lit(1))[f], F.lit(-1))["name"]
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    return each.select(F.col("s.id").alias("vessel_id"), text("s.ssvid").alias("mmsi"), F.coalesce(text("s.shipname"), first("shipname")).alias("name"), F.coalesce(text("s.flag"), first("flag")).alias("flag"), F.coalesce(text("s.imo"), first("imo")).alias("imo"), text("s.callsign").alias("callsign"), first("lengthM").alias("length_m"), first("tonnageGt").alias("tonnage"), last("shiptypes").alias("ship_type"), last("geartypes").alias("gear"))


def scene_records(items: DataFrame, column: str) -> DataFrame:
    """Scenes of catalogue items in JSON: id, mission, orbit, direction, times and the footprint's box."""
    shape = "struct<id: string, bbox: array<double>, properties: struct<`platform`: string, `sat:relative_orbit`: int, `sat:orbit_state`: string, start_datetime: string, end_datetime: string>>"
    i = items.select(F.from_json(F.col(column), shape).alias("i")).where("i.id is not null")
    p = F.col("i.properties")
    box = lambda n: F.get(F.col("i.bbox"), n)
    return i.select(F.col("i.id").alias("scene_id"), F.upper(F.regexp_replace(p["platform"], "(?i)^sentinel-", "S")).alias("mission"), p["sat:relative_orbit"].alias("orbit"), F.upper(p["sat:orbit_state"]).alias("direction"), F.try_to_timestamp(p["start_datetime"]).alias("start"), F.try_to_timestamp(p["end_datetime"]).alias("stop"), *(box(n).alias(c) for n, c in enumerate(("west", "south", "east", "north"))))


def write_tables(tables: dict[str, DataFrame], path: str, summary: dict[str, object]) -> None:
    """A family of CSV tables, a folder each, and a summary in JSON with their row counts."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{path.rstrip('/')}/{name}", header=True)
    spark = next(iter(tables.values())).sparkSession
    counts = {name: spark.read.csv(f"{path.rstrip('/')}/{name}", header=True).count() for name in tables}
    line = json.dumps(summary | {"rows": counts}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/summary")


def write_parts_by_size(df: DataFrame, path: str, most_mb: float) -> int:
    """Parquet parts of about so many megabytes at most, by the size of a first write; the number of rows a file was given."""
    spark = df.sparkSession
    first = f"{path.rstrip('/')}-measure"
    df.write.mode("overwrite").option("compression", "zstd").parquet(first)
    p = spark._jvm.org.apache.hadoop.fs.Path(first)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    size, rows = fs.getContentSummary(p).getLength(), spark.read.parquet(first).count()
    each = max(1, int(rows * most_mb * 1e6 / max(1, size) * 0.9))
    spark.read.parquet(first).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", each).parquet(path)
    fs.delete(p, True)
    return each
