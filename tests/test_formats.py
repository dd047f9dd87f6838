"""Files of other formats, payloads and sinks."""

import json
import sqlite3

from pyspark.sql import functions as F

from pelagos.sources import formats as f


def test_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A & B", 1.5, None), ("<c>", 2.0, "x")], "name string, rank double, note string")
    f.write_xlsx(df, str(tmp_path / "a.xlsx"))
    f.write_xlsx(df.limit(1), str(tmp_path / "b.xlsx"))
    got = f.read_xlsx(spark, str(tmp_path / "*.xlsx"), ["name", "rank", "missing"], "Rank")
    assert sorted((r["name"], r["rank"], r.missing) for r in got.collect()) == [("<c>", "2.0", None), ("A & B", "1.5", None), ("A & B", "1.5", None)]
    assert f.xlsx_records([["title"], ["Name", "ISSN"], ["x"], []], "issn") == [{"Name": "x", "ISSN": ""}]


def test_kml(spark, tmp_path):
    (tmp_path / "p.kml").write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>S1</name><TimeSpan><begin>2024-01-01T10:00:00Z</begin><end>2024-01-01T10:05:00Z</end></TimeSpan><Polygon><coordinates>100,5,0 101,5,0 101,6,0</coordinates></Polygon></Placemark><Placemark><name>none</name></Placemark></Document></kml>')
    r = f.read_kml(spark, str(tmp_path / "p.kml")).select("name", F.unix_seconds("begin").alias("b"), "lons", "lats").collect()
    assert [tuple(x) for x in r] == [("S1", 1704103200, [100.0, 101.0, 101.0], [5.0, 5.0, 6.0])]


def test_gpkg_round_trip_with_filter_and_constants(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 100.5, 5.25), ("b", 2, None, None)], "lead_id string, priority long, lon double, lat double")
    path = str(tmp_path / "x.gpkg")
    f.write_gpkg({"leads": df}, path, {"caveat": "it's a lead"})
    got = f.read_gpkg(spark, path, "leads", ["lead_id", "priority", "caveat", "nothing"], "priority < 2").collect()
    assert [(r.lead_id, r.priority, r.caveat, r.nothing, r.lon, r.lat) for r in got] == [("a", "1", "it's a lead", None, 100.5, 5.25)]
    db = sqlite3.connect(path)
    assert db.execute("SELECT count(*) FROM leads").fetchone() == (2,)
    db.close()


def test_scans_resume_and_count(spark, tmp_path):
    for n in range(2):
        spark.createDataFrame([(i, f"ship {i}" if i % 2 else "cat") for i in range(6)], "id long, text string").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    docs = spark.read.parquet(str(tmp_path / "in/*"))
    pre, keep = F.col("text").contains("ship"), F.col("id") > 2
    assert sorted((r["rows"], r.candidates, r.kept) for r in f.scan_counts(docs, pre, keep).collect()) == [(6, 3, 2), (6, 3, 2)]
    assert f.scan(docs, pre, keep, ["text"]).count() == 4
    inputs, job = [str(tmp_path / f"in/{n}") for n in range(2)], lambda p: spark.read.parquet(p).where(pre)
    assert f.resumable(spark, inputs, str(tmp_path / "out"), job) == inputs and f.resumable(spark, inputs, str(tmp_path / "out"), job) == []


def test_vessels_and_scenes(spark):
    entry = {"registryInfo": [{"vesselInfoReference": "v1", "shipname": "OLD", "flag": "VN", "lengthM": 20, "latestVesselInfo": False, "transmissionDateTo": "2020"}, {"vesselInfoReference": "v1", "shipname": None, "imo": "99", "latestVesselInfo": True, "transmissionDateTo": "2019"}], "combinedSourcesInfo": [{"vesselId": "v1", "shiptypes": [{"name": "OTHER"}, {"name": "FISHING"}], "geartypes": [{"name": "TRAWLERS"}]}], "selfReportedInfo": [{"id": "v1", "ssvid": "574", "shipname": "", "callsign": "C"}, {"id": "v2", "ssvid": "575", "shipname": "TWO"}]}
    rows = f.vessels(spark.createDataFrame([(json.dumps({"entries": [entry]}),)], "j string"), "j").collect()
    got = {r.vessel_id: (r.mmsi, r["name"], r.flag, r.imo, r.length_m, r.ship_type, r.gear) for r in rows}
    assert got == {"v1": ("574", "OLD", "VN", "99", 20.0, "FISHING", "TRAWLERS"), "v2": ("575", "TWO", None, None, None, None, None)}
    item = {"id": "S1A_X", "bbox": [1, 2, 3, 4], "properties": {"platform": "sentinel-1a", "sat:relative_orbit": 18, "sat:orbit_state": "ascending", "start_datetime": "2024-01-01T00:00:00Z"}}
    r = f.scene_records(spark.createDataFrame([(json.dumps(item),), ("bad",)], "j string"), "j").collect()
    assert [(x.scene_id, x.mission, x.orbit, x.direction, x.west, x.north) for x in r] == [("S1A_X", "S1A", 18, "ASCENDING", 1.0, 4.0)]


def test_rows_by_id_or_issn_and_sinks(spark, tmp_path):
    v = spark.createDataFrame([("a", ["1"], 1), ("a", ["1"], 5), ("b", ["2", "3"], 1), ("c", ["4"], 1)], "id string, issns array<string>, updated int")
    got = f.by_id_or_issn(v, spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("3",)], "issn string"))
    assert sorted((r.id, r.updated) for r in got.collect()) == [("a", 5), ("b", 1)]
    f.write_tables({"x": v.select("id"), "y": v.limit(1).select("id")}, str(tmp_path / "t"), {"made": "now"})
    line = spark.read.text(str(tmp_path / "t/summary")).first().value
    assert json.loads(line) == {"made": "now", "rows": {"x": 4, "y": 1}}
    each = f.write_parts_by_size(spark.range(20_000).coalesce(1), str(tmp_path / "p"), 0.03)
    files = list((tmp_path / "p").glob("part-*.parquet"))
    assert len(files) == -(-20_000 // each) and all(x.stat().st_size < 45_000 for x in files)
