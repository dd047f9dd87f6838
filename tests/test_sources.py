"""Catalogue, file sources and the stream."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from pelagos.sources import catalog as c
from pelagos.streaming import recorder


def test_catalog_policy_and_projection(spark, tmp_path):
    spark.range(5).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "data/a.parquet"))
    specs = {"a": c.TableSpec("data/a.parquet"), "r": c.TableSpec("data/research/b.parquet"), "none": c.TableSpec("data/none.parquet")}
    cat = c.Catalog(spark, str(tmp_path), specs)
    assert cat.read("a", ["id", "missing"]).columns == ["id"] and cat.rows("a") == 5 and cat.exists("a") and not cat.exists("none")
    with pytest.raises(c.Forbidden):
        cat.read("r")
    assert cat.register() == ["a"]
    before = cat.signature("a")
    snap = recorder.Snapshot(cat, "a")
    assert snap.refresh() is False
    spark.range(3).withColumn("x", F.lit(1)).write.mode("append").parquet(str(tmp_path / "data/a.parquet"))
    assert cat.signature("a") != before and snap.refresh() is True and snap.frame.count() == 8


def test_geojson_csv_and_replay(spark, tmp_path):
    (tmp_path / "f.geojson").write_text(json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"n": 7}}, {"geometry": {"type": "Line"}, "properties": {"n": 8}}]}))
    assert [tuple(r) for r in c.geojson_features(spark, str(tmp_path / "f.geojson"), "n: long").collect()] == [(1.5, 2.5, 7)]
    (tmp_path / "s.csv").write_text("name;rank\nA;1,25\nB;-\n")
    assert [r["rank"] for r in c.decimal_comma_csv(spark, str(tmp_path / "s.csv"), ["rank"]).collect()] == [1.25, None]
    with gzip.open(tmp_path / "l.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2\n')
    assert sorted((r.a or 0, r._bad is not None) for r in c.replay(spark, str(tmp_path / "l.jsonl.gz"), "a long").collect()) == [(0, True), (1, False)]


def test_parts_and_log(spark, tmp_path):
    c.write_parts(spark.range(10).coalesce(1), str(tmp_path / "p"), 4)
    assert len(list((tmp_path / "p").glob("part-*.parquet"))) == 3
    for _ in range(2):
        c.append_log(spark.range(2), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_recorder_dedupes_drops_skew_and_partitions(spark, tmp_path):
    ok = {"mmsi": 201000001, "ts": "2024-01-01T10:00:00Z", "received": "2024-01-01T10:00:05Z", "lon": 100.0, "lat": 5.0, "sog_kn": 3.0, "msg_type": "pos", "name": "A"}
    rows = [ok, ok, ok | {"ts": "2024-01-01T11:30:00Z", "received": "2024-01-01T11:30:00Z"}, ok | {"received": "2024-01-01T13:00:00Z"}, ok | {"lat": 95.0}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    stream = recorder.positions(recorder.messages(spark, str(tmp_path / "in")))
    recorder.record(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and {str(r.hh).zfill(2) for r in got.select("hh").collect()} == {"10", "11"}
    one = recorder.load_positions(spark, str(tmp_path / "out"), "2024-01-01 10:00:00", "2024-01-01 10:30:00")
    assert one.count() == 1
    scenes = spark.createDataFrame([(1, 0)], "scene_id long, d long").select("scene_id", F.lit("2024-01-01 11:00:00").cast("timestamp").alias("at"))
    assert recorder.scene_window(scenes, got).count() == 1


def test_latest_static_is_kept_as_state(spark, tmp_path):
    from pelagos.streaming import live

    (tmp_path / "in").mkdir()
    rows = [{"mmsi": 1, "seen": "2024-01-01T10:00:00Z", "name": "A", "ship_type": 70}, {"mmsi": 1, "seen": "2024-01-01T11:00:00Z", "callsign": "X"}, {"mmsi": 2, "seen": "2024-01-01T10:00:00Z", "length_m": 30.0}]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "in/b.json").write_text(json.dumps({"mmsi": 1, "seen": "2024-01-01T09:00:00Z", "name": "old", "length_m": 99.0}))
    stream = spark.readStream.schema(live.STATIC).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = {}
    live.latest_static(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: got.update({r.mmsi: r for r in df.collect()})).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    one = got[1]
    assert (one.name, one.callsign, one.ship_type, one.length_m, one.n_messages) == ("A", "X", 70, 99.0, 3)
    assert got[2].length_m == 30.0 and got[2].name is None


def test_cycle_keeps_status_and_tries_again(spark, tmp_path):
    from pelagos.streaming import live

    scenes = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 11:00:00"), ("c", "2024-01-02 11:00:00")], "scene_id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    reports = spark.createDataFrame([("2024-01-01 10:10:00",), ("2024-01-01 11:10:00",)], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    seen = []

    def process(scene, window):
        seen.append(scene)
        if scene == "b" and seen.count("b") < 2:
            raise RuntimeError("first try fails")
        assert window.count() == 1

    cycle = live.Cycle(spark, str(tmp_path / "live"), process)
    assert cycle.run(scenes, reports) == {"a": live.DONE, "b": live.FAILED, "c": live.SKIPPED}
    assert cycle.run(scenes, reports) == {"b": live.DONE, "c": live.SKIPPED}
    assert seen == ["a", "b", "b"] and cycle.due(scenes).collect()[0].scene_id == "c"


def test_partitions_are_merged_and_replaced_whole(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "k long, seen long, x string, day string"
    c.merge_partition(spark.createDataFrame([(1, 1, "a", "d1"), (2, 1, "b", "d1"), (3, 1, "c", "d2")], shape), path, ["k"], ["seen"], ["day"])
    c.merge_partition(spark.createDataFrame([(1, 5, "new", "d1"), (2, 0, "older", "d1"), (9, 1, "z", "d1")], shape), path, ["k"], ["seen"], ["day"])
    got = sorted((r.k, r.x, r.day) for r in spark.read.parquet(path).collect())
    assert got == [(1, "new", "d1"), (2, "b", "d1"), (3, "c", "d2"), (9, "z", "d1")]


def test_static_content_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", 5), (1, "A", 9), (2, "B", 1)], "mmsi long, name string, seen long")
    df.write.parquet(str(tmp_path / "s"))
    assert sorted(tuple(r) for r in c.load_static(spark, str(tmp_path / "s"), "mmsi long, name string, seen long").select("mmsi", "seen").collect()) == [(1, 9), (2, 1)]
    for kind in ("csv", "jsonl", "html"):
        c.export_table(df, str(tmp_path / kind), kind, {"caveat": "a <lead>"})
    assert spark.read.csv(str(tmp_path / "csv"), header=True).where("caveat = 'a <lead>'").count() == 3
    page = "\n".join(r.value for r in spark.read.text(str(tmp_path / "html")).collect())
    assert page.count("<tr>") == 4 and "a &lt;lead>" in page
