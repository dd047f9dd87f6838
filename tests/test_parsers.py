import json

import pytest
from pyspark.sql import functions as F

from pelagos.functions import parsers as p


def one(spark, kind, value, make):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


def test_coordinates_and_times(spark):
    assert one(spark, "string", "12°30'36\"S", p.dms_to_degrees) == pytest.approx(-12.51)
    assert one(spark, "string", "no", p.dms_to_degrees) is None
    t = one(spark, "string", "2024-05-01T10:00:00.123456789+02:00", lambda c: F.date_format(p.utc_time(c), "HH:mm:ss.SSSSSS"))
    assert t == "08:00:00.123456" and one(spark, "string", "x", p.utc_time) is None


def test_abstracts(spark):
    assert one(spark, "string", json.dumps({"the": [0, 2], "cat": [1], "end": [3]}), p.abstract_of) == "the cat the end"
    assert one(spark, "string", json.dumps({"a": [300000]}), p.abstract_of) == "" and one(spark, "string", "bad", p.abstract_of) == "" and one(spark, "string", None, p.abstract_of) == ""


def test_categories_products_issns(spark):
    assert [tuple(c) for c in one(spark, "string", "Geology (Q1); Law; ", p.categories)] == [("Geology", "Q1"), ("Law", None)]
    r = one(spark, "string", "S1A_IW_GRDH_1SDV_20240501T101112_20240501T101137_053000_066ABC_1234", p.product_fields)
    assert (r.mission, r.mode, r.orbit, r.start.hour) == ("S1A", "IW", 53000, 10)
    assert one(spark, "string", "else", p.product_fields) is None
    assert one(spark, "string", "ISSN 0378-5955, 2434561x and 03785955 or 1234-5678", p.issns) == ["0378-5955", "2434-561X"]


def test_payloads(spark):
    report = {"entries": [{"d:v1": [{"date": "2024-01-01", "hour": "", "lat": 5.0100001, "lon": 100.0, "detections": 2, "vesselId": ""}]}, {"d:v1": None}]}
    rows = p.report_cells(spark.createDataFrame([(json.dumps(report),), (None,)], "x string"), "x", 0.01).collect()
    assert [tuple(r) for r in rows] == [("d:v1", "2024-01-01", None, 5.01, 100.0, 2, None)]
    events = {"entries": [{"id": "e1", "type": "gap", "start": "2024-01-01T00:00:00Z", "end": "2024-01-01T06:30:00Z", "position": {"lat": 1, "lon": 2}, "vessel": {"id": "v"}, "gap": {"distanceKm": "7.5"}}]}
    r = p.event_rows(spark.createDataFrame([(json.dumps(events),)], "x string"), "x").first()
    assert (r.event_id, r.duration_h, r.vessel_id, r.other_id) == ("e1", 6.5, "v", None)


def test_flags_and_beacons(spark):
    df = spark.createDataFrame([(574123456, "VN BOAT"), (999999999, "NET 7"), (12, "X"), (None, "Y 80%")], "m long, n string")
    got = [tuple(r) for r in df.select(p.flag_of(F.col("m")), p.gear_beacon_like(F.col("n"), F.col("m"))).collect()]
    assert got == [("VN", False), (None, True), (None, True), (None, True)]
