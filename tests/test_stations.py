"""Semantics of the place and station operators on hand-made rows."""

from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE
from hydrolith.operators import stations


def test_forecast_by_place(spark):
    origins = spark.createDataFrame([(1, "North", 1, 10), (2, "south", 1, 10), (3, None, 1, 10), (4, "north", 2, 10), (5, "north", 1, 3)], "id int, place string, day int, at bigint")
    forecasts = spark.createDataFrame([("far north", 1, 4, "a"), ("far north", 1, 11, "late"), ("east", 1, 8, "b"), ("", 1, 9, "c")], "place string, day int, retrieved bigint, rain string")
    got = {r["id"]: (r["rain"], r["place_matched"]) for r in stations.forecast_by_place(origins, forecasts, ["rain"]).collect()}
    assert got == {1: ("a", True), 2: ("c", False), 3: ("c", False), 4: (None, None), 5: (None, None)}
    assert stations.forecast_by_place(origins, forecasts.limit(0), ["rain"]).where("rain is null").count() == 5


def test_station_master(spark):
    sensors = spark.createDataFrame([("a", "rain", "x"), ("a", "level", "x"), ("b", "rain", "x"), ("b", "level", "y"), ("c", "rain", "x"), ("d", "rain", None), ("d", "rain", "x"), (None, "rain", "x"), ("e", "rain", "x")], "key string, sensor_type string, district string")
    places = spark.createDataFrame([("a", 1.0, 2.0, "x"), ("b", 1.0, 2.0, "x"), ("d", 3.0, 4.0, None), ("e", 5.0, 6.0, "z"), ("lonely", 0.0, 0.0, "x")], "key string, lon double, lat double, district string")
    got = {r["key"]: r[1:] for r in stations.station_master(sensors, places, ["district"]).collect()}
    assert got == {
        "a": ("level+rain", 2, "MERGED", 1.0, 2.0), "b": ("level+rain", 2, "EVIDENCE_DIFFERS", None, None), "c": ("rain", 1, "NO_COORDINATES", None, None),
        "d": ("rain", 2, "REPEATED_TYPE", None, None), "e": ("rain", 1, "EVIDENCE_DIFFERS", None, None),
    }


def test_unit_policy_takes_the_first_and_whole_fields(spark):
    rows = spark.createDataFrame([("s", "rain_1h"), ("s", "rain_1h_x"), ("s", "note"), (None, "note"), ("s", None)], "source string, field string")
    unit = stations.unit_policy(F.col("source"), F.col("field"), [("s", r"rain_\d+h", "mm"), ("s", "rain_1h", "m"), ("s", "note", None)])
    assert [r[0] for r in rows.select(unit).collect()] == ["mm", "NO_POLICY", "EXCLUDED", "NO_POLICY", "NO_POLICY"]


def test_sequences_need_every_slot(spark):
    at = {0: True, 5: True, 10: True, 15: True, 20: False, 25: True, 30: True, 35: True, 40: True}
    rows = spark.createDataFrame([("a", m * MINUTE, float(m), ok) for m, ok in at.items()], "sensor string, t bigint, value double, usable boolean")
    got = sorted((r["origin_us"] // MINUTE, r["inputs"], r["target"]) for r in stations.sequences(rows, 2, 5, 10).collect())
    assert got == [(5, [5.0, 0.0], 15.0), (30, [30.0, 25.0], 40.0)]


def test_shared_days_and_promotion(spark):
    days = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "sensor string, day int")
    assert sorted(map(tuple, stations.shared_days(days).collect())) == [(1, 2, True), (2, 1, False)]
    verdict, blockers = stations.promotion({"x": F.col("x") > 0, "y": F.col("y") > 0})
    got = spark.createDataFrame([(1, 1), (0, None)], "x int, y int").select(verdict, blockers).collect()
    assert [tuple(r) for r in got] == [("PROMOTE", ""), ("BLOCKED", "x,y")]
