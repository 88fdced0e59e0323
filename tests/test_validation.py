"""Semantics of the validation, serving and modelling operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE
from hydrolith.operators import models, serving, validation

SERIES = "sensor string, t bigint, value double, usable boolean"


def test_timestamp_status(spark):
    rows = spark.createDataFrame([("2024-01-01 08:00:00",), ("2024-02-30 00:00:00",), ("",), (None,), ("2024-01-01 08:11:00",)], "x string")
    status, us = validation.timestamp_status(F.col("x"), ("yyyy-MM-dd HH:mm:ss",), 480, F.lit(1_704_067_200_000_000))
    got = [(r["s"], r["u"]) for r in rows.select(status.alias("s"), us.alias("u")).collect()]
    assert [g[0] for g in got] == ["VALID", "INVALID_FORMAT", "MISSING", "MISSING", "FUTURE"]
    assert got[0][1] == 1_704_067_200_000_000 and got[4][1] - got[0][1] == 11 * MINUTE
    status, us = validation.timestamp_status(F.col("x"), ("yyyy-MM-dd HH:mm:ss",), None, F.lit(0))
    assert rows.select(status, us).first()[:] == ("UNSPECIFIED_TIMEZONE", None)


def test_map_stations(spark):
    mapping = spark.createDataFrame([("1", "rainfall", "a"), ("2", "water_level", "b")], "key string, sensor_type string, sensor_id string")
    rows = spark.createDataFrame([(" 1 ", "rainfall"), ("1", "water_level"), ("9", "rainfall"), ("1 2", None), (None, "rainfall"), ("1", None)], "source_id string, sensor_type string")
    got = {(r["source_id"], r["sensor_type"]): (r["mapping_status"], r["sensor_id"]) for r in validation.map_stations(rows, mapping).collect()}
    assert got == {
        (" 1 ", "rainfall"): ("MAPPED", "a"), ("1", "water_level"): ("SENSOR_TYPE_MISMATCH", None), ("9", "rainfall"): ("UNMAPPED", None),
        ("1 2", None): ("INVALID_SOURCE_ID", None), (None, "rainfall"): ("INVALID_SOURCE_ID", None), ("1", None): ("INVALID_SENSOR_TYPE", None),
    }


def test_steps_cross_blocks_and_ties(spark):
    at = [0, 10, 10, 2000, 5000]
    rows = spark.createDataFrame([("a", m * MINUTE, 1.0, True) for m in at], SERIES)
    got = sorted((r["t"] // MINUTE, None if r["prev_t"] is None else r["prev_t"] // MINUTE) for r in serving.steps(rows).collect() if r["prev_t"] is not None)
    assert got == [(10, 0), (10, 10), (2000, 10), (5000, 2000)]
    assert serving.cadence_summary(rows).first()["duplicates"] == 1


def test_chart_rows_mark_gaps(spark):
    rows = spark.createDataFrame([("a", 0, 1.0, True), ("a", 10 * MINUTE, 2.0, False), ("a", 21 * MINUTE, 3.0, True)], SERIES)
    got = sorted((r["t"] // MINUTE, r["value"], r["is_break"]) for r in serving.chart_rows(rows, 5).collect())
    assert got == [(0, 1.0, False), (10, None, False), (15, None, True), (21, 3.0, False)]


def test_one_hot_and_vocabulary_bound(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("z",)], "x string")
    assert models.fit_vocabulary(rows.where("x <> 'z'"), "x") == ["a", "b"]
    assert [r[0] for r in rows.select(models.one_hot(F.col("x"), ["a", "b"])).collect()] == [[0, 1, 0], [1, 0, 0], [0, 0, 1], [0, 0, 1]]
    with pytest.raises(ValueError, match="more than 2"):
        models.fit_vocabulary(rows, "x", 2)


def test_champion_needs_one_comparable_key(spark):
    runs = spark.createDataFrame([("r1", "d", 0.5, 0.1), ("r2", "d", 0.5, 0.2), ("r3", "d", 0.4, 0.9)], "run string, digest string, recall double, ap double")
    assert models.champion(runs, "run", "digest", ["recall", "ap"]).first()["run"] == "r2"
    assert models.champion(runs.withColumn("digest", F.col("run")), "run", "digest", ["recall", "ap"]).count() == 0


def test_classifier_refuses_one_class(spark):
    with pytest.raises(ValueError, match="both classes"):
        models.fit_classifier(spark.createDataFrame([(1.0, 1), (2.0, 1)], "x double, y int"), ["x"], "y")
