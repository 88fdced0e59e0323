"""Substring joins, cumulative series, whole feature rows, analysis documents, and what is refused."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hydrolith.operators import blocks, canonical, contracts, counters, documents, features, missingness, readiness, stations

M = 60_000_000


@pytest.mark.parametrize("grams", [1, 3])
def test_substring_pairs(spark, grams):
    rng = random.Random(grams)
    names = ["".join(rng.choices("abc é", k=rng.randint(1, 7))) for _ in range(150)]
    a, b = names[:60] + ["", None, "zz", "a"], names[60:] + names[:5] + ["", None]
    one = lambda rows: spark.createDataFrame([(r,) for r in rows], "text string")
    got = [tuple(r) for r in stations.contained(one(a), one(b), grams).collect()]
    want = {(x, y) for x in a if x for y in b if y and x in y}
    assert len(got) == len(set(got)) and set(got) == want
    plan = stations.contained(one(a), one(b))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert stations.contained(one([]), one(b)).count() == stations.contained(one(a), one([])).count() == 0


def test_counters_tell_totals_from_intervals(spark, monkeypatch):
    monkeypatch.setattr(blocks, "by_time", lambda t="t", m=35: F.floor(F.col(t) / (m * M)))
    rng, rows, fell = random.Random(2), [], {}
    for s in ("total", "interval", "short"):
        value = 0.0
        for k in range(200 if s != "short" else 5):
            rain = rng.choice([0.0, 0.0, 0.5, 2.0])
            if s != "interval":
                value = rain if k in (60, 130) else value + rain  # the counter starts again
            rows.append((s, k * 5 * M, value if s != "interval" else rain, k % 17 != 3))
            fell[s, k] = rain
    series = spark.createDataFrame(rows, "sensor string, t bigint, value double, usable boolean")
    verdicts = {r["sensor"]: (r["verdict"], r["restarts"]) for r in counters.semantics(series, 5).collect()}
    assert verdicts["total"] == ("ACCUMULATED", 2) and verdicts["interval"][0] == "INTERVAL" and verdicts["short"][0] == "UNDETERMINED"
    got = counters.increments(series.where("sensor = 'total'"), 5).orderBy("t").collect()
    good = [k for k in range(200) if k % 17 != 3]
    assert [r["t"] for r in got] == [k * 5 * M for k in good] and got[0]["increment"] is None
    for before, k, r in zip(good, good[1:], got[1:]):
        meanwhile = [x for x in range(before + 1, k + 1)]
        if not any(x in (60, 130) for x in meanwhile):
            assert r["increment"] == pytest.approx(sum(fell["total", x] for x in meanwhile)) and r["regular"] == (k - before == 1)
    assert [r["t"] // (5 * M) for r in got if r["restarted"]] == [60, 130]
    assert got[-1]["total"] == pytest.approx(sum(r["increment"] for r in got[1:]))


def test_documents_are_the_same_text_however_rows_lie(spark):
    rng = random.Random(1)
    rows = [(f"s{k % 7}", "RAIN" if k % 7 < 4 else "LEVEL", k * 60 * M, round(rng.uniform(0, 9), 3) if k % 11 else None, k % 5 > 0) for k in range(3000)]
    schema = "sensor string, measurement_type string, t bigint, value double, usable boolean"
    made = []
    for data, parts in ((rows, 1), (rows[::-1], 5)):
        levels = documents.level_summaries(spark.createDataFrame(data, schema).repartition(parts), 60, 24, wet=5.0)
        made.append({r[0]: r[1] for r in documents.analysis_documents(levels, "v1", {"b": "x", "a": "y"}).collect()})
    assert made[0] == made[1] and set(made[0]) == {"RAIN", "LEVEL"}
    doc = json.loads(made[0]["RAIN"])
    assert [s["sensor"] for s in doc["stations"]] == ["s0", "s1", "s2", "s3"] and doc["stations_analysed"] == 4 and doc["network"]["rows"] == 3000
    own = [r[3] for r in rows if r[0] == "s2" and r[4] and r[3] is not None]
    s = doc["stations"][2]
    assert s["usable"] == len(own) and s["total"] == pytest.approx(sum(own)) and s["mean"] == pytest.approx(sum(own) / len(own), abs=1e-6)
    assert s["std"] == pytest.approx((sum((x - sum(own) / len(own)) ** 2 for x in own) / (len(own) - 1)) ** 0.5, abs=1e-4) and s["wet"] == sum(x > 5 for x in own)
    assert documents.analysis_documents(documents.level_summaries(spark.createDataFrame([], schema), 60, 24), "v", {}).count() == 0


def test_feature_rows_are_made_of_one_observation(spark):
    series = spark.createDataFrame([("a", k * 60 * M, float(k), True) for k in range(30)] + [("b", 0, 1.0, False)], "sensor string, t bigint, value double, usable boolean")
    metadata = spark.createDataFrame([("a", "north"), ("b", "")], "sensor string, region string")
    got = features.feature_rows(series, (180,), (360,), (60,), (120,), 60, wet=5.0, metadata=metadata)
    last = {r["t"]: r for r in got.collect()}[29 * 60 * M]
    assert (last["rf_roll_180m_sum"], last["rf_antecedent_360m_sum"], last["rf_lag_60m"], last["wl_delta_120m"], last["rf_minutes_since_last_wet"], last["region"], last["time_hour"]) == (84.0, 159.0, 28.0, 2.0, 0.0, "north", 5)
    assert got.count() == 30 and {r["rf_minutes_since_last_wet"] for r in got.where(f"t < {6 * 60 * M}").collect()} == {None}
    with pytest.raises(ValueError, match="repeated sensor, t"):
        features.feature_rows(series.union(series.limit(1)), (180,), (360,), (60,), (120,), 60)
    with pytest.raises(ValueError, match="repeated sensor"):
        features.feature_rows(series, (180,), (360,), (60,), (120,), 60, metadata=metadata.union(metadata))


def test_captures_that_disagree_are_refused(spark):
    schema = "sensor string, t bigint, batch string, row int, field string, dataset string, sha string, retrieved_us bigint, value_raw string, parsed_value double, parse_status string, quality_flags array<string>, excluded string, unit string, site_id string"
    row = lambda s, unit, site, batch: (s, 5, batch, 1, "f", "d", "0", 1, "1", 1.0, "NUMERIC", [], None, unit, site)
    good = spark.createDataFrame([row("a", "mm", "x", "b1"), row("a", "mm", "x", "b2"), row("n", "m", None, "b1"), row("n", "m", None, "b2")], schema)
    assert canonical.observations(good, ["sensor", "t"]).count() == 2
    for other, column in ((row("a", "m", "x", "b3"), "unit"), (row("a", "mm", None, "b3"), "site_id")):
        with pytest.raises(Exception, match=f"canonical key a, 5: captures disagree on {column}"):
            canonical.observations(good.union(spark.createDataFrame([other], schema)), ["sensor", "t"]).collect()


def test_stations_without_a_scaler_are_refused(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("c", 9.0)], "s string, v double")
    fitted = readiness.fit_scalers(rows.where("s = 'a'"), "s", "v")
    assert sorted(r["scaled"] for r in readiness.scale(rows.where("s = 'a'"), fitted, "s", "v", unseen="refuse").collect()) == [-1.0, 1.0]
    with pytest.raises(Exception, match="no scaler for station c"):
        readiness.scale(rows, fitted, "s", "v", unseen="refuse").collect()


def test_frozen_thresholds_and_rule_scores(spark):
    chosen = spark.createDataFrame([(30, 0.4), (60, 0.9)], "h int, threshold double")
    rows = spark.createDataFrame([(30, 0.4), (30, 0.39), (60, 0.5), (90, 1.0), (60, None)], "h int, score double")
    assert sorted(map(str, [tuple(r) for r in readiness.frozen_threshold(rows, chosen, ["h"], "score").collect()])) == sorted(map(str, [(30, 0.4, 1), (30, 0.39, 0), (60, 0.5, 0), (90, 1.0, None), (60, None, None)]))
    score = readiness.rule_score([(F.col("a"), 2.0), (F.col("b"), 5.0)])
    got = spark.createDataFrame([(1.0, 5.0), (1.0, None), (None, None)], "a double, b double").select(score.alias("s")).collect()
    assert [r["s"] for r in got] == [1.0, 0.0, None]


def test_windows_off_the_grid_have_no_slots(spark):
    rows = [("a", k * 5 * M, "b", True, "USABLE") for k in (0, 1, 3)] + [("a", (100 * 5 + 2) * M, "c", True, "USABLE"), ("a", 101 * 5 * M, "c", False, "EMPTY")]
    table = spark.createDataFrame(rows, "sensor string, t bigint, batch string, usable boolean, state string")
    windows = missingness.capture_windows(table, 5, 30)
    listed = spark.createDataFrame([("a", 2 * 5 * M), ("a", 101 * 5 * M - M), ("z", 0)], "sensor string, t bigint")
    facts = {r["window"]: (r["source_rows"], r["off_grid_rows"], r["listing_only_rows"], r["cadence_status"]) for r in missingness.window_facts(windows, table, 5, listed).collect()}
    assert facts == {0: (3, 0, 1, "CADENCE_VERIFIED"), 1: (2, 1, 1, "CADENCE_OFF_GRID")}
    slots = {(r["window"], r["t"] // (5 * M)): r["state"] for r in missingness.window_slots(windows, table, 5, listed).collect()}
    assert slots == {(0, 0): "USABLE", (0, 1): "USABLE", (0, 2): "LISTING_ONLY_SLOT", (0, 3): "USABLE"}
    assert {r["window"] for r in missingness.slot_runs(table, 5, 30, on_grid=False).collect()} == {0}


def test_repeated_keys_are_named(spark):
    table = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    assert contracts.require_unique(table, ["k", "v"]).count() == 3
    with pytest.raises(ValueError, match=r"repeated k: \(2,\)"):
        contracts.require_unique(table, ["k"])


def test_quality_rows_of_layers_that_fit(spark):
    from hydrolith.operators import quality

    records = spark.createDataFrame([("b", 1, "s1", "water_level_history", " ERROR ", None), ("b", 2, "s2", "x", None, "MISSING_TIMESTAMP")], "batch string, row int, sensor_id string, dataset string, severity string, quarantine_reason string")
    times = spark.createDataFrame([("b", 1, "VALID", "MINUTE", "UNSPECIFIED_ASSUMED")], "batch string, row int, time_status string, time_precision string, timezone_status string")
    stations = spark.createDataFrame([("b", 1, "s1", "MAPPED", "s1")], "batch string, row int, raw_sensor_id string, mapping_status string, sensor_id string")
    unit = "batch string, row int, field string, role string, value_raw string, value_parse_status string, parsed_value double, measurement_type string, unit_status string"
    rows = [("b", 1, "v", "PRIMARY_VALUE", "2", "NUMERIC", 2.0, "WATER_LEVEL", "VALID"), ("b", 1, "t", "THRESHOLD", "9", "NUMERIC", 9.0, "WATER_LEVEL_THRESHOLD", "VALID"), ("b", 1, "n", "SOURCE_FIELD", "x", "NON_NUMERIC", None, None, "UNKNOWN_MEASUREMENT_SEMANTICS"), ("b", 2, "v", "PRIMARY_VALUE", " ", "EMPTY", None, "WATER_LEVEL", "VALID")]
    units = spark.createDataFrame(rows, unit)
    got = {r["row"]: (r["field"], r["quality_flags"], r["usable"], r["sensor_id"], r["raw_file"]) for r in quality.quality_rows(records, times, stations, units, ["batch", "row"]).collect()}
    assert got == {1: ("v", ["SOURCE_SEVERITY_ERROR", "TIMEZONE_ASSUMED"], True, "s1", "records"), 2: ("v", ["NO_STATION_SENSOR", "RAW_QUARANTINED", "TIMESTAMP_MISSING", "VALUE_EMPTY"], False, None, "quarantine")}
    with pytest.raises(Exception, match="record b, 2: not one PRIMARY_VALUE"):
        quality.quality_rows(records, times, stations, units.where("row = 1"), ["batch", "row"]).collect()
    with pytest.raises(Exception, match="record b, 1: the station layer names another sensor"):
        quality.quality_rows(records, times, stations.withColumn("raw_sensor_id", F.lit("s9")), units, ["batch", "row"]).collect()
