"""Ingestion, live polls, write-once tables, registry, calibration and station models on hand-made rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolith.operators import blocks, canonical, contracts, ingestion, missingness, models, readiness, registry
from hydrolith.sources import readers, writers
from hydrolith.streaming import live

M = 60_000_000


def test_a_payload_is_ingested_once(spark):
    schema = "source string, dataset string, partition string, batch string, retrieved_us bigint, content string"
    rows = [("s", "d", None, "b1", 1, "k1;k1"), ("s", "d", None, "b2", 2, "k1;k1"), ("s", "d", "p", "b3", 3, "k1;k1"), ("s", "d", None, "b4", 4, "zz"), ("s", "d", None, "b5", 5, "")]
    mapping = spark.createDataFrame([("s", "k1", "rainfall", "fg1")], "source string, station_id string, sensor_type string, sensor_id string")
    parse = lambda new: new.where("content <> ''").select("batch", "source", F.explode(F.split("content", ";")).alias("station_id"), F.lit("rainfall").alias("sensor_type"))
    none = spark.createDataFrame([], "source string, dataset string, partition string, payload_sha256 string, status string")
    records, entries = ingestion.ingest(spark.createDataFrame(rows, schema), none, parse, mapping)
    assert sorted((r["batch"], r["rows"], r["duplicates"], r["quarantined"]) for r in entries.collect()) == [("b1", 2, 1, 0), ("b3", 2, 1, 0), ("b4", 1, 0, 1), ("b5", 0, 0, 0)]
    assert sorted((r["batch"], r["sensor_id"], r["quarantine"]) for r in records.collect() if r["batch"] == "b4") == [("b4", None, "UNMAPPED_STATION")]
    again = ingestion.ingest(spark.createDataFrame(rows, schema), entries, parse, mapping)[1]
    assert again.count() == 0
    assert ingestion.manifest_problems(entries).count() == 0
    with pytest.raises(ValueError):
        ingestion.manifest_problems(entries.drop("rows"))


def test_late_rows_are_taken_and_future_ones_set_aside(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    schema = "k string, ts timestamp, seen timestamp, value double"
    work = live.poll_into(str(tmp_path / "store"), ["k", "ts"], "ts", "seen")
    first = spark.createDataFrame([("a", at(10), at(10), 1.0), ("a", at(12), at(10), 2.0)], schema)
    work(first, 0)
    work(first, 0)  # the poll runs again after a failure
    work(spark.createDataFrame([("a", at(2), at(11), 3.0), ("a", at(10), at(11), 9.0)], schema), 1)
    got = sorted((r["value"], r["poll"]) for r in spark.read.parquet(str(tmp_path / "store/rows")).collect())
    assert got == [(1.0, 0), (3.0, 1)]
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "store/future")).collect()] == [2.0]


def test_named_tables_and_manifests_refuse_other_content(spark, tmp_path):
    one, two = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert writers.write_named(one, f"file://{tmp_path}", "t") and not writers.write_named(one, f"file://{tmp_path}", "t")
    with pytest.raises(ValueError):
        writers.write_named(two, f"file://{tmp_path}", "t")
    seen = writers.append_manifest(spark, one, f"file://{tmp_path}/m", "")
    writers.append_manifest(spark, two, f"file://{tmp_path}/m")
    with pytest.raises(ValueError):
        writers.append_manifest(spark, two, f"file://{tmp_path}/m", seen)


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "sites.csv").write_bytes(b"\xef\xbb\xbfsite_id,name\n1,x\n2,\n")
    for n in ("sensors", "thresholds"):
        (tmp_path / f"{n}.csv").write_text("k\n1\n")
    rows, digest = readers.read_csv_digested(spark, [str(tmp_path / "sites.csv")])
    assert rows.columns == ["site_id", "name"] and len(digest) == 64 and {r["name"] for r in rows.collect()} == {"x", None}
    import hashlib

    sha = hashlib.sha256((tmp_path / "sites.csv").read_bytes()).hexdigest()
    assert readers.station_context(spark, str(tmp_path), f"sites.csv@sha256:{sha[:12]}") is not None
    assert readers.station_context(spark, str(tmp_path), "sites.csv@sha256:00000000") is None


def test_page_state(spark):
    html = "<select><option value='PNG'>a</option><option value=\"KDH\">b</option></select> <i>Kemaskini 05/02/2024 10:15</i>"
    got = readers.page_state(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("page_id").collect()
    assert got[0]["options"] == ["PNG", "KDH"] and got[0]["updated"] == "05/02/2024 10:15" and got[1]["options"] == [] and got[1]["updated"] is None


def test_runs_are_logged_once_and_audited(spark):
    runs = spark.createDataFrame([("r1", "t", 1.0), ("r2", "t", 2.0)], "run_id string, task string, score double")
    empty = spark.createDataFrame([], "run_id string, task string, score double, digest string")
    log, clash = registry.log_runs(empty, runs, ["task", "score"])
    assert log.count() == 2 and clash.count() == 0 and registry.audit(log, ["task", "score"]).count() == 0
    log2, clash = registry.log_runs(log, runs.withColumn("score", F.when(F.col("run_id") == "r1", 7.0).otherwise(F.col("score"))), ["task", "score"])
    assert log2.count() == 2 and [r["run_id"] for r in clash.collect()] == ["r1"]


def test_permutation_contributions(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3), 0.0) for i in range(500)], "row_id bigint, a double, b double, c double")
    got = {r["feature"]: (r["contribution"], r["rank"]) for r in registry.permutation_contributions(rows, ["a", "b", "c"], lambda x: 2 * x["a"] + x["b"] + 0 * x["c"]).collect()}
    assert got["a"][1] == 1 and got["b"][1] == 2 and got["c"] == (0.0, 3)
    # two values drawn at random from 0..6 are 16 / 7 apart on average
    assert abs(got["a"][0] - 2 * 16 / 7) < 0.5
    numbered = registry._numbered(rows.select("row_id"), F.xxhash64("row_id"), blocks=8)
    assert sorted(r["_no"] for r in numbered.collect()) == list(range(500))


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration(spark, method):
    rng = np.random.default_rng(0)
    p = rng.random(2000)
    rows = spark.createDataFrame([(float(s), int(rng.random() < s * s)) for s in p], "score double, label int")
    got = models.calibrated(models.fit_calibration(rows, "score", "label", method), rows, "score").toPandas().sort_values("score")
    assert (got["calibrated"].diff().dropna() >= -1e-9).all() and got["calibrated"].between(0, 1).all()
    assert abs(got["calibrated"].mean() - got["label"].mean()) < 0.02
    with pytest.raises(ValueError):
        models.fit_calibration(rows.where("label = 0"), "score", "label", method)


def test_station_models(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s, (a, b, c) in {"x": (0.5, 0.2, 1.0), "y": (-0.3, 0.9, 0.0)}.items():
        for _ in range(80):
            p, q = rng.normal(size=2)
            rows.append((s, float(a * p + b * q + c), float(p), float(q)))
    rows += [("z", 1.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "station string, y double, p double, q double")
    got = {r["station"]: r["coefficients"] for r in models.fit_autoregression(table, "station", "y", ["p", "q"]).collect()}
    assert np.allclose(got["x"], [0.5, 0.2, 1.0]) and np.allclose(got["y"], [-0.3, 0.9, 0.0]) and got["z"] is None
    fitted = models.fit_station_regressors(table, "station", ["p", "q"], "y")
    assert set(fitted) == {"x", "y"}
    e = fitted["x"].transform(table.where("station = 'x'")).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert e < 0.2


def test_contract_errors_name_their_reasons(spark):
    schema = "sensor_id string, measurement_type string, t bigint, local_us bigint, value double, usable boolean, unit string, sensor_type string"
    good = ("a", "WATER_LEVEL", 0, 480 * M, 1.0, True, "m", "water_level")
    kept, other = contracts.select_measurement(spark.createDataFrame([good, ("r", "RAINFALL_INTERVAL", 0, 0, 1.0, True, "x", "x")], schema), "WATER_LEVEL")
    assert kept.count() == 1 and [tuple(r) for r in other.collect()] == [("RAINFALL_INTERVAL", 1)]
    for change, reason in ((("a", "WATER_LEVEL", 0, 480 * M, float("nan"), True, "m", "water_level"), "INVALID_USABLE_VALUE"), (good, "REPEATED_KEY")):
        with pytest.raises(ValueError, match=reason):
            contracts.select_measurement(spark.createDataFrame([good, change], schema), "WATER_LEVEL")


def test_blocked_windows_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(t) * M, float(v)) for s in "ab" for t, v in zip(np.unique(rng.integers(0, 20000, 300)), rng.normal(size=300))]
    table = spark.createDataFrame(rows, "sensor string, t bigint, value double")
    got = blocks.lagged(table, ["sensor"], ["t"], blocks.by_time(), {"before": "value"})
    got = blocks.running(got, ["sensor"], [F.col("t")], blocks.by_time(), {"total": F.col("value")})
    got = blocks.running(got, ["sensor"], [F.col("t")], blocks.by_time(), {"top": F.col("value")}, "max")
    for _, g in got.toPandas().groupby("sensor"):
        g = g.sort_values("t")
        assert np.allclose(g["total"], g["value"].cumsum()) and np.allclose(g["top"], g["value"].cummax())
        assert g["before"].fillna(-9).tolist() == g["value"].shift().fillna(-9).tolist()


def test_features_that_may_be_used():
    registry_ = {"rf_sum": "HISTORICAL", "site": "STATIC", "future": "LEAKS"}
    kept, why = readiness.eligible_features(["rf_sum", "site", "future", "target_60", "x_exceeds", "other"], registry_)
    assert kept == ["rf_sum", "site"] and why == {"future": "LEAKS", "target_60": "TARGET", "x_exceeds": "TARGET", "other": "NOT_REGISTERED"}


def test_layers_that_match_row_by_row(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, p string"), spark.createDataFrame([(1, "u"), (3, "v")], "k int, q string")
    rows, bad = canonical.layered({"a": a, "b": b}, ["k"])
    assert [tuple(r) for r in rows.collect()] == [(1, "x", "u")] and sorted(tuple(r) for r in bad.collect()) == [(2, "MISSING_IN_b"), (3, "MISSING_IN_a")]


def test_scaling_there_and_back(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 9.0)], "s string, v double")
    fitted = readiness.fit_scalers(rows.where("s <> 'c'"), "s", "v")
    there = readiness.scale(rows, fitted, "s", "v")
    assert {(r["s"], r["v"]): r["scaled"] for r in there.collect()} == {("a", 1.0): -1.0, ("a", 3.0): 1.0, ("b", 5.0): 0.0, ("c", 9.0): None}
    back = readiness.scale(there.select("s", F.col("scaled").alias("v")), fitted, "s", "v", inverse=True)
    assert sorted(r["scaled"] for r in back.collect() if r["s"] == "a") == [1.0, 3.0]


def test_a_guard_keeps_the_sample_size(spark):
    got = spark.createDataFrame([(1.0,), (2.0,)], "v double").agg(missingness.guarded(F.avg("v"), F.count("*"), 3).alias("g")).first()["g"]
    assert tuple(got) == ("INSUFFICIENT_SAMPLE", None, 2, 3)
