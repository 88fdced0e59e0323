"""Semantics of single operators on hand-made rows."""

import uuid

from pyspark.sql import functions as F

from hydrolith.functions import core
from hydrolith.operators import canonical, islands, joins, statistics, windows
from hydrolith.sources import readers, writers
from hydrolith.streaming import live

M = core.MINUTE
SERIES = "sensor string, t bigint, value double, usable boolean"


def series(spark, values, step=5):
    return spark.createDataFrame([("a", k * step * M, v, v is not None) for k, v in enumerate(values)], SERIES)


def test_uuid5(spark):
    space = uuid.NAMESPACE_URL
    names = ["a", "", "sensor/ß", "x" * 100]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(core.uuid5(str(space), F.col("n"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(space, n)) for n in names]


def test_value_status(spark):
    cases = {"-9999.0": "SOURCE_MARKER", "ERROR": "SOURCE_MARKER", " ": "EMPTY", "0": "NUMERIC", "-1.5e3": "NUMERIC", "1,5": "NON_NUMERIC", "nan": "NON_NUMERIC"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r[0]: r[1] for r in rows.select("x", core.value_status(F.col("x"))).collect()} == cases


def test_gate_nulls_the_sum_but_not_the_coverage(spark):
    rows = {r["t"] // (5 * M): r for r in windows.rolling(series(spark, [1.0, 1.0, None, 2.0, 1.0, 1.0]), (15,), 5).collect()}
    assert 2 not in rows
    assert rows[3]["rf_roll_15m_sum"] is None and rows[3]["rf_roll_15m_coverage"] == 0.666667
    assert rows[5]["rf_roll_15m_sum"] == 4.0 and rows[5]["rf_roll_15m_wet_count"] == 3


def test_blocks_give_the_same_windows(spark):
    many = [float(k % 7) for k in range(400)]
    got = {r["t"] // (5 * M): r["rf_roll_30m_sum"] for r in windows.rolling(series(spark, many), (30,), 5).collect()}
    assert len(got) == 400
    assert all(got[k] == sum(many[k - 5 : k + 1]) for k in range(5, 400))


def test_episode_reasons(spark):
    cut = spark.createDataFrame([("a", "BAHAYA", 5.0)], "sensor string, threshold_type string, threshold double")
    got = islands.episodes(series(spark, [6.0, 7.0, 1.0, 6.0, None, 8.0]), cut, 5).orderBy("episode").collect()
    assert [r["termination"] for r in got] == ["ENDED_BELOW_THRESHOLD", "INTERRUPTED_BY_MISSING_DATA", "WINDOW_EDGE"]
    assert [r["duration_minutes"] for r in got] == [5.0, 0.0, 0.0]


def test_resolve(spark):
    rows = spark.createDataFrame([("a", 1, "1"), ("b", 1, "1"), ("b", 2, "1.0"), ("c", 1, "1"), ("c", 2, "2"), ("d", 1, "1"), ("d", 2, "ERROR"), ("e", 1, "ERROR")], "k string, n int, value_raw string")
    got = {r["k"]: (r["duplicate_status"], r["conflict_reason"], r["usable"]) for r in canonical.resolve(rows, ["k"], ["n"]).collect()}
    assert got == {"a": ("UNIQUE", None, True), "b": ("IDENTICAL", None, True), "c": ("CONFLICT", "NUMERIC_VALUES_DIFFER", False), "d": ("CONFLICT", "MARKER_VS_NUMERIC", False), "e": ("UNIQUE", None, False)}


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("c", 1, "z")], "k string, at int, v string")
    assert {(r["k"], r["t"]): r["v"] for r in joins.as_of(left, right, ["k"], "t", "at", ["v"]).collect()} == {("a", 5): "y", ("a", 1): None, ("b", 9): None}


def test_quantile_guard():
    assert [statistics.needed(q) for q in (0.5, 0.75, 0.9, 0.95, 0.99)] == [10, 20, 50, 100, 500]


def test_history_and_tables(spark):
    body = '{"info": {"name": "x"}, "values": [{"dt": "1", "raw": 2.50}, {"dt": "2", "raw": null}]}'
    got = readers.history_rows(spark.createDataFrame([(1, body), (2, "No result")], "id int, body string")).collect()
    assert [(r["id"], r["source_fields_raw"]["raw"]) for r in got] == [(1, "2.5"), (1, None)]
    page = "<table><tr><th>No</th></tr><tr><td> 1 </td><td>a\n b</td></tr></table>"
    got = readers.table_rows(spark.createDataFrame([(7, page), (8, None)], "page_id int, html string")).collect()
    assert [r["cells"] for r in got] == [["No"], ["1", "a b"]]


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path, wrote = writers.write_once(df, f"file://{tmp_path}/t")
    again = writers.write_once(df.orderBy(F.desc("k")), f"file://{tmp_path}/t")
    assert wrote and again == (path, False)


def test_stream_equals_batch(spark, tmp_path):
    schema = "k string, ts timestamp, value double"
    rows = [("a", f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(0, 50, 7)] + [("a", "2024-01-01 00:00:00", 0.0)]
    df = spark.createDataFrame(rows, "k string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = live.first_seen(live.file_stream(spark, str(tmp_path / "in"), schema), ["k", "ts"], "ts")
    got = live.drain(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert got.count() == live.first_seen(df, ["k", "ts"], "ts").count() == 8
