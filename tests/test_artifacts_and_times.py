"""Merkle digests, artifacts that appear whole or not at all, verified models, and local times in zones with daylight saving."""

import datetime as dt
import threading
import zoneinfo
from pathlib import Path

import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from hydrolith.operators import timezones
from hydrolith.sources import artifacts, digests, writers


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, v string, x double")


ROWS = [(k, f"v{k % 7}", k / 3) for k in range(200)] + [(None, None, None)] * 3


def test_digest_is_that_of_the_content(spark):
    one = table(spark, ROWS)
    assert digests.content_digest(one) == digests.content_digest(table(spark, ROWS[::-1]).repartition(7)) == digests.content_digest(one.select("x", "k", "v"))
    others = [table(spark, ROWS + ROWS[:1]), table(spark, ROWS[:-1]), one.withColumn("x", F.col("x").cast("float")), one.withColumnRenamed("x", "y"), table(spark, [])]
    assert len({digests.content_digest(d) for d in [one, *others]}) == 6
    tree = digests.digest_tree(one, ["k"], 2).collect()
    assert {r["level"] for r in tree} == {0, 1, 2} and all(sum(r["rows"] for r in tree if r["level"] == k) == 203 for k in range(3))


def test_differing_leaves_without_the_tables(spark):
    one = table(spark, ROWS)
    other = table(spark, [(k, "new" if k in (5, 90) else v, x) for k, v, x in ROWS if k != 17] + [(900, "more", 1.0)])
    a, b = digests.digest_tree(one, ["k"], 2), digests.digest_tree(other, ["k"], 2)
    leaves = digests.differing(a, b)
    found = {r["k"] for r in digests.rows_of(one, ["k"], leaves, 2).collect()}
    assert {5, 90, 17} <= found and len(found) < 30 and {r["k"] for r in digests.rows_of(other, ["k"], leaves, 2).collect()} >= {5, 90, 900}
    assert digests.differing(a, digests.digest_tree(one.repartition(3), ["k"], 2)).count() == 0


def test_published_tables_are_verified(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one = table(spark, ROWS)
    digest, wrote = artifacts.publish_table(one, path, {"from": "here"})
    assert wrote and artifacts.publish_table(one.repartition(2), path) == (digest, False) and artifacts.read_card(spark, path) == {"digest": digest, "metadata": {"from": "here"}}
    assert artifacts.read_table(spark, path, one.schema).count() == 203
    with pytest.raises(ValueError, match="other content"):
        artifacts.publish_table(table(spark, ROWS[:5]), path)
    table(spark, ROWS[:1]).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="differs"):
        artifacts.read_table(spark, path, one.schema)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_two_racing_writers_leave_one_artifact(spark, tmp_path):
    path, said = f"file://{tmp_path}/race", []

    def write(rows):
        try:
            said.append(artifacts.publish_table(table(spark, rows), path)[1])
        except ValueError:
            said.append("refused")

    threads = [threading.Thread(target=write, args=(rows,)) for rows in (ROWS, ROWS[:50])]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, said)) == ["True", "refused"] and sorted(p.name for p in tmp_path.iterdir()) == ["race"]
    assert artifacts.read_table(spark, path).count() in (203, 50)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    broken = table(spark, ROWS).withColumn("x", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        artifacts.publish_table(broken, f"file://{tmp_path}/x")
    assert list(tmp_path.iterdir()) == []


def test_manifest_takes_appends_in_turn(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    threads = [threading.Thread(target=writers.append_manifest, args=(spark, table(spark, ROWS[k : k + 1]), path)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["k"] for r in writers.read_manifest(spark, path).collect()) == [0, 1, 2] and len(list((tmp_path / "m").glob("entry=*"))) == 3


def test_models_are_loaded_as_they_were_saved(spark, tmp_path):
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame([(k / 10, float(k > 20)) for k in range(50)], "x double, label double"))
    model = LogisticRegression(regParam=0.1).fit(data)
    path = artifacts.save_model(model, f"file://{tmp_path}/models", {"horizon": 30, "dataset": digests.content_digest(data.select("x", "label"))})
    again, metadata = artifacts.load_model(spark, path)
    assert isinstance(again, LogisticRegressionModel) and again.coefficients == model.coefficients and metadata["horizon"] == 30
    folder = Path(path.removeprefix("file://"))
    assert folder.name == artifacts.read_card(spark, path)["digest"][:16] and [p.name for p in folder.parent.iterdir()] == [folder.name]
    with pytest.raises(ValueError, match="class"):
        artifacts.load_model(spark, path, allowed=("com.example.",))
    part = next(folder.rglob("part-*"))
    raw = bytearray(part.read_bytes())
    raw[len(raw) // 2] ^= 1
    part.write_bytes(raw)
    part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="differs"):
        artifacts.load_model(spark, path)
    with pytest.raises(ValueError, match="no published artifact"):
        artifacts.load_model(spark, f"file://{tmp_path}/nowhere")


ZONES = ["Europe/Berlin", "Australia/Lord_Howe", "Asia/Kuala_Lumpur", "America/New_York"]


def test_local_times_by_the_zone_data_of_python(spark):
    years = timezones.zone_years(spark, ZONES, 1980, 2030).cache()
    epoch, rows = dt.datetime(1970, 1, 1), []
    for z in ZONES:
        info = zoneinfo.ZoneInfo(z)
        for start in (dt.datetime(2023, 3, 10), dt.datetime(2023, 9, 29), dt.datetime(2023, 10, 28), dt.datetime(1995, 9, 23), dt.datetime(1981, 12, 31, 20), dt.datetime(2024, 3, 30)):
            for k in range(400):
                local = start + dt.timedelta(minutes=13 * k)
                a, b = (local.replace(tzinfo=info, fold=f).utcoffset() for f in (0, 1))
                status = "VALID" if a == b else "AMBIGUOUS"
                detail = None if a == b else "FOLD" if a > b else "GAP"
                us = (local - a - epoch) // dt.timedelta(microseconds=1) if a == b else None
                rows.append((z, local.strftime("%Y-%m-%d %H:%M:%S"), status, detail, us))
    table = spark.createDataFrame(rows, "zone string, raw string, s string, d string, us bigint").withColumn("ref", F.lit(1 << 60))
    got = timezones.normalised_times(table, "raw", [("yyyy-MM-dd HH:mm:ss", "SECOND")], years, "zone", "ref")
    wrong = got.where("not (time_status <=> s and time_detail <=> d and time_us <=> us)")
    assert wrong.count() == 0 and {"FOLD", "GAP"} <= {r[2] for r in rows} | {r[3] for r in rows}


def test_odd_time_texts(spark):
    years = timezones.zone_years(spark, ["Europe/Berlin"], 2020, 2025)
    rows = [(1, None, "Europe/Berlin"), (2, "\t", None), (3, "2024-02-30", "Europe/Berlin"), (4, "2024-03-31", "Europe/Berlin"), (5, " 2024-07-01 10:00 ", "Europe/Berlin"), (6, "2024-07-01 10:00", None), (7, "2024-07-01 10:00", "Mars/Base"), (8, "1950-07-01 10:00", "Europe/Berlin"), (9, "2024-07-01T10:00-02:00", None), (10, "2024-12-01 10:00", "Europe/Berlin")]
    table = spark.createDataFrame(rows, "k int, raw string, zone string").withColumn("ref", F.lit(int(dt.datetime(2024, 8, 1, tzinfo=dt.UTC).timestamp() * 1e6)))
    got = {r["k"]: r for r in timezones.normalised_times(table, "raw", [("yyyy-MM-dd HH:mm", "MINUTE"), ("yyyy-MM-dd", "DATE"), ("yyyy-MM-dd'T'HH:mmXXX", "MINUTE")], years, "zone", "ref").collect()}
    assert [got[k]["time_status"] for k in range(1, 11)] == ["MISSING", "MISSING", "INVALID_FORMAT", "VALID", "VALID", "UNSPECIFIED_TIMEZONE", "UNSPECIFIED_TIMEZONE", "UNSPECIFIED_TIMEZONE", "VALID", "FUTURE"]
    assert got[4]["local_date"] == "2024-03-31" and got[4]["time_us"] is None and got[5]["utc_offset_minutes"] == 120 and got[9]["timezone_status"] == "EXPLICIT_IN_SOURCE"
    assert got[9]["time_us"] == int(dt.datetime(2024, 7, 1, 12, tzinfo=dt.UTC).timestamp() * 1e6) and got[6]["timezone_status"] == "UNSPECIFIED_NO_POLICY"
