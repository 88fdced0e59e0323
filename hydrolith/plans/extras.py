"""Queries of episode reasons, feeds, mappings and text forms over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import core
from hydrolith.operators import feeds, ingestion, islands, joins
from hydrolith.plans.catalog import EPISODES, HOUR, US, _query, cuts, observations, table
from hydrolith.plans.operations import mapping


def _episodes(spark, sf_dir):
    return islands.episodes(observations(spark, sf_dir), cuts(spark, sf_dir), HOUR, 720)


COUNTS = "count(*) AS episodes, count(*) FILTER (termination = 'WINDOW_EDGE') AS window_edge, count(*) FILTER (termination = 'INTERRUPTED_BY_MISSING_DATA') AS interrupted_by_missing_data, count(*) FILTER (termination = 'ENDED_BELOW_THRESHOLD') AS ended_below_threshold, max(duration_minutes) AS longest_minutes, sum(duration_minutes) AS total_minutes, max(peak) AS peak"


@_query(EPISODES + f"SELECT sensor, threshold_type, {COUNTS} FROM eps GROUP BY 1, 2")
def episode_reasons(spark, sf_dir):
    return islands.termination_counts(_episodes(spark, sf_dir), ["sensor", "threshold_type"])


@_query(EPISODES + f"SELECT threshold_type, {COUNTS} FROM eps GROUP BY 1")
def network_episodes(spark, sf_dir):
    return islands.termination_counts(_episodes(spark, sf_dir), ["threshold_type"])


@_query(f"SELECT a.sensor, a.t AS origin_us, a.value - b.value AS d1, b.value - c.value AS d2 FROM obs a JOIN obs b ON a.sensor = b.sensor AND b.t = a.t - {60 * US} JOIN obs c ON a.sensor = c.sensor AND c.t = a.t - {180 * US} WHERE a.usable AND b.usable AND c.usable")
def lag_deltas(spark, sf_dir):
    m = joins.lag_deltas(observations(spark, sf_dir), (0, 60, 180))
    return m.select("sensor", "origin_us", F.col("deltas")[0].alias("d1"), F.col("deltas")[1].alias("d2"))


@_query("""SELECT s_suppkey AS location_id, s_nationkey % 7 + 3.5::DOUBLE - (s_nationkey % 5) AS temperature_range FROM supplier WHERE s_suppkey % 3 = 0""")
def place_forecasts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    f = s.select(F.col("s_suppkey").alias("location_id"), F.lit("2024-01-01").alias("forecast_date"), (F.col("s_nationkey") % 5).cast("double").alias("min_temp_c"), (F.col("s_nationkey") % 7 + F.lit(3.5)).alias("max_temp_c"))
    return feeds.of_places(f, s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("location_id"))).select("location_id", "temperature_range")


@_query("SELECT 's' || s_suppkey AS station_id FROM supplier WHERE s_suppkey % 6 = 0")
def mapping_problems(spark, sf_dir):
    m = mapping(spark, sf_dir).withColumn("sensor_id", F.when(F.substring("station_id", 2, 9).cast("int") % 6 == 0, "odd").otherwise(F.col("sensor_id")))
    return ingestion.mapping_problems(m, F.concat(F.lit("fg"), F.substring("station_id", 2, 9))).select("station_id")


@_query("SELECT o_orderkey FROM orders WHERE o_custkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_custkey % 3 <> o_orderkey % 3")
def mapping_conflicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 3).alias("raw"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 3).alias("derived"))
    return ingestion.mapping_conflicts(o, "raw", "derived").select("o_orderkey")


@_query("SELECT event_id, greatest(epoch_us(ts), epoch_us(ts) + (user_id % 9 - 4) * 60000000) AS available_us FROM events")
def available_from(spark, sf_dir):
    t = core.micros(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", ingestion.available_at(t + (F.col("user_id") % 9 - 4) * US, t).alias("available_us"))


@_query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal::DOUBLE END AS value, CASE WHEN c_acctbal <= 0 THEN 'NEGATIVE' END AS reason, c_acctbal <= 0 AS is_quarantined FROM customer")
def accepted_and_quarantined(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    good = c.where("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").cast("double").alias("value"))
    return ingestion.with_quarantined(good, c.where("c_acctbal <= 0").select("c_custkey", F.lit("NEGATIVE").alias("reason")))


@_query("SELECT p_partkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS sensor_id, CASE WHEN s_suppkey % 2 = 0 THEN 'found' ELSE 'missing' END AS side FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def sensor_thresholds(spark, sf_dir):
    sensors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_suppkey").alias("sensor_id"), F.when(F.col("s_suppkey") % 2 == 0, "water_level").otherwise("rainfall").alias("sensor_type"))
    found, missing = feeds.thresholds_of_sensors(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")), sensors)
    return found.select("key", "sensor_id", F.lit("found").alias("side")).union(missing.select("key", F.lit(None).cast("bigint"), F.lit("missing")))


@_query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_id % 180 + 0.5::DOUBLE END AS lon, CASE WHEN event_id % 4 <> 0 THEN -(event_id % 90)::DOUBLE END AS lat FROM events")
def wkt_points(spark, sf_dir):
    k = F.col("event_id")
    text = F.when(k % 4 == 0, "POINT (x 1)").otherwise(F.concat(F.lit("POINT ("), (k % 180 + F.lit(0.5)).cast("string"), F.lit(" "), (-(k % 90)).cast("string"), F.lit(")")))
    lon, lat = core.parse_wkt(F.col("w"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("w")).select("event_id", lon.alias("lon"), (lat + 0.0).alias("lat"))


@_query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN '2.5' WHEN 2 THEN '[1,2]' END AS v FROM events")
def json_scalars(spark, sf_dir):
    k = F.col("event_id") % 4
    body = F.when(k == 0, '{"v": true}').when(k == 1, '{"v": 2.50}').when(k == 2, '{"v": [1, 2]}').otherwise('{"v": null}')
    return table(spark, sf_dir, "events").select("event_id", core.json_text(body, "$.v").alias("v"))


@_query("SELECT region.r_regionkey, 'No,Nama,' || r_name || ' 1 Jam,' || r_name || ' Harian,Graf' AS labels FROM region")
def table_headers(spark, sf_dir):
    first = F.array(F.lit("No"), F.lit("Nama"), F.col("r_name"), F.lit("Graf"))
    return table(spark, sf_dir, "region").select("r_regionkey", F.array_join(core.header_labels(first, F.array(F.lit("1 Jam"), F.lit("Harian")), 2), ",").alias("labels"))
