"""Queries of the place and station operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import core
from hydrolith.operators import stations, statistics
from hydrolith.plans.catalog import HOUR, US, _query, observations, table

OURS = "CASE user_id % 4 WHEN 0 THEN 'North' WHEN 1 THEN ' east coast' WHEN 2 THEN 'Harbour' END"
THEIRS = "CASE user_id % 3 WHEN 0 THEN 'north point' WHEN 1 THEN 'EAST' ELSE '' END"


@_query(f"""WITH a AS (SELECT event_id, epoch_us(ts) AS us, ts::DATE AS day, lower(trim({OURS})) AS p FROM events WHERE event_type = 'view'),
b AS (SELECT event_id AS forecast_id, epoch_us(ts) AS us, ts::DATE AS day, lower(trim({THEIRS})) AS p FROM events WHERE event_type = 'click'),
j AS (SELECT a.event_id, b.forecast_id, b.us, coalesce(a.p <> '' AND b.p <> '' AND (contains(a.p, b.p) OR contains(b.p, a.p)), false) AS hit FROM a LEFT JOIN b ON a.day = b.day AND b.us <= a.us)
SELECT event_id, coalesce(arg_max(forecast_id, (us, forecast_id)) FILTER (hit), arg_max(forecast_id, (us, forecast_id))) AS forecast_id, CASE WHEN count(forecast_id) > 0 THEN bool_or(hit) END AS place_matched FROM j GROUP BY 1""")
def weather_by_place(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", core.micros(F.col("ts"))).withColumn("day", F.to_date("ts"))
    origins = e.where("event_type = 'view'").select("event_id", "at", "day", F.expr(OURS).alias("place"))
    forecasts = e.where("event_type = 'click'").select(F.col("event_id").alias("forecast_id"), F.col("at").alias("retrieved"), "day", F.expr(THEIRS).alias("place"))
    return stations.forecast_by_place(origins, forecasts, ["forecast_id"]).select("event_id", "forecast_id", "place_matched")


@_query("""WITH s AS (SELECT c_custkey AS key, 'rainfall' AS sensor_type, c_nationkey % 3 AS district FROM customer UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'rainfall' ELSE 'water_level' END, s_nationkey % 3 FROM supplier),
g AS (SELECT key, count(*) AS sensors, count(DISTINCT sensor_type) AS kinds, string_agg(DISTINCT sensor_type, '+' ORDER BY sensor_type) AS types, min(district) AS lo, max(district) AS hi FROM s GROUP BY 1),
p AS (SELECT p_partkey AS key, p_size::DOUBLE AS lon, p_retailprice::DOUBLE AS lat, CASE WHEN p_partkey % 2 = 0 THEN p_size % 3 END AS district FROM part WHERE p_partkey % 7 <> 0),
r AS (SELECT g.*, p.lon, p.lat, CASE WHEN lo <> hi OR coalesce(district <> lo, false) THEN 'EVIDENCE_DIFFERS' WHEN p.key IS NULL THEN 'NO_COORDINATES' WHEN kinds < sensors THEN 'REPEATED_TYPE' ELSE 'MERGED' END AS status FROM g LEFT JOIN p USING (key))
SELECT key, types, sensors, status, CASE WHEN status = 'MERGED' THEN lon END AS lon, CASE WHEN status = 'MERGED' THEN lat END AS lat FROM r""")
def station_master(spark, sf_dir):
    kind = F.when(F.col("s_suppkey") % 5 == 0, "rainfall").otherwise("water_level")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("rainfall").alias("sensor_type"), (F.col("c_nationkey") % 3).alias("district"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), kind.alias("sensor_type"), (F.col("s_nationkey") % 3).alias("district"))
    p = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0")
    places = p.select(F.col("p_partkey").alias("key"), F.col("p_size").alias("lon"), F.col("p_retailprice").alias("lat"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") % 3).alias("district"))
    return stations.station_master(c.unionByName(s), places, ["district"])


@_query("""SELECT event_id, CASE WHEN event_type = 'view' AND k IN ('rain_1h', 'rain_24h') THEN 'mm' WHEN event_type = 'view' AND k = 'note' THEN 'EXCLUDED' WHEN event_type = 'click' AND k = 'level' THEN 'm' ELSE 'NO_POLICY' END AS unit
FROM (SELECT event_id, event_type, CASE event_id % 5 WHEN 0 THEN 'rain_1h' WHEN 1 THEN 'rain_24h' WHEN 2 THEN 'note' WHEN 3 THEN 'level' ELSE 'levels' END AS k FROM events)""")
def unit_policies(spark, sf_dir):
    k = F.col("event_id") % 5
    field = F.when(k == 0, "rain_1h").when(k == 1, "rain_24h").when(k == 2, "note").when(k == 3, "level").otherwise("levels")
    policies = [("view", r"rain_\d+h", "mm"), ("view", "note", None), ("click", "level", "m")]
    return table(spark, sf_dir, "events").select("event_id", stations.unit_policy(F.col("event_type"), field, policies).alias("unit"))


@_query(f", c AS (SELECT sensor, t // {1440 * US} AS day FROM obs WHERE usable GROUP BY 1, 2 HAVING count(*) >= 20) SELECT day, count(DISTINCT sensor) AS sensors, count(DISTINCT sensor) = (SELECT count(DISTINCT sensor) FROM c) AS shared FROM c GROUP BY 1")
def shared_days(spark, sf_dir):
    return stations.shared_days(statistics.covered_days(observations(spark, sf_dir), F.floor(F.col("t") / (1440 * US)), 24))


SLOTS = " ".join(f"JOIN w x{k} ON x{k}.sensor = a.sensor AND x{k}.t = a.t {'-' if k < 3 else '+'} {(k if k < 3 else k - 2) * HOUR * US}" for k in range(1, 5))


@_query(f", w AS (SELECT sensor, t, value FROM obs WHERE usable) SELECT a.sensor, a.t AS origin_us, a.value AS newest, x1.value AS middle, x2.value AS oldest, x4.value AS target FROM w a {SLOTS}")
def sequence_windows(spark, sf_dir):
    s = stations.sequences(observations(spark, sf_dir), 3, HOUR, 2 * HOUR)
    return s.select("sensor", "origin_us", *[F.col("inputs")[k].alias(n) for k, n in enumerate(("newest", "middle", "oldest"))], "target")


@_query("""SELECT c_custkey, CASE WHEN blockers = '' THEN 'PROMOTE' ELSE 'BLOCKED' END AS verdict, blockers FROM (SELECT c_custkey, concat_ws(',', CASE WHEN NOT c_acctbal > 0 THEN 'balance' END, CASE WHEN NOT c_nationkey < 20 THEN 'nation' END, CASE WHEN NOT c_mktsegment <> 'MACHINERY' THEN 'segment' END) AS blockers FROM customer)""")
def promotion_gate(spark, sf_dir):
    verdict, blockers = stations.promotion({"balance": F.col("c_acctbal") > 0, "nation": F.col("c_nationkey") < 20, "segment": F.col("c_mktsegment") != "MACHINERY"})
    return table(spark, sf_dir, "customer").select("c_custkey", verdict.alias("verdict"), blockers.alias("blockers"))
