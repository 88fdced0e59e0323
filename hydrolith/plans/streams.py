"""Queries that run streams over the driver's tables to their end, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import core
from hydrolith.plans.catalog import HOUR, US, _query, table
from hydrolith.session import shared_folder
from hydrolith.sources import readers
from hydrolith.sources.store import PollStore
from hydrolith.streaming import live, state

SILENT, DELAY = 30, 10


@_query(f"""WITH e AS (SELECT event_type AS sensor, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n, lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS p, lead(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS x FROM events),
mark AS (SELECT max(t) - {DELAY * US} AS w FROM e)
SELECT sensor, 'ACTIVE' AS state, t AS at_us, t AS last_us, n AS "rows" FROM e WHERE p IS NULL OR t - p > {SILENT * US}
UNION ALL SELECT sensor, 'STALE', t + {SILENT * US}, t, n FROM e, mark WHERE x - t > {SILENT * US} OR (x IS NULL AND t + {SILENT * US} < w)""")
def silence_transitions(spark, sf_dir):
    # a pattern, since a stream's plain path must be a folder and the table may be one file
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    readings = rows.select(F.col("event_type").alias("sensor"), F.col("ts").cast("timestamp").alias("time"), F.lit(None).cast("timestamp").alias("retrieved"), "value")
    folder = shared_folder(spark, "silence")
    got = live.drain(state.sensor_transitions(readings, SILENT, f"{DELAY} minutes"), f"{folder}/rows", f"{folder}/checkpoint")
    return got.select("sensor", "state", core.micros(F.col("at")).alias("at_us"), core.micros(F.col("last_seen")).alias("last_us"), "rows")


@_query(f"""SELECT event_type AS sensor, epoch_us(date_trunc('hour', ts)) AS t, arg_max(value, (user_id % 3, value, event_id)) AS value, arg_max(event_id, (user_id % 3, value, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def polled_rows(spark, sf_dir):
    """What stands in a store after three polls, each of which revises rows of those before it."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("sensor"), core.floor_to(core.micros(F.col("ts")), HOUR).alias("t"), "value", "event_id", (F.col("user_id") % 3).alias("poll"))
    store = PollStore(spark, shared_folder(spark, "polls"), ["sensor", "t"], "t", ["value", "event_id"], buckets=4)
    for poll in range(3):
        store.merge(rows.where(F.col("poll") == poll).drop("poll"), poll)
    return store.read(rows.drop("poll").schema)


@_query(f"""WITH h AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'rainfall' WHEN event_type = 'click' THEN 'wind' ELSE 'water_level' END AS st, CASE WHEN event_id % 7 <> 0 THEN CASE event_id % 5 WHEN 0 THEN '-9999' WHEN 1 THEN ' x ' ELSE (event_id % 100)::VARCHAR END END AS v, CASE WHEN event_id % 11 = 0 THEN 'soon' ELSE strftime(ts, '%d/%m/%Y %H:%M') END AS tm, epoch_us(date_trunc('minute', ts)) AS us, epoch_us(ts) + (event_id % 300 - 20) * {US} AS ret FROM events),
e AS (SELECT *, CASE WHEN st = 'wind' THEN 'UNKNOWN_SENSOR_TYPE' WHEN event_id % 7 = 0 THEN 'MISSING_VALUE_FIELD' WHEN event_id % 13 = 0 THEN 'MISSING_TIME_FIELD' END AS structural_error, CASE WHEN event_id % 13 <> 0 THEN tm END AS tr FROM h),
a AS (SELECT *, CASE WHEN tr <> 'soon' THEN floor((ret - us) / {US}.0)::BIGINT END AS age, CASE WHEN st <> 'wind' THEN v END AS vr FROM e)
SELECT event_id, CASE st WHEN 'rainfall' THEN 'raw' WHEN 'water_level' THEN 'final' END AS value_field, vr AS value_raw, tr AS time_raw, structural_error, age AS age_minutes, CASE WHEN age IS NULL OR age < -5 THEN 'INVALID' WHEN vr IS NULL OR trim(vr) IN ('-9999', 'x') THEN 'NO_DATA' WHEN age <= 30 THEN 'FRESH' WHEN age <= 180 THEN 'DELAYED' ELSE 'STALE' END AS live_status FROM a""")
def history_listing(spark, sf_dir):
    """Station histories of events, read by their sensor type, with how fresh each value was when it was retrieved."""
    n, ts = F.col("event_id"), F.col("ts")
    value = F.when(n % 5 == 0, "-9999").when(n % 5 == 1, " x ").otherwise((n % 100).cast("string"))
    time = F.when(n % 11 == 0, "soon").otherwise(F.date_format(ts, "dd/MM/yyyy HH:mm"))
    kind = F.when(F.col("event_type") == "view", "rainfall").when(F.col("event_type") == "click", "wind").otherwise("water_level")
    field = F.when(kind == "rainfall", "raw").otherwise("final")
    entry = F.map_filter(F.create_map(field, value, F.lit("dt"), time), lambda k, _: ~((k == "dt") & (n % 13 == 0)) & ~((k != "dt") & (n % 7 == 0)))
    body = F.to_json(F.struct(F.create_map(F.lit("name"), F.lit("x")).alias("info"), F.array(entry).alias("values")))
    payloads = table(spark, sf_dir, "events").select("event_id", kind.alias("sensor_type"), (core.micros(ts) + (n % 300 - 20) * F.lit(US)).alias("ret"), body.alias("body"))
    got = readers.listed_observations(readers.history_values(readers.history_rows(payloads)), "dd/MM/yyyy HH:mm", F.col("ret"))
    return got.select("event_id", "value_field", "value_raw", "time_raw", "structural_error", "age_minutes", "live_status")
