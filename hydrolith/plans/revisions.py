"""Queries of revised observations over the driver's tables, and their SQL: two time axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import core
from hydrolith.operators import bitemporal
from hydrolith.plans.catalog import HOUR, LIMIT, US, _query, table

KNOWN_WINDOWS, KNOWN_LAGS = (180, 720), (60, 360)


def revised(spark, sf_dir):
    """Every event revises its hour's slot: known hours after it, by its id, so that some come late and out of order."""
    e = table(spark, sf_dir, "events").withColumn("us", core.micros(F.col("ts")))
    t = core.floor_to(F.col("us"), HOUR)
    late = F.when(F.col("event_id") % 9 == 0, 30).otherwise(F.col("event_id") % 4) * F.lit(HOUR * US)
    return e.select(F.col("event_type").alias("sensor"), t.alias("t"), (F.col("us") + late).alias("known"), "event_id", "value", (F.col("value") <= LIMIT).alias("usable"))


def asking(spark, sf_dir):
    """Each slot asks two hours after its hour, and every fifth once more after three days."""
    slots = revised(spark, sf_dir).select("sensor", "t").distinct()
    again = F.when(F.col("t") / (HOUR * US) % 5 == 0, F.array(F.lit(2), F.lit(72))).otherwise(F.array(F.lit(2)))
    return slots.select("sensor", "t", F.explode(again).alias("h")).select("sensor", "t", (F.col("t") + F.col("h") * F.lit(HOUR * US)).alias("asked"))


_REV = f"""WITH rev AS (SELECT event_type AS sensor, epoch_us(date_trunc('hour', ts)) AS t, epoch_us(ts) + (CASE WHEN event_id % 9 = 0 THEN 30 ELSE event_id % 4 END) * {HOUR * US} AS known, event_id, value, value <= {LIMIT} AS usable FROM events),
ask AS (SELECT sensor, t, t + unnest(CASE WHEN (t // {HOUR * US}) % 5 = 0 THEN [2, 72] ELSE [2] END) * {HOUR * US} AS asked FROM (SELECT DISTINCT sensor, t FROM rev)),
seen AS MATERIALIZED (SELECT a.sensor, a.t, a.asked, r.t AS rt, arg_max(CASE WHEN r.usable THEN r.value END, (r.known, r.event_id)) FILTER (r.usable) AS any_good, max((r.known, r.event_id)) AS stood, max((r.known, r.event_id)) FILTER (r.usable) AS good,
  count(*) AS heard FROM ask a JOIN rev r ON r.sensor = a.sensor AND r.t > a.t - {max(KNOWN_WINDOWS) * US} AND r.t <= a.t AND r.known <= a.asked GROUP BY 1, 2, 3, 4),
st AS (SELECT *, CASE WHEN stood = good THEN any_good END AS v, heard > 1 AS later FROM seen)
"""


def _known_sql(m: int) -> str:
    here = f"rt > t - {m * US}"
    gate = f"round(count(v) FILTER ({here}) / {m // HOUR}.0, 6) >= 0.8"
    return f"""CASE WHEN {gate} THEN round(sum(v) FILTER ({here}), 6) END AS known_{m}m_sum, CASE WHEN {gate} THEN round(max(v) FILTER ({here}), 6) END AS known_{m}m_max,
  CASE WHEN {gate} THEN count(v) FILTER ({here} AND v > 50) END AS known_{m}m_wet_count, round(count(v) FILTER ({here})::DOUBLE / {m // HOUR}.0::DOUBLE, 6) AS known_{m}m_coverage"""


@_query(_REV + f"""SELECT a.sensor, a.t, a.asked, round(max(v) FILTER (rt = a.t), 6) AS known_value, {', '.join(f'round(max(v) FILTER (rt = a.t - {m * US}), 6) AS known_lag_{m}m' for m in KNOWN_LAGS)},
  {', '.join(_known_sql(m).replace('rt > t', 'rt > a.t') for m in KNOWN_WINDOWS)}, count(*) FILTER (later) AS revised FROM ask a LEFT JOIN st s ON s.sensor = a.sensor AND s.t = a.t AND s.asked = a.asked GROUP BY 1, 2, 3""")
def features_as_known(spark, sf_dir):
    return bitemporal.as_known(asking(spark, sf_dir), revised(spark, sf_dir), KNOWN_WINDOWS, KNOWN_LAGS, HOUR, wet=50.0, tie="event_id")


@_query(_REV + """SELECT a.sensor, a.t, a.asked, arg_max(r.t, (r.t, r.known, r.event_id)) AS read_t, arg_max(r.event_id, (r.t, r.known, r.event_id)) AS read_event, round(arg_max(r.value, (r.t, r.known, r.event_id)), 6) AS read_value
FROM ask a LEFT JOIN rev r ON r.sensor = a.sensor AND r.known <= a.asked GROUP BY 1, 2, 3""")
def latest_as_known(spark, sf_dir):
    rows = revised(spark, sf_dir).withColumn("read_t", F.col("t"))
    got = bitemporal.latest_known(asking(spark, sf_dir), rows, ["sensor"], ["event_id", "read_t", "value"], block_minutes=1440)
    return got.select("sensor", "t", "asked", "read_t", F.col("event_id").alias("read_event"), core.round6(F.col("value")).alias("read_value"))
