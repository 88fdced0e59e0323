"""Queries of whole feature rows, cumulative series and analysis documents over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.operators import counters, documents, features
from hydrolith.plans.catalog import HOUR, US, _lag, _level_sql, _over, _query, _roll_sql, observations, table

ROLL, ANTE, LAGS, LEVELS, OFFSET = (180, 360), (720, 1440), (0, 60, 360), (180, 720), 480


def _ante_sql(m: int) -> str:
    gate = f"round(count(v) {_over(m)} / {m // HOUR}.0, 6) >= 0.8 AND count(v) {_over(m)} > 0"
    return f"""CASE WHEN {gate} THEN round(sum(v) {_over(m)}, 6) END AS rf_antecedent_{m}m_sum, round(count(v) {_over(m)}::DOUBLE / {m // HOUR}.0::DOUBLE, 6) AS rf_antecedent_{m}m_coverage,
      CASE WHEN {gate} THEN count(CASE WHEN v > 50 THEN 1 END) {_over(m)} END AS rf_antecedent_{m}m_wet_count"""


_PARTS = [*map(_roll_sql, ROLL), *map(_ante_sql, ANTE), *[f"round({_lag(m)}, 6) AS rf_lag_{m}m" for m in LAGS], *map(_level_sql, LEVELS), "max(CASE WHEN v > 50 THEN t END) OVER (PARTITION BY sensor ORDER BY t ROWS UNBOUNDED PRECEDING) AS wet_t"]
_D = f"make_timestamp(t + {OFFSET * US})"


@_query(f""", f AS (SELECT sensor, t, value, usable, {', '.join(_PARTS)} FROM u)
SELECT f.* EXCLUDE (usable, wet_t), (t - wet_t) / {US}.0::DOUBLE AS rf_minutes_since_last_wet, r_name AS region, hour({_D}) AS time_hour, minute({_D}) AS time_minute, isodow({_D}) - 1 AS time_weekday, month({_D}) AS time_month, (isodow({_D}) >= 6)::INT AS time_is_weekend,
  round(sin(2 * pi() * hour({_D}) / 24), 6) + 0.0 AS time_hour_sin, round(cos(2 * pi() * hour({_D}) / 24), 6) + 0.0 AS time_hour_cos, round(sin(2 * pi() * (month({_D}) - 1) / 12), 6) + 0.0 AS time_month_sin, round(cos(2 * pi() * (month({_D}) - 1) / 12), 6) + 0.0 AS time_month_cos,
  round(sin(2 * pi() * (isodow({_D}) - 1) / 7), 6) + 0.0 AS time_weekday_sin, round(cos(2 * pi() * (isodow({_D}) - 1) / 7), 6) + 0.0 AS time_weekday_cos
FROM f LEFT JOIN region ON r_regionkey = length(sensor) % 5 WHERE usable""")
def feature_rows(spark, sf_dir):
    o = observations(spark, sf_dir)
    sensors = table(spark, sf_dir, "events").select(F.col("event_type").alias("sensor")).distinct()
    region = table(spark, sf_dir, "region")
    metadata = sensors.join(region, F.length("sensor") % 5 == region["r_regionkey"], "left").select("sensor", F.col("r_name").alias("region"))
    return features.feature_rows(o, ROLL, ANTE, LAGS, LEVELS, HOUR, wet=50.0, offset_minutes=OFFSET, metadata=metadata)


def counted(spark, sf_dir):
    """Hourly series: two sensors as totals that start again every 50 hours, the others as they are."""
    hour = F.col("t") / (HOUR * US)
    total = (hour % 50 * 10 + F.col("user_id") % 10).cast("double")
    return observations(spark, sf_dir).withColumn("value", F.when(F.col("sensor").isin("view", "click"), total).otherwise(F.col("value")))


_COUNTED = f""", ct AS (SELECT sensor, t, CASE WHEN sensor IN ('view', 'click') THEN (t // {HOUR * US}) % 50 * 10 + user_id % 10 ELSE value END::DOUBLE AS value FROM obs WHERE usable AND value IS NOT NULL),
st AS (SELECT *, lag(t) OVER o AS p, lag(value) OVER o AS pv FROM ct WINDOW o AS (PARTITION BY sensor ORDER BY t))
"""


@_query(_COUNTED + f""", g AS (SELECT sensor, count(*) AS steps, count(*) FILTER (value < pv) AS falls, count(*) FILTER (value < pv AND value <= 0.1::DOUBLE * pv) AS restarts FROM st WHERE t - p = {HOUR * US} GROUP BY 1)
SELECT *, round(100.0::DOUBLE * (steps - falls) / steps, 2) AS rising_pct, CASE WHEN steps < 24 THEN 'UNDETERMINED' WHEN round(100.0::DOUBLE * (steps - falls) / steps, 2) >= 95 AND 100 * restarts >= 80 * falls THEN 'ACCUMULATED' ELSE 'INTERVAL' END AS verdict FROM g""")
def counter_semantics(spark, sf_dir):
    return counters.semantics(counted(spark, sf_dir), HOUR)


@_query(_COUNTED + f""", ic AS (SELECT *, round(CASE WHEN p IS NOT NULL THEN CASE WHEN value < pv THEN value ELSE value - pv END END, 6) AS increment FROM st)
SELECT sensor, t, value, increment, coalesce(value < pv, false) AS restarted, coalesce(t - p = {HOUR * US}, false) AS regular, round(sum(increment) OVER (PARTITION BY sensor ORDER BY t ROWS UNBOUNDED PRECEDING), 6) AS total FROM ic""")
def counter_increments(spark, sf_dir):
    return counters.increments(counted(spark, sf_dir), HOUR)


@_query(f""", h AS (SELECT sensor, t, CASE WHEN user_id % 7 = 0 THEN 4 WHEN user_id % 31 <> 1 THEN 3 END::DOUBLE AS raw, CASE WHEN user_id % 5 = 0 THEN 3 ELSE 9 END::DOUBLE AS clean, 3.0::DOUBLE * ((t // {HOUR * US} - 1) % 24 + 1) AS daily, 3.0::DOUBLE * (t // {HOUR * US}) AS yearly FROM obs),
w AS (SELECT *, lag(t) OVER o AS p, lag(t, 2) OVER o AS pp, lag(raw) OVER o AS r1, lag(raw, 2) OVER o AS r2, lag(daily) OVER o AS d1, lag(yearly) OVER o AS y1 FROM h WINDOW o AS (PARTITION BY sensor ORDER BY t)),
c AS (SELECT sensor, abs(yearly - y1 - raw) < 1e-6 AS a, CASE WHEN raw IS NOT NULL THEN abs(yearly - y1 - clean) < 1e-6 END AS b, CASE WHEN t % {1440 * US} <> {HOUR * US} THEN abs(daily - d1 - raw) < 1e-6 END AS d, CASE WHEN p - pp = {HOUR * US} THEN abs(raw + r1 + r2 - clean) < 1e-6 END AS e FROM w WHERE t - p = {HOUR * US})
SELECT sensor, name, count(*) FILTER (ok) AS matches, count(ok) AS checked FROM (SELECT sensor, 'raw_eq_yearly_step' AS name, a AS ok FROM c UNION ALL SELECT sensor, 'clean_eq_yearly_step', b FROM c UNION ALL SELECT sensor, 'daily_eq_previous_plus_raw', d FROM c UNION ALL SELECT sensor, 'clean_eq_raw_sum', e FROM c) GROUP BY 1, 2""")
def rainfall_consistency(spark, sf_dir):
    hour, user = F.floor(F.col("t") / (HOUR * US)), F.col("user_id")
    rows = observations(spark, sf_dir).select(
        "sensor", "t", F.when(user % 7 == 0, 4.0).when(user % 31 != 1, 3.0).alias("raw"), F.when(user % 5 == 0, 3.0).otherwise(9.0).alias("clean"), (3.0 * ((hour - 1) % 24 + 1)).alias("daily"), (3.0 * hour).alias("yearly"),
    )
    return counters.consistency(rows, HOUR)


def typed(spark, sf_dir):
    return observations(spark, sf_dir).withColumn("measurement_type", F.when(F.col("sensor").isin("view", "click"), "RAINFALL_INTERVAL").otherwise("WATER_LEVEL"))


_LEVELS = f""", ty AS (SELECT sensor, CASE WHEN sensor IN ('view', 'click') THEN 'RAINFALL_INTERVAL' ELSE 'WATER_LEVEL' END AS measurement_type, t, v::DECIMAL(28, 6) AS dv, v, (t - {HOUR * US}) // {1440 * US} AS day FROM u),
dy AS (SELECT measurement_type, sensor, day, (count(v) >= 20)::INT AS cov FROM ty GROUP BY ALL),
cv AS (SELECT measurement_type, sensor, sum(cov)::BIGINT AS covered_days, grouping_id(measurement_type, sensor) AS g FROM dy GROUP BY GROUPING SETS ((measurement_type, sensor), (measurement_type), ())),
lv AS (SELECT measurement_type, sensor, grouping_id(measurement_type, sensor) AS g, count(*) AS "rows", count(v) AS usable, count(*) FILTER (v = 0) AS zero, count(*) FILTER (v > 50) AS wet, coalesce(sum(dv)::DOUBLE, 0) AS total, stddev_samp(v) AS sd, min(v) AS least, max(v) AS most, min(t) AS first_us, max(t) AS last_us
  FROM ty GROUP BY GROUPING SETS ((measurement_type, sensor), (measurement_type), ())),
su AS (SELECT CASE lv.g WHEN 0 THEN 'SENSOR' WHEN 1 THEN 'TYPE' ELSE 'NETWORK' END AS level, lv.measurement_type, lv.sensor, "rows", usable, "rows" - usable AS missing, round(100.0::DOUBLE * usable / "rows", 2) AS usable_pct, zero, wet, round(total, 6) AS total, CASE WHEN usable > 0 THEN round(total / usable, 6) END AS mean,
  round(sd, 4) AS std, round(least, 6) AS least, round(most, 6) AS most, first_us, last_us, covered_days FROM lv JOIN cv ON lv.g = cv.g AND lv.measurement_type IS NOT DISTINCT FROM cv.measurement_type AND lv.sensor IS NOT DISTINCT FROM cv.sensor)
"""


@_query(_LEVELS + "SELECT * FROM su")
def analysis_levels(spark, sf_dir):
    return documents.level_summaries(typed(spark, sf_dir), HOUR, 24, wet=50.0)


@_query(_LEVELS + """SELECT s.measurement_type, (SELECT count(*) FROM su x WHERE x.level = 'SENSOR' AND x.measurement_type = s.measurement_type) AS stations_analysed, s.sensor, s."rows", s.usable, s.total, s.covered_days, y."rows" AS type_rows, n."rows" AS network_rows
FROM su s JOIN su y ON y.level = 'TYPE' AND y.measurement_type = s.measurement_type JOIN su n ON n.level = 'NETWORK' WHERE s.level = 'SENSOR'""")
def analysis_document(spark, sf_dir):
    """The documents, read back: a row for each sensor that stands in one."""
    made = documents.analysis_documents(analysis_levels(spark, sf_dir), "v1", {"wet_interval": "usable value > 50"})
    entry = "sensor string, `rows` bigint, usable bigint, total double, covered_days bigint"
    read = F.from_json("document", f"measurement_type string, stations_analysed bigint, stations array<struct<{entry}>>, summary struct<`rows` bigint>, network struct<`rows` bigint>")
    d = made.select(read.alias("d")).select("d.measurement_type", "d.stations_analysed", F.explode("d.stations").alias("s"), F.col("d.summary.rows").alias("type_rows"), F.col("d.network.rows").alias("network_rows"))
    return d.select("measurement_type", "stations_analysed", "s.*", "type_rows", "network_rows")
