"""Queries of the serving, validation and modelling operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import core
from hydrolith.operators import islands, joins, models, serving, validation, windows
from hydrolith.plans.catalog import EPISODES, GRID, HOUR, SPLIT, US, WINDOWS, _query, _roll_sql, cuts, observations, table
from hydrolith.streaming import live

STEPS = ", st AS (SELECT *, lag(t) OVER (PARTITION BY sensor ORDER BY t) AS p FROM obs), su AS (SELECT sensor, t, lag(t) OVER (PARTITION BY sensor ORDER BY t) AS p FROM obs WHERE usable)\n"
ANTECEDENT = (360, 720, 1440)


@_query(f"SELECT * EXCLUDE (usable) FROM (SELECT sensor, t, value, usable, {', '.join(_roll_sql(m).replace('rf_roll', 'rf_ante') for m in ANTECEDENT)} FROM u) WHERE usable")
def rf_antecedent(spark, sf_dir):
    return windows.rolling(observations(spark, sf_dir), ANTECEDENT, HOUR, wet=50.0, prefix="rf_ante").drop("usable", "user_id")


@_query(STEPS + f"SELECT o.*, g.largest_gap_minutes FROM (SELECT sensor, count(*) AS observations, count(*) FILTER (usable) AS usable, min(t) AS first_us, max(t) AS last_us FROM obs GROUP BY 1) o LEFT JOIN (SELECT sensor, max(t - p) / {US}.0::DOUBLE AS largest_gap_minutes FROM su GROUP BY 1) g USING (sensor)")
def series_summary(spark, sf_dir):
    return serving.series_summary(observations(spark, sf_dir))


@_query(STEPS + f"""SELECT sensor, arg_max(step, (n, -step)) AS dominant_minutes, round(100.0::DOUBLE * (sum(n) - max(n)) / sum(n), 2) AS irregular_pct, max(step) AS largest_minutes, sum(CASE WHEN step = 0 THEN n ELSE 0 END)::BIGINT AS duplicates
FROM (SELECT sensor, (t - p) / {US}.0::DOUBLE AS step, count(*) AS n FROM st WHERE p IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def cadence_summary(spark, sf_dir):
    return serving.cadence_summary(observations(spark, sf_dir))


@_query(STEPS + f"SELECT sensor, t, CASE WHEN usable THEN value END AS value, false AS is_break FROM st UNION ALL SELECT sensor, p + {HOUR * US}, NULL, true FROM st WHERE t - p > {2 * HOUR * US}")
def chart_series(spark, sf_dir):
    return serving.chart_rows(observations(spark, sf_dir), HOUR)


@_query(f"SELECT event_id, event_type, epoch_us(ts) AS t, value FROM events WHERE event_type = 'view' AND epoch_us(ts) BETWEEN {SPLIT[0]} AND {SPLIT[1]}")
def series_range(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "event_type", core.micros(F.col("ts")).alias("t"), "value")
    return serving.in_range(e, "t", *SPLIT)


@_query("SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5 OFFSET 5")
def pagination(spark, sf_dir):
    return serving.page(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), [F.desc("s_acctbal"), F.asc("s_suppkey")], 1, 5)


@_query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 900 AND 1200")
def bbox_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(joins.in_box(F.col("p_size"), F.col("p_retailprice"), 10, 900, 20, 1200)).select("p_partkey")


@_query("SELECT user_id, CASE max(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 ELSE 0 END) WHEN 1 THEN 'click' WHEN 2 THEN 'view' WHEN 3 THEN 'error' ELSE max(event_type) END AS event_type FROM events GROUP BY 1")
def worst_state(spark, sf_dir):
    return serving.worst_state(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["click", "view", "error"])


@_query("SELECT p_partkey, CASE WHEN l IS NULL THEN 'missing' WHEN l < m AND m < h THEN 'ok' ELSE 'not_ascending' END AS status FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size END AS l, p_partkey % 50 AS m, 40 AS h FROM part)")
def threshold_order(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", serving.threshold_order(F.when(size % 7 != 0, size), F.col("p_partkey") % 50, F.lit(40)).alias("status"))


@_query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@_query(f"""WITH x AS (SELECT event_id, epoch_us(ts) AS us, CASE event_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'soon' WHEN 2 THEN strftime(ts, '%d/%m/%Y %H:%M') WHEN 3 THEN '2030-01-01 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw FROM events),
y AS (SELECT *, epoch_us(CASE WHEN raw LIKE '__/__/____ __:__' THEN strptime(raw, '%d/%m/%Y %H:%M') WHEN raw LIKE '____-__-__ __:__:__' THEN strptime(raw, '%Y-%m-%d %H:%M:%S') END) - {480 * US} AS at_us FROM x)
SELECT event_id, CASE WHEN trim(raw) = '' THEN 'MISSING' WHEN at_us IS NULL THEN 'INVALID_FORMAT' WHEN at_us > us + {10 * US} THEN 'FUTURE' ELSE 'VALID' END AS status, at_us FROM y""")
def timestamp_status(spark, sf_dir):
    k, ts = F.col("event_id") % 7, F.col("ts")
    raw = F.when(k == 0, " ").when(k == 1, "soon").when(k == 2, F.date_format(ts, "dd/MM/yyyy HH:mm")).when(k == 3, "2030-01-01 00:00:00").otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    status, us = validation.timestamp_status(raw, ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm"), 480, core.micros(ts))
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), us.alias("at_us"))


@_query("""WITH m AS (SELECT s_suppkey::VARCHAR AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'rainfall' ELSE 'water_level' END AS sensor_type, s_name AS sensor_id FROM supplier),
r AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 11 = 1 THEN '1 2' WHEN c_custkey % 11 = 2 THEN NULL ELSE ' ' || c_custkey || ' ' END AS source_id, CASE WHEN c_custkey % 4 = 0 THEN 'wind' WHEN c_custkey % 2 = 0 THEN 'rainfall' ELSE 'water_level' END AS sensor_type FROM customer),
k AS (SELECT *, CASE WHEN trim(source_id) <> '' AND trim(source_id) NOT LIKE '% %' THEN trim(source_id) END AS key FROM r)
SELECT c_custkey, CASE WHEN k.key IS NULL THEN 'INVALID_SOURCE_ID' WHEN k.sensor_type = 'wind' THEN 'INVALID_SENSOR_TYPE' WHEN m.key IS NOT NULL THEN 'MAPPED' WHEN k.key IN (SELECT key FROM m) THEN 'SENSOR_TYPE_MISMATCH' ELSE 'UNMAPPED' END AS mapping_status, m.sensor_id FROM k LEFT JOIN m ON k.key = m.key AND k.sensor_type = m.sensor_type""")
def station_mapping(spark, sf_dir):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    mapping = table(spark, sf_dir, "supplier").select(s.cast("string").alias("key"), F.when(s % 3 == 0, "rainfall").otherwise("water_level").alias("sensor_type"), F.col("s_name").alias("sensor_id"))
    source = F.when(c % 11 == 0, " ").when(c % 11 == 1, "1 2").when(c % 11 != 2, F.format_string(" %d ", c))
    rows = table(spark, sf_dir, "customer").select("c_custkey", source.alias("source_id"), F.when(c % 4 == 0, "wind").when(c % 2 == 0, "rainfall").otherwise("water_level").alias("sensor_type"))
    return validation.map_stations(rows, mapping).select("c_custkey", "mapping_status", "sensor_id")


@_query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'NOT_A_STATION_OBSERVATION' WHEN value > 400 THEN 'UNIT_NOT_VALID' WHEN user_id % 10 = 0 THEN 'NO_CANONICAL_SENSOR' WHEN hour(ts) = 0 THEN 'NO_VALID_OBSERVATION_TIME' END AS reason FROM events) GROUP BY 1")
def exclusion_counts(spark, sf_dir):
    reason = validation.exclusion(F.col("event_type") != "error", F.col("value") <= 400, F.col("user_id") % 10 != 0, F.hour("ts") != 0)
    return table(spark, sf_dir, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


FLAGS = ("VALUE_EMPTY", "RAINFALL_NEGATIVE", "SOURCE_SEVERITY_ERROR", "TIMEZONE_ASSUMED")


@_query("SELECT 'VALUE_EMPTY' AS flag, count(*) FILTER (value > 450) AS n FROM events UNION ALL SELECT 'RAINFALL_NEGATIVE', count(*) FILTER (value < 0) FROM events UNION ALL SELECT 'SOURCE_SEVERITY_ERROR', count(*) FILTER (event_type = 'error') FROM events UNION ALL SELECT 'TIMEZONE_ASSUMED', count(*) FROM events")
def flag_counts(spark, sf_dir):
    flags = validation.flags_of({FLAGS[0]: F.col("value") > 450, FLAGS[1]: F.col("value") < 0, FLAGS[2]: F.col("event_type") == "error", FLAGS[3]: F.lit(True)})
    return validation.flag_counts(table(spark, sf_dir, "events").select(flags.alias("flags")), "flags", FLAGS)


@_query("""SELECT name, failing = 0 AS passed, failing FROM (SELECT 'value_present' AS name, count(*) FILTER (value IS NULL) AS failing FROM events UNION ALL SELECT 'value_in_range', count(*) FILTER (value NOT BETWEEN 0 AND 400) FROM events
 UNION ALL SELECT 'id_unique', count(*) - count(DISTINCT event_id) FROM events UNION ALL SELECT 'one_row_per_user_and_type', (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) FROM events))""")
def quality_checks(spark, sf_dir):
    value = F.col("value")
    return validation.checks(table(spark, sf_dir, "events"), {"value_present": value.isNull(), "value_in_range": ~value.between(0, 400)}, {"id_unique": ["event_id"], "one_row_per_user_and_type": ["user_id", "event_type"]})


@_query("SELECT event_type, day, grouping(event_type, day)::BIGINT AS \"grouping\", count(*) AS n, count(*) FILTER (usable) AS usable FROM (SELECT event_type, dayofmonth(ts)::INT AS day, value <= 200 AS usable FROM events) GROUP BY GROUPING SETS ((event_type, day), (event_type), (day), ())")
def quality_summary_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.dayofmonth("ts").alias("day"), (F.col("value") <= 200).alias("usable"))
    return validation.summary_sets(e, [["event_type", "day"], ["event_type"], ["day"], []], ["event_type", "day"])


FEATURES = [f"rf_roll_{m}m_{k}" for m in WINDOWS for k in ("sum", "max", "coverage")]


@_query(f", f AS (SELECT * FROM (SELECT *, {', '.join(map(_roll_sql, WINDOWS))} FROM u) WHERE usable), c AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, count({n}) AS present, count(*) AS total FROM f" for n in FEATURES)}) SELECT *, CASE WHEN total > 0 THEN round(100.0::DOUBLE * present / total, 2) END AS coverage_pct FROM c")
def null_coverage(spark, sf_dir):
    return validation.null_coverage(windows.rolling(observations(spark, sf_dir), WINDOWS, HOUR, wet=50.0), FEATURES)


@_query("SELECT *, days >= 20 AS complete FROM (SELECT sensor, strftime(day, '%Y-%m') AS month, count(*) AS days, round(sum(total), 4) AS total FROM (SELECT sensor, make_timestamp(t)::DATE AS day, sum(value) AS total FROM obs WHERE usable GROUP BY 1, 2 HAVING count(*) >= 8) GROUP BY 1, 2)")
def calendar_rollup(spark, sf_dir):
    return validation.calendar_rollup(observations(spark, sf_dir), 8)


@_query(EPISODES + """, x AS (SELECT sensor, threshold_type, count(*) AS eligible, count(*) FILTER (value >= threshold) AS exceeding FROM obs, cuts WHERE usable GROUP BY 1, 2)
SELECT sensor, threshold_type, eligible, exceeding, round(100.0::DOUBLE * exceeding / eligible, 2) AS exceeding_pct, coalesce(e.episodes, 0) AS episodes, e.longest_minutes FROM x LEFT JOIN (SELECT sensor, threshold_type, count(*) AS episodes, max(duration_minutes) AS longest_minutes FROM eps GROUP BY 1, 2) e USING (sensor, threshold_type)""")
def exceedance_analysis(spark, sf_dir):
    obs, limits = observations(spark, sf_dir), cuts(spark, sf_dir)
    rows = obs.where("usable").join(limits, "sensor").groupBy("sensor", "threshold_type").agg(F.count("*").alias("eligible"), F.count_if(F.col("value") >= F.col("threshold")).alias("exceeding"))
    runs = islands.episodes(obs, limits, HOUR, 720).groupBy("sensor", "threshold_type").agg(F.count("*").alias("n"), F.max("duration_minutes").alias("longest_minutes"))
    joined = rows.join(runs, ["sensor", "threshold_type"], "left")
    return joined.select("sensor", "threshold_type", "eligible", "exceeding", core.percent_of(F.col("exceeding"), F.col("eligible")).alias("exceeding_pct"), F.coalesce("n", F.lit(0)).alias("episodes"), "longest_minutes")


@_query(GRID + "SELECT sensor, count(*) AS expected, count(*) FILTER (state = 'USABLE') AS usable, count(*) FILTER (state = 'NOT_USABLE') AS not_usable, count(*) FILTER (state = 'ABSENT_SLOT') AS absent FROM grid GROUP BY 1")
def missing_summary(spark, sf_dir):
    state = lambda s: F.count_if(F.col("state") == s)
    return islands.slot_grid(observations(spark, sf_dir), HOUR).groupBy("sensor").agg(F.count("*").alias("expected"), state("USABLE").alias("usable"), state("NOT_USABLE").alias("not_usable"), state("ABSENT_SLOT").alias("absent"))


@_query(f"""SELECT sensor, n, round(m, 6) AS mae, round(b, 6) AS baseline_mae, CASE WHEN b > 0 THEN round(1 - m / b, 4) END AS skill FROM (SELECT a.sensor, count(*) AS n, avg(abs(a.value - (b.value + c.value) / 2)) AS m, avg(abs(a.value - b.value)) AS b
 FROM obs a JOIN obs b ON a.sensor = b.sensor AND b.t = a.t - {60 * US} JOIN obs c ON a.sensor = c.sensor AND c.t = a.t - {120 * US} WHERE a.usable AND b.usable AND c.usable GROUP BY 1)""")
def persistence_skill(spark, sf_dir):
    m = joins.complete_lags(observations(spark, sf_dir), (0, 60, 120))
    at = lambda k: F.col("inputs")[k]
    return models.skill(m.select("sensor", at(0).alias("y"), ((at(1) + at(2)) / 2).alias("m"), at(1).alias("b")), ["sensor"], "y", "m", "b")


@_query("SELECT c_mktsegment AS run_id, n, total FROM (SELECT c_mktsegment, count(*) AS n, sum(c_nationkey)::BIGINT AS total FROM customer GROUP BY 1) ORDER BY n DESC, total DESC, run_id DESC LIMIT 1")
def champion_selection(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("run_id")).agg(F.count("*").alias("n"), F.sum("c_nationkey").cast("bigint").alias("total"), F.lit("v1").alias("digest"))
    return models.champion(runs, "run_id", "digest", ["n", "total"])


@_query("SELECT o_orderkey, coalesce((SELECT count(*) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority < '5') WHERE v < p) + 1, 5)::INT AS place FROM (SELECT o_orderkey, o_orderpriority AS p FROM orders)")
def one_hot(spark, sf_dir):
    o, kind = table(spark, sf_dir, "orders"), F.col("o_orderpriority")
    vocabulary = models.fit_vocabulary(o.where(kind < "5"), "o_orderpriority")
    return o.select("o_orderkey", F.array_position(models.one_hot(kind, vocabulary), 1).cast("int").alias("place"))


@_query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'INSERTED' WHEN o_orderkey % 5 = 0 THEN 'CONFLICT' ELSE 'UNCHANGED' END AS outcome FROM orders) GROUP BY 1""")
def upsert_outcomes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    new = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return joins.upsert(o.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"], ["o_custkey"]).groupBy("outcome").agg(F.count("*").alias("n"))


@_query("""SELECT n_nationkey, substr(sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}'), 1, 16) AS run_id FROM nation""")
def run_ids(spark, sf_dir):
    text = F.to_json(F.struct("n_name", "n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.substring(F.sha2(text, 256), 1, 16).alias("run_id"))


@_query(f"SELECT event_type, start_us, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([epoch_us(time_bucket(INTERVAL '2 hours', ts)) - k * {120 * US} FOR k IN [0, 1, 2]]) AS start_us FROM events) GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.windowed(e, "ts", ["event_type"], "6 hours", "2 hours").select("event_type", F.unix_micros("window_start").alias("start_us"), "n", "total")


def _examples(spark, sf_dir):
    """Rolling features of each usable hour, and whether the hour after it is over the middle threshold."""
    obs = observations(spark, sf_dir)
    future = obs.where("usable").select("sensor", (F.col("t") - HOUR * US).alias("t"), (F.col("value") >= 90).cast("int").alias("label"))
    return windows.rolling(obs, WINDOWS, HOUR, least=0.0, wet=50.0).join(future, ["sensor", "t"]).select("sensor", "t", "label", *FEATURES)


def _scored(spark, sf_dir, kind):
    rows = _examples(spark, sf_dir)
    model = models.fit_classifier(rows.where(F.col("t") <= SPLIT[0]), FEATURES, "label", kind)
    return models.score(model, rows, FEATURES).select("sensor", "t", "label", "score")


@_query()
def ml_logistic(spark, sf_dir):
    return _scored(spark, sf_dir, "logistic")


@_query()
def ml_forest(spark, sf_dir):
    return _scored(spark, sf_dir, "forest")


@_query()
def ml_boosted(spark, sf_dir):
    return _scored(spark, sf_dir, "boosted")


@_query()
def calibration(spark, sf_dir):
    rows = _scored(spark, sf_dir, "logistic")
    model = models.fit_calibration(rows.where(F.col("t") <= SPLIT[1]), "score", "label")
    return models.calibrated(model, rows, "score")


@_query("""WITH d AS (SELECT o_orderstatus AS sensor, o_orderdate::DATE AS day, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2), m AS (SELECT sensor, year(day) AS year, month(day) AS month, count(*) AS days, round(sum(total), 4) AS total FROM d GROUP BY 1, 2, 3 HAVING count(*) >= 20)
SELECT sensor, year::INT AS year, count(*) AS months, sum(days)::BIGINT AS days, round(sum(total), 4) AS total, count(*) >= 12 AS complete FROM m GROUP BY 1, 2""")
def calendar_years(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderstatus").alias("sensor"), core.micros(F.col("o_orderdate")).alias("t"), F.col("o_totalprice").alias("value"), F.lit(True).alias("usable"))
    return validation.calendar_years(validation.calendar_rollup(rows, 1))
