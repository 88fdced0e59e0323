"""Queries of the time-series operators over the driver's tables, and their SQL.

Events stand for observations: the sensor is the event type, the slot the hour, the value that of the slot's first event;
a value over 200 is unusable. Instants are microseconds since 1970.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolith.functions import core
from hydrolith.operators import canonical, islands, joins, labels, models, statistics, windows
from hydrolith.sources import readers
from hydrolith.streaming import live

HOUR = 60
LIMIT = 200.0
WINDOWS = (180, 360, 720)
CUTS = [("LOW", 60.0), ("MID", 90.0), ("HIGH", 120.0)]
SPLIT = (1_705_363_200_000_000, 1_705_968_000_000_000)

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "feature_table"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = BASE + sql if re.search(r"\b(obs|u|cuts)\b", sql) else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sensor, t, value, usable, user_id): first event of each type and hour."""
    e = table(spark, sf_dir, "events").withColumn("us", core.micros(F.col("ts")))
    first = e.groupBy(F.col("event_type").alias("sensor"), core.floor_to(F.col("us"), HOUR).alias("t")).agg(F.min(F.struct("us", "event_id", "value", "user_id")).alias("m"))
    return first.select("sensor", "t", "m.value", (F.col("m.value") <= LIMIT).alias("usable"), "m.user_id")


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{n}', {v}D)" for n, v in CUTS)
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("sensor")).distinct()
    return kinds.join(F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS c(threshold_type, threshold)")))


BASE = f"""
WITH obs AS (
  SELECT event_type AS sensor, epoch_us(date_trunc('hour', ts)) AS t, first(value ORDER BY ts, event_id) AS value,
         first(value ORDER BY ts, event_id) <= {LIMIT} AS usable, first(user_id ORDER BY ts, event_id) AS user_id
  FROM events GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN usable THEN value END AS v FROM obs),
cuts AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {v}::DOUBLE)" for n, v in CUTS)}) c(threshold_type, threshold))
"""
US = core.MINUTE


def _over(m: int) -> str:
    return f"OVER (PARTITION BY sensor ORDER BY t RANGE BETWEEN {m * US - 1} PRECEDING AND CURRENT ROW)"


def _lag(m: int) -> str:
    return f"max(v) OVER (PARTITION BY sensor ORDER BY t RANGE BETWEEN {m * US} PRECEDING AND {m * US} PRECEDING)"


def _roll_sql(m: int) -> str:
    gate = f"round(count(v) {_over(m)} / {m // HOUR}.0, 6) >= 0.8 AND count(v) {_over(m)} > 0"
    return f"""CASE WHEN {gate} THEN round(sum(v) {_over(m)}, 6) END AS rf_roll_{m}m_sum,
      CASE WHEN {gate} THEN round(max(v) {_over(m)}, 6) END AS rf_roll_{m}m_max,
      CASE WHEN {gate} THEN count(CASE WHEN v > 50 THEN 1 END) {_over(m)} END AS rf_roll_{m}m_wet_count,
      round(count(v) {_over(m)}::DOUBLE / {m // HOUR}.0::DOUBLE, 6) AS rf_roll_{m}m_coverage,
      CASE WHEN {gate} THEN (sum(v) {_over(m)} > 50)::INT END AS rf_roll_{m}m_is_wet"""


def _level_sql(m: int) -> str:
    gate = f"round(count(v) {_over(m)} / {m // HOUR}.0, 6) >= 0.8 AND count(v) {_over(m)} > 0"
    move = f"coalesce(round(value - {_lag(m)}, 6), value - arg_min(v, t) {_over(m)})"
    return f"""round(value - {_lag(m)}, 6) AS wl_delta_{m}m, round((value - {_lag(m)}) / {m / 60}, 6) AS wl_rate_{m}m,
      CASE WHEN {gate} THEN round(min(v) {_over(m)}, 6) END AS wl_min_{m}m, CASE WHEN {gate} THEN round(max(v) {_over(m)}, 6) END AS wl_max_{m}m,
      CASE WHEN {gate} THEN round(avg(v) {_over(m)}, 6) END AS wl_mean_{m}m, CASE WHEN {gate} THEN round(max(v) {_over(m)} - min(v) {_over(m)}, 6) END AS wl_range_{m}m,
      round(count(v) {_over(m)}::DOUBLE / {m // HOUR}.0::DOUBLE, 6) AS wl_coverage_{m}m,
      CASE WHEN {gate} THEN CASE WHEN {move} > 0.01 THEN 'RISING' WHEN {move} < -0.01 THEN 'FALLING' ELSE 'STABLE' END END AS wl_trend_{m}m"""


KEEP = ["sensor", "t", "value"]


@_query(f"SELECT * FROM (SELECT sensor, t, value, usable, {', '.join(map(_roll_sql, WINDOWS))} FROM u) WHERE usable".replace("SELECT * FROM (", "SELECT * EXCLUDE (usable) FROM ("))
def rf_rolling(spark, sf_dir):
    return windows.rolling(observations(spark, sf_dir), WINDOWS, HOUR, wet=50.0).drop("usable", "user_id")


@_query(f"SELECT sensor, t, value, {', '.join(f'l{m} AS rf_lag_{m}m' for m in (0, 60, 120, 360))} FROM (SELECT *, {', '.join(f'round({_lag(m)}, 6) AS l{m}' for m in (0, 60, 120, 360))} FROM u) WHERE usable")
def rf_lags(spark, sf_dir):
    return windows.lags(observations(spark, sf_dir), (0, 60, 120, 360)).drop("usable", "user_id")


@_query(f"SELECT sensor, t, value, (t - w) / {US}.0::DOUBLE AS rf_minutes_since_last_wet FROM (SELECT *, max(CASE WHEN v > 50 THEN t END) OVER (PARTITION BY sensor ORDER BY t ROWS UNBOUNDED PRECEDING) AS w FROM u) WHERE usable")
def rf_since_wet(spark, sf_dir):
    return windows.minutes_since(observations(spark, sf_dir), 50.0).drop("usable", "user_id")


@_query(f"SELECT * EXCLUDE (usable) FROM (SELECT sensor, t, value, usable, {', '.join(map(_level_sql, WINDOWS))} FROM u) WHERE usable")
def wl_changes(spark, sf_dir):
    return windows.level_changes(observations(spark, sf_dir), WINDOWS, HOUR).drop("usable", "user_id")


@_query("SELECT sensor, t, value, threshold_type, threshold, round(value - threshold, 6) AS distance FROM u, cuts WHERE usable")
def wl_threshold_distance(spark, sf_dir):
    return windows.threshold_distance(observations(spark, sf_dir), cuts(spark, sf_dir)).drop("usable", "user_id")


@_query(f"SELECT a.*, {', '.join(f'b.wl_delta_{m}m, b.wl_trend_{m}m' for m in WINDOWS)} FROM (SELECT sensor, t, value, usable, {', '.join(map(_roll_sql, WINDOWS))} FROM u) a JOIN (SELECT sensor, t, {', '.join(map(_level_sql, WINDOWS))} FROM u) b USING (sensor, t) WHERE usable".replace("SELECT a.*", "SELECT a.* EXCLUDE (usable)"))
def feature_table(spark, sf_dir):
    obs = observations(spark, sf_dir)
    level = windows.level_changes(obs, WINDOWS, HOUR).select("sensor", "t", *[f"wl_{k}_{m}m" for m in WINDOWS for k in ("delta", "trend")])
    return windows.rolling(obs, WINDOWS, HOUR, wet=50.0).drop("usable", "user_id").join(level, ["sensor", "t"])


@_query("""
SELECT o_orderkey, hour(d) AS time_hour, minute(d) AS time_minute, isodow(d) - 1 AS time_weekday, month(d) AS time_month, (isodow(d) >= 6)::INT AS time_is_weekend,
  round(sin(2 * pi() * (hour(d) + minute(d) / 60.0) / 24), 6) + 0.0 AS time_hour_sin, round(cos(2 * pi() * (hour(d) + minute(d) / 60.0) / 24), 6) + 0.0 AS time_hour_cos,
  round(sin(2 * pi() * (month(d) - 1) / 12), 6) + 0.0 AS time_month_sin, round(cos(2 * pi() * (month(d) - 1) / 12), 6) + 0.0 AS time_month_cos,
  round(sin(2 * pi() * (isodow(d) - 1) / 7), 6) + 0.0 AS time_weekday_sin, round(cos(2 * pi() * (isodow(d) - 1) / 7), 6) + 0.0 AS time_weekday_cos
FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)""")
def calendar_features(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", *[c.alias(n) for n, c in core.calendar(F.col("o_orderdate")).items()])


@_query(f"SELECT sensor, t, 1 + sum(coalesce((gap > 7200000000)::INT, 0)) OVER (PARTITION BY sensor ORDER BY t ROWS UNBOUNDED PRECEDING) AS \"window\" FROM (SELECT *, t - lag(t) OVER (PARTITION BY sensor ORDER BY t) AS gap FROM obs)")
def observation_windows(spark, sf_dir):
    return islands.observation_windows(observations(spark, sf_dir), 120).select("sensor", "t", F.col("window").cast("bigint").alias("window"))


EPISODES = f""", win AS (SELECT *, sum(coalesce((gap > {720 * US})::INT, 0)) OVER (PARTITION BY sensor ORDER BY t ROWS UNBOUNDED PRECEDING) AS w FROM (SELECT *, t - lag(t) OVER (PARTITION BY sensor ORDER BY t) AS gap FROM u)),
ex AS (SELECT win.*, threshold_type, threshold, usable AND value >= threshold AS ov FROM win, cuts),
nb AS (SELECT *, lag(ov) OVER o AS po, t - lag(t) OVER o AS d, lead(t) OVER o AS nt, lead(ov) OVER o AS no_, lead(usable) OVER o AS nu FROM ex WINDOW o AS (PARTITION BY sensor, threshold_type, w ORDER BY t)),
ep AS (SELECT *, sum((NOT (coalesce(po, false) AND d <= {HOUR * US}))::INT) OVER (PARTITION BY sensor, threshold_type ORDER BY t ROWS UNBOUNDED PRECEDING) AS episode FROM nb WHERE ov),
eps AS (SELECT sensor, threshold_type, threshold, episode::BIGINT AS episode, min(t) AS start_us, max(t) AS end_us, count(*) AS observations, round(max(value), 6) AS peak, round(max(value) - threshold, 6) AS max_exceedance,
  arg_max(CASE WHEN nt IS NULL THEN 'WINDOW_EDGE' WHEN no_ OR NOT nu THEN 'INTERRUPTED_BY_MISSING_DATA' ELSE 'ENDED_BELOW_THRESHOLD' END, t) AS termination,
  (max(t) - min(t)) / {US}.0::DOUBLE AS duration_minutes FROM ep GROUP BY 1, 2, 3, 4)
"""


@_query(EPISODES + "SELECT * FROM eps")
def episodes(spark, sf_dir):
    return islands.episodes(observations(spark, sf_dir), cuts(spark, sf_dir), HOUR, 720)


@_query(EPISODES + "SELECT sensor, threshold_type, count(*) AS episodes, sum(observations)::BIGINT AS observations, max(peak) AS peak, round(avg(duration_minutes), 6) AS mean_minutes, count(*) FILTER (termination = 'WINDOW_EDGE') AS at_edge FROM eps GROUP BY 1, 2")
def episode_stats(spark, sf_dir):
    e = islands.episodes(observations(spark, sf_dir), cuts(spark, sf_dir), HOUR, 720)
    return e.groupBy("sensor", "threshold_type").agg(F.count("*").alias("episodes"), F.sum("observations").alias("observations"), F.max("peak").alias("peak"), core.round6(F.avg("duration_minutes")).alias("mean_minutes"), F.count_if(F.col("termination") == "WINDOW_EDGE").alias("at_edge"))


PAIRS = f""", seen AS (SELECT *, sum((NOT usable)::INT) OVER (PARTITION BY sensor ORDER BY t ROWS UNBOUNDED PRECEDING) AS sk FROM u),
pr AS (SELECT sensor, t, lag(t) OVER o AS from_t, round(value - lag(value) OVER o, 6) AS ch, sk - lag(sk) OVER o AS bt FROM seen WHERE usable WINDOW o AS (PARTITION BY sensor ORDER BY t)),
pairs AS (SELECT sensor, from_t, t, CASE WHEN bt > 0 THEN 'NOT_USABLE_ROW_BETWEEN' WHEN t - from_t > {HOUR * US} THEN 'GAP_EXCEEDS_MAX' END AS break_reason, ch FROM pr WHERE from_t IS NOT NULL)
"""


@_query(PAIRS + f"SELECT sensor, from_t, t, break_reason, CASE WHEN break_reason IS NULL THEN ch END AS change, CASE WHEN break_reason IS NULL THEN round(ch / ((t - from_t) / {60 * US}.0::DOUBLE), 6) END AS rate_per_hour, CASE WHEN break_reason IS NULL THEN sign(ch)::INT END AS direction FROM pairs")
def change_pairs(spark, sf_dir):
    return islands.change_pairs(observations(spark, sf_dir), HOUR)


@_query(PAIRS + "SELECT sensor, run::BIGINT AS run, count(*) AS pairs, min(from_t) AS start_us, max(t) AS end_us FROM (SELECT *, sum((break_reason IS NOT NULL)::INT) OVER (PARTITION BY sensor ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM pairs) WHERE break_reason IS NULL GROUP BY 1, 2")
def change_runs(spark, sf_dir):
    return islands.change_runs(observations(spark, sf_dir), HOUR)


GRID = f""", span AS (SELECT sensor, min(t) AS a, max(t) AS b FROM obs GROUP BY 1),
slots AS (SELECT sensor, unnest(range(a, b + 1, {HOUR * US})) AS t FROM span),
grid AS (SELECT s.sensor, s.t, CASE WHEN o.usable THEN 'USABLE' WHEN o.usable IS NULL THEN 'ABSENT_SLOT' ELSE 'NOT_USABLE' END AS state FROM slots s LEFT JOIN obs o USING (sensor, t))
"""


@_query(GRID + "SELECT * FROM grid")
def slot_grid(spark, sf_dir):
    return islands.slot_grid(observations(spark, sf_dir), HOUR)


@_query(GRID + f""", tn AS (SELECT *, state = 'USABLE' AS usable, coalesce(((state = 'USABLE') <> lag(state = 'USABLE') OVER (PARTITION BY sensor ORDER BY t))::INT, 0) AS tu FROM grid),
rn AS (SELECT *, sum(tu) OVER (PARTITION BY sensor ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM tn)
SELECT sensor, run, usable, min(t) AS start_us, max(t) AS end_us, count(*) AS slots, count(*) FILTER (state = 'ABSENT_SLOT') AS absent_slots, (count(*) - 1) * {HOUR} AS first_to_last_minutes, min(t) = a AS at_start, max(t) = b AS at_end FROM rn JOIN span USING (sensor) GROUP BY sensor, run, usable, a, b""")
def missing_runs(spark, sf_dir):
    return islands.missing_runs(observations(spark, sf_dir), HOUR)


@_query(GRID + "SELECT sensor, count(*) AS expected, count(*) FILTER (state = 'USABLE') AS usable, round(100.0::DOUBLE * count(*) FILTER (state = 'USABLE') / count(*), 2) AS coverage_pct FROM grid GROUP BY 1")
def network_coverage(spark, sf_dir):
    return statistics.coverage(islands.slot_grid(observations(spark, sf_dir), HOUR), ["sensor"])


@_query(f"""
WITH iv AS (SELECT event_type AS sensor, epoch_us(ts) AS a, epoch_us(ts) + {10 * US} AS b FROM events),
mk AS (SELECT *, coalesce((a > max(b) OVER (PARTITION BY sensor ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {5 * US})::INT, 0) AS f FROM iv),
gr AS (SELECT *, sum(f) OVER (PARTITION BY sensor ORDER BY a, b ROWS UNBOUNDED PRECEDING)::BIGINT AS merged FROM mk)
SELECT sensor, merged, min(a) AS a, max(b) AS b, count(*) AS captures FROM gr GROUP BY 1, 2""")
def cadence_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("sensor"), core.micros(F.col("ts")).alias("a"))
    return islands.merged_windows(e.withColumn("b", F.col("a") + 10 * US))


@_query("""
WITH r AS (SELECT event_type, epoch_us(date_trunc('hour', ts)) AS t, event_id, ts, CASE WHEN event_id % 50 = 0 THEN 'ERROR' WHEN event_id % 51 = 0 THEN '' ELSE round(value / 100)::BIGINT::VARCHAR END AS raw FROM events),
s AS (SELECT *, CASE WHEN raw = '' THEN 'EMPTY:' WHEN raw = 'ERROR' THEN 'SOURCE_MARKER:ERROR' ELSE 'NUMERIC:' || raw END AS sig FROM r),
g AS (SELECT event_type AS sensor, t, count(*) AS duplicate_count, count(DISTINCT sig) AS k, first(raw ORDER BY ts, event_id) AS fr, bool_and(sig LIKE 'NUMERIC:%') AS alln, bool_or(sig LIKE 'NUMERIC:%') AS anyn FROM s GROUP BY 1, 2)
SELECT sensor, t, CASE WHEN duplicate_count = 1 THEN 'UNIQUE' WHEN k = 1 THEN 'IDENTICAL' ELSE 'CONFLICT' END AS duplicate_status, duplicate_count,
  CASE WHEN k > 1 THEN CASE WHEN alln THEN 'NUMERIC_VALUES_DIFFER' WHEN anyn THEN 'MARKER_VS_NUMERIC' ELSE 'MARKERS_DIFFER' END END AS conflict_reason,
  CASE WHEN k = 1 THEN try_cast(fr AS DOUBLE) END AS value, coalesce(k = 1 AND try_cast(fr AS DOUBLE) IS NOT NULL, false) AS usable FROM g""")
def canonical_observations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 50 == 0, "ERROR").when(F.col("event_id") % 51 == 0, "").otherwise(F.round(F.col("value") / 100).cast("bigint").cast("string"))
    rows = e.select(F.col("event_type").alias("sensor"), core.floor_to(core.micros(F.col("ts")), HOUR).alias("t"), "event_id", "ts", raw.alias("value_raw"))
    return canonical.resolve(rows, ["sensor", "t"], ["ts", "event_id"]).drop("quality_flags")


@_query(r"""
SELECT p_partkey, CASE WHEN x = '' THEN 'EMPTY' WHEN regexp_full_match(x, '-9999(\.0+)?') OR x IN ('ERROR', 'Tiada Data') THEN 'SOURCE_MARKER' WHEN regexp_full_match(x, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN 'NUMERIC' ELSE 'NON_NUMERIC' END AS status
FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '-9999.0' WHEN 1 THEN 'ERROR' WHEN 2 THEN '' WHEN 3 THEN p_name WHEN 4 THEN p_size::VARCHAR ELSE '-1.5e3' END AS x FROM part)""")
def value_parse_status(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 6
    x = F.when(k == 0, "-9999.0").when(k == 1, "ERROR").when(k == 2, "").when(k == 3, F.col("p_name")).when(k == 4, F.col("p_size").cast("string")).otherwise("-1.5e3")
    return p.select("p_partkey", core.value_status(x).alias("status"))


LABELS = f""", lb AS (SELECT a.sensor, a.t AS origin_us, h AS horizon, threshold_type, a.value, threshold, b.value AS tg FROM (SELECT * FROM obs WHERE usable) a CROSS JOIN (VALUES (60), (120), (360)) hz(h) CROSS JOIN cuts
  LEFT JOIN (SELECT * FROM obs WHERE usable) b ON b.sensor = a.sensor AND b.t = a.t + h::BIGINT * {US}),
lab AS (SELECT sensor, origin_us, horizon, threshold_type, CASE WHEN tg IS NULL THEN 'MISSING_FUTURE_TARGET' ELSE 'TARGET_EVALUATED' END AS status, round(tg - value, 6) AS delta,
  CASE WHEN tg IS NOT NULL THEN tg >= threshold END AS exceeds, CASE WHEN tg IS NOT NULL THEN value < threshold AND tg >= threshold END AS escalates FROM lb)
"""
HORIZONS = (60, 120, 360)


@_query(LABELS + "SELECT * FROM lab")
def labels_multi_horizon(spark, sf_dir):
    return labels.horizon_labels(observations(spark, sf_dir), cuts(spark, sf_dir), HORIZONS)


@_query(LABELS + """SELECT horizon, threshold_type, count(*) AS origins, count(exceeds) AS evaluable, count(*) FILTER (exceeds) AS positives, count(*) FILTER (escalates) AS escalations,
 CASE WHEN count(exceeds) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (exceeds) / count(exceeds), 2) END AS prevalence_pct,
 CASE WHEN count(*) FILTER (exceeds) > 0 THEN round((count(exceeds) - count(*) FILTER (exceeds))::DOUBLE / count(*) FILTER (exceeds), 4) END AS negatives_per_positive FROM lab GROUP BY 1, 2""")
def label_prevalence(spark, sf_dir):
    return labels.prevalence(labels.horizon_labels(observations(spark, sf_dir), cuts(spark, sf_dir), HORIZONS))


@_query(LABELS + """SELECT sensor, origin_us, threshold_type, bool_or(exceeds) FILTER (horizon = 60) AS "60", bool_or(exceeds) FILTER (horizon = 120) AS "120", bool_or(exceeds) FILTER (horizon = 360) AS "360" FROM lab GROUP BY 1, 2, 3""")
def feature_label_join(spark, sf_dir):
    return labels.wide_labels(labels.horizon_labels(observations(spark, sf_dir), cuts(spark, sf_dir), HORIZONS), HORIZONS)


@_query(f"""SELECT sensor, t, CASE WHEN t <= {SPLIT[0]} THEN CASE WHEN t <= {SPLIT[0] - 120 * US} THEN 'train' ELSE 'purged' END WHEN t <= {SPLIT[1]} THEN CASE WHEN t <= {SPLIT[1] - 120 * US} THEN 'validation' ELSE 'purged' END ELSE 'test' END AS part FROM obs""")
def chronological_split(spark, sf_dir):
    return observations(spark, sf_dir).select("sensor", "t", labels.chronological_split(F.col("t"), *SPLIT).alias("part"))


@_query(f"""SELECT sensor, fold, part, count(*) AS n FROM (
 SELECT sensor, 1 AS fold, unnest(CASE WHEN t <= {SPLIT[0] - 120 * US} THEN ['train', 'validation'] WHEN t <= {SPLIT[0]} THEN ['purged'] ELSE [] END) AS part FROM obs
 UNION ALL SELECT sensor, 2, unnest(CASE WHEN t <= {SPLIT[0]} THEN ['train'] WHEN t <= {SPLIT[1] - 120 * US} THEN ['train', 'validation'] WHEN t <= {SPLIT[1]} THEN ['purged'] ELSE [] END) FROM obs) GROUP BY 1, 2, 3""")
def walk_forward(spark, sf_dir):
    return labels.walk_forward(observations(spark, sf_dir), list(SPLIT)).groupBy("sensor", "fold", "part").agg(F.count("*").alias("n"))


@_query("""WITH f AS (SELECT 'l_quantity' AS feature, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
SELECT feature, median(x) AS median, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM f GROUP BY 1""")
def preprocess_fit(spark, sf_dir):
    return labels.fit_preprocessor(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])


@_query("SELECT quality, count(*) AS n, round((SELECT count(*) FROM labels WHERE quality IS NOT NULL) / (2.0::DOUBLE * count(*)), 6) AS weight FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def class_weights(spark, sf_dir):
    return labels.class_weights(table(spark, sf_dir, "labels"), "quality")


@_query("""SELECT event_type, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_samp(value), 6) AS std, round(skewness(value), 4) AS skew,
 CASE WHEN count(value) >= 10 THEN round(quantile_cont(value, 0.5), 6) END AS p50, CASE WHEN count(value) >= 20 THEN round(quantile_cont(value, 0.75), 6) END AS p75, CASE WHEN count(value) >= 50 THEN round(quantile_cont(value, 0.9), 6) END AS p90,
 CASE WHEN count(value) >= 100 THEN round(quantile_cont(value, 0.95), 6) END AS p95, CASE WHEN count(value) >= 500 THEN round(quantile_cont(value, 0.99), 6) END AS p99 FROM events GROUP BY 1""")
def describe_guarded(spark, sf_dir):
    return statistics.describe(table(spark, sf_dir, "events"), ["event_type"])


@_query("""SELECT event_type, min(k)::INT AS intervals FROM (SELECT event_type, sum(value) OVER (PARTITION BY event_type ORDER BY value DESC ROWS UNBOUNDED PRECEDING) AS r, sum(value) OVER (PARTITION BY event_type) AS w, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS k FROM events WHERE value > 0) WHERE r >= w * 0.5 GROUP BY 1""")
def concentration(spark, sf_dir):
    return statistics.concentration(table(spark, sf_dir, "events"), ["event_type"])


@_query(f"SELECT sensor, t // {1440 * US} AS day, count(*) AS usable_slots FROM obs WHERE usable GROUP BY 1, 2 HAVING count(*) >= 20")
def covered_days(spark, sf_dir):
    return statistics.covered_days(observations(spark, sf_dir), F.floor(F.col("t") / (1440 * US)), 24)


SCORED = """WITH sc AS (SELECT doc_id, lang, quality AS truth, 1.0::DOUBLE - least(1.0::DOUBLE, (length(text) - length(replace(replace(replace(text, '!', ''), '$', ''), '|', '')))::DOUBLE / greatest(1, length(text)) * 4) AS score FROM documents JOIN labels USING (doc_id))
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), F.col("text")
    share = (F.length(text) - F.length(F.translate(text, "!$|", ""))) / F.greatest(F.lit(1), F.length(text)).cast("double") * 4
    return d.select("doc_id", "lang", F.col("quality").alias("truth"), (1.0 - F.least(F.lit(1.0), share)).alias("score"))


@_query(SCORED + """, g AS (SELECT lang, count(*) FILTER (truth = 1 AND score >= 0.9) AS tp, count(*) FILTER (truth = 0 AND score >= 0.9) AS fp, count(*) FILTER (truth = 1 AND score < 0.9) AS fn, count(*) FILTER (truth = 0 AND score < 0.9) AS tn FROM sc GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS q FROM g)
SELECT lang, tp, fp, fn, tn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) WHEN p + q = 0 THEN 0.0 END, 6) AS f1, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy FROM r""")
def confusion_metrics(spark, sf_dir):
    return statistics.confusion(scored(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.9).cast("int")), ["lang"])


@_query(SCORED + """SELECT lang, count(*) AS n, sum(truth)::BIGINT AS positives, CASE WHEN sum(truth) > 0 AND sum(truth) < count(*) THEN round(sum(CASE WHEN truth = 1 THEN h::DOUBLE / k END) / sum(truth), 6) END AS average_precision
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS k, sum(truth) OVER (PARTITION BY lang ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS h FROM sc) GROUP BY 1""")
def average_precision(spark, sf_dir):
    return statistics.average_precision(scored(spark, sf_dir), ["lang"], "score", "truth", "doc_id")


@_query(SCORED + """, g AS (SELECT threshold, count(*) FILTER (truth = 1 AND score >= threshold) AS tp, count(*) FILTER (truth = 0 AND score >= threshold) AS fp, count(*) FILTER (truth = 1 AND score < threshold) AS fn FROM sc, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold) GROUP BY 1),
f AS (SELECT *, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM g) SELECT *, row_number() OVER (ORDER BY f1 DESC NULLS LAST, threshold) = 1 AS best FROM f""")
def threshold_grid(spark, sf_dir):
    return statistics.threshold_grid(scored(spark, sf_dir), "score", "truth")


@_query(f"""SELECT a.sensor, count(*) AS n, round(avg(abs(b.value - a.value)), 6) AS mae, round(sqrt(avg((b.value - a.value) * (b.value - a.value))), 6) AS rmse FROM obs a JOIN obs b ON a.sensor = b.sensor AND b.t = a.t + {HOUR * US} WHERE a.usable AND b.usable GROUP BY 1""")
def persistence_errors(spark, sf_dir):
    base = observations(spark, sf_dir).where("usable")
    future = base.select("sensor", (F.col("t") - HOUR * US).alias("t"), F.col("value").alias("target"))
    return statistics.errors(base.join(future, ["sensor", "t"]), ["sensor"], "target", "value")


@_query(f"""SELECT e.event_id, f.event_id AS forecast_id, f.value AS forecast_value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) f ON e.user_id = f.user_id AND e.ts >= f.ts""")
def weather_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    f = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("forecast_id"), F.col("value").alias("forecast_value"))
    return joins.as_of(e.select("event_id", "user_id", "ts"), f, ["user_id"], "ts", "at", ["forecast_id", "forecast_value"]).select("event_id", "forecast_id", "forecast_value")


@_query("""WITH e AS (SELECT event_type, epoch_us(date_trunc('hour', ts)) AS t, last(value ORDER BY event_id) AS v, last(user_id ORDER BY event_id) AS user_id, max(event_id) AS event_id FROM events GROUP BY 1, 2)
SELECT t, a.v AS rain, b.v AS level, b.user_id, b.event_id FROM (SELECT * FROM e WHERE event_type = 'view') a JOIN (SELECT * FROM e WHERE event_type = 'click') b USING (t)""")
def paired_site(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", core.floor_to(core.micros(F.col("ts")), HOUR))
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("t", F.col("value").alias(name), "user_id", "event_id")
    return joins.paired(side("view", "rain"), side("click", "level"), ["t"], ["user_id", "event_id"], order="event_id")


@_query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def station_dimension(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return joins.with_dimension(joins.with_dimension(s, n, ["n_nationkey"]), table(spark, sf_dir, "region"), ["r_regionkey"]).select("s_suppkey", "n_name", "r_name")


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def referential_gaps(spark, sf_dir):
    return joins.orphans(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@_query("SELECT p_size, p_brand, count(DISTINCT p_partkey) AS n_keys FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) >= 2")
def co_located(spark, sf_dir):
    return joins.co_located(table(spark, sf_dir, "part"), "p_size", "p_brand", "p_partkey").drop("keys")


@_query("SELECT sensor, max(t) AS t, arg_max(value, t) AS value FROM obs GROUP BY 1")
def latest_per_sensor(spark, sf_dir):
    return joins.latest(observations(spark, sf_dir), ["sensor"], "t", ["value"])


@_query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def topk_attention(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice", "o_orderpriority")


@_query("(SELECT o_orderkey AS k FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem) UNION ALL (SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)")
def set_except_all(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return canonical.symmetric_difference(o.select(F.col("o_orderkey").alias("k")), li.select(F.col("l_orderkey").alias("k")))


@_query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@_query("SELECT count(*) FILTER (l IS NULL OR r IS NULL) AS orphans, count(*) FILTER (l > 1 OR r > 1) AS repeated_keys FROM (SELECT o_orderkey AS k, count(*) AS l FROM orders GROUP BY 1) FULL JOIN (SELECT l_orderkey AS k, count(*) AS r FROM lineitem GROUP BY 1) USING (k)")
def one_to_one_layers(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return canonical.one_to_one(a, b, ["k"]).select((F.col("left_orphans") + F.col("right_orphans")).alias("orphans"), "repeated_keys")


@_query(f"SELECT a.sensor, a.t AS origin_us, a.value AS l0, b.value AS l1, c.value AS l3 FROM obs a JOIN obs b ON a.sensor = b.sensor AND b.t = a.t - {60 * US} JOIN obs c ON a.sensor = c.sensor AND c.t = a.t - {180 * US} WHERE a.usable AND b.usable AND c.usable")
def lag_matrix(spark, sf_dir):
    m = joins.complete_lags(observations(spark, sf_dir), (0, 60, 180))
    return m.select("sensor", "origin_us", *[F.col("inputs")[k].alias(n) for k, n in enumerate(("l0", "l1", "l3"))])


@_query(f"SELECT a.sensor, count(*) AS n, round(regr_slope(a.value, b.value), 6) AS slope, round(regr_intercept(a.value, b.value), 6) AS intercept FROM obs a JOIN obs b ON a.sensor = b.sensor AND b.t = a.t - {60 * US} WHERE a.usable AND b.usable GROUP BY 1")
def ar_ols(spark, sf_dir):
    m = joins.complete_lags(observations(spark, sf_dir), (0, 60)).select("sensor", F.col("inputs")[0].alias("y"), F.col("inputs")[1].alias("x"))
    return m.groupBy("sensor").agg(F.count("*").alias("n"), core.round6(F.regr_slope("y", "x")).alias("slope"), core.round6(F.regr_intercept("y", "x")).alias("intercept"))


@_query(f""", m AS (SELECT a.sensor, a.value AS y, b.value AS p, c.value AS q FROM obs a JOIN obs b ON a.sensor = b.sensor AND b.t = a.t - {60 * US} JOIN obs c ON a.sensor = c.sensor AND c.t = a.t - {120 * US} WHERE a.usable AND b.usable AND c.usable),
k AS (SELECT sensor, count(*) AS n, covar_pop(y, p) AS yp, covar_pop(y, q) AS yq, covar_pop(p, q) AS pq, var_pop(p) AS pp, var_pop(q) AS qq, avg(y) AS my, avg(p) AS mp, avg(q) AS mq FROM m GROUP BY 1),
s AS (SELECT *, (yp * qq - yq * pq) / (pp * qq - pq * pq) AS b1, (yq * pp - yp * pq) / (pp * qq - pq * pq) AS b2 FROM k) SELECT sensor, n, round(b1, 6) AS lag_60, round(b2, 6) AS lag_120, round(my - b1 * mp - b2 * mq, 4) AS constant FROM s""")
def ar_two_lags(spark, sf_dir):
    m = joins.complete_lags(observations(spark, sf_dir), (0, 60, 120)).select("sensor", *[F.col("inputs")[k].alias(n) for k, n in enumerate(("y", "p", "q"))])
    fitted = models.fit_autoregression(m, "sensor", "y", ["p", "q"])
    return fitted.select("sensor", "n", F.round(F.col("coefficients")[0], 6).alias("lag_60"), F.round(F.col("coefficients")[1], 6).alias("lag_120"), F.round(F.col("coefficients")[2], 4).alias("constant"))


@_query("SELECT event_type, epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.windowed(e, "ts", ["event_type"], "6 hours").select("event_type", F.unix_micros("window_start").alias("start_us"), "n", "total")


@_query("SELECT event_type, count(*) AS sessions FROM (SELECT event_type, (ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) >= INTERVAL '30 minutes') IS DISTINCT FROM false AS s FROM events) WHERE s GROUP BY 1")
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.sessions(e, "ts", ["event_type"], "30 minutes").groupBy("event_type").agg(F.count("*").alias("sessions"))


@_query(f"SELECT user_id, CASE WHEN m > 60 THEN 'STALE' ELSE 'ACTIVE' END AS verdict, CASE WHEN m <= 30 THEN 'FRESH' WHEN m <= 180 THEN 'DELAYED' ELSE 'STALE' END AS freshness FROM (SELECT user_id, ((SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts))) / {US}.0::DOUBLE AS m FROM events GROUP BY 1)")
def stale_verdicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", core.micros(F.col("ts")).alias("t"))
    last = e.groupBy("user_id").agg(F.max("t").alias("t")).crossJoin(F.broadcast(e.agg(F.max("t").alias("now"))))
    age = core.minutes_between(F.col("now"), F.col("t"))
    return last.select("user_id", core.staleness(age).alias("verdict"), core.freshness(age).alias("freshness"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@_query(r"SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host, nullif(regexp_extract(url, '[?&]id=([^&#]*)', 1), '') AS id FROM pages")
def url_query_param(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract(u, "^https?://([^/]+)", 1), F.lit("")).alias("host"), core.url_parameter(u, "id").alias("id"))


@_query("""SELECT page_id::VARCHAR AS page_id, k AS row_no, line AS source_line, CASE WHEN k % 4 = 0 THEN NULL ELSE 's' || page_id || '_' || k END AS link_id, 'Station ' || k AS name, CASE WHEN k % 3 = 0 THEN '-9999' ELSE (page_id % 50)::VARCHAR END AS value_raw,
  CASE WHEN k % 5 = 0 THEN 'CELL_COUNT' WHEN k % 7 = 0 THEN 'UNKNOWN_DISTRICT' WHEN k % 4 = 0 THEN 'NO_LINK_ID' END AS quarantine FROM (SELECT page_id, unnest(generate_series(1, 12)) AS k, unnest(generate_series(3, 14)) AS line FROM pages WHERE page_id % 3 <> 0)
UNION ALL SELECT page_id::VARCHAR, NULL, NULL, NULL, NULL, NULL, 'HEADER_DIFFERS' FROM pages WHERE page_id % 3 = 0""")
def html_listing(spark, sf_dir):
    k = lambda x: x.cast("string")
    page = table(spark, sf_dir, "pages").select("page_id")
    row = lambda i: F.concat(
        F.lit("\n<tr><td data-th='No'>"), k(i), F.lit("</td><td>"), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("<a href='g?stationid=s"), k(F.col("page_id")), F.lit("_"), k(i), F.lit("&x=1'>g</a>"))),
        F.lit("</td><td> Station \t "), k(i), F.lit(" </td><td>"), F.when(i % 7 == 0, "Elsewhere").otherwise("Timur"), F.lit("</td><td>"), F.when(i % 3 == 0, "-9999").otherwise(k(F.col("page_id") % 50)), F.lit("</td>"), F.when(i % 5 == 0, "<td>more</td>").otherwise(""), F.lit("</tr>"))
    head = F.concat(F.lit("<table>\n<tr><th>No</th><th>Graf</th><th>Nama</th><th>Daerah</th><th>"), F.when(F.col("page_id") % 3 == 0, "Lain").otherwise("Nilai"), F.lit("</th></tr>"))
    html = F.concat(head, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), row), ""), F.lit("\n</table>"))
    return readers.listing_rows(page.withColumn("html", html), ["No", "Graf", "Nama", "Daerah", "Nilai"], ["Timur"])


@_query("""SELECT s_suppkey, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab89ab89ab89ab', strpos('0123456789abcdef', h[17]), 1) || h[18:20], h[21:32]) AS sensor_id
FROM (SELECT s_suppkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ('sensor/' || s_suppkey)::BLOB) AS h FROM supplier)""")
def uuid5_ids(spark, sf_dir):
    name = F.concat(F.lit("sensor/"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", core.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", name).alias("sensor_id"))
