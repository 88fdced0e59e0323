"""Queries of missing values, coverage, sufficiency and splits over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import core
from hydrolith.operators import contracts, islands, labels, missingness, readiness, statistics, windows
from hydrolith.plans.catalog import HOUR, SPLIT, US, _query, cuts, observations, table

HORIZONS = (60, 120, 360)
GAP = 3 * HOUR
TYPES = ("SOURCE_MARKER", "OTHER_NOT_USABLE", "ABSENT_SLOT")


def captured(spark, sf_dir):
    """Hourly rows with the batch that captured them: one for each sensor and six hours, half a day of every third left out."""
    o = observations(spark, sf_dir)
    six = F.floor(F.col("t") / (6 * HOUR * US))
    return o.where(six % 5 != 2).select("sensor", "t", "value", "usable", six.cast("string").alias("batch"), F.when(F.col("usable"), "USABLE").when(F.col("value") > 260, "SOURCE_MARKER").otherwise("OTHER_NOT_USABLE").alias("state"))


CAPTURED = f""", cap AS (SELECT sensor, t, value, usable, t // {6 * HOUR * US} AS b, CASE WHEN usable THEN 'USABLE' WHEN value > 260 THEN 'SOURCE_MARKER' ELSE 'OTHER_NOT_USABLE' END AS state FROM obs WHERE (t // {6 * HOUR * US}) % 5 <> 2),
sp AS (SELECT sensor, b, min(t) AS lo, max(t) AS hi FROM cap GROUP BY 1, 2),
s2 AS (SELECT *, coalesce(lo > max(hi) OVER (PARTITION BY sensor ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {HOUR * US}, false)::INT AS new FROM sp),
s3 AS (SELECT *, sum(new) OVER (PARTITION BY sensor ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS span FROM s2),
c1 AS (SELECT c.sensor, c.t, c.state, c.value, c.usable, s.span, lag(c.t) OVER (PARTITION BY c.sensor ORDER BY c.t) AS p, lag(s.span) OVER (PARTITION BY c.sensor ORDER BY c.t) AS ps FROM cap c JOIN s3 s USING (sensor, b)),
c2 AS (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN ps <> span THEN 'SEPARATE_CAPTURES' WHEN t - p > {GAP * US} THEN 'GAP_EXCEEDS_MAX_ABSENT' END AS boundary FROM c1),
c3 AS (SELECT *, sum((boundary IS NOT NULL)::INT) OVER (PARTITION BY sensor ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS win FROM c2),
ex AS (SELECT sensor, win, min(t) AS lo, max(t) AS hi FROM c3 GROUP BY 1, 2),
sl AS (SELECT e.sensor, e.win, g.t FROM ex e, LATERAL (SELECT unnest(generate_series(e.lo, e.hi, {HOUR * US})) AS t) g),
st AS (SELECT sl.sensor, sl.win, sl.t, coalesce(c.state, 'ABSENT_SLOT') AS state FROM sl LEFT JOIN cap c ON c.sensor = sl.sensor AND c.t = sl.t)
"""
RUNS = f""", r1 AS (SELECT *, coalesce((state = 'USABLE') <> lag(state = 'USABLE') OVER (PARTITION BY sensor, win ORDER BY t), false)::INT AS turn FROM st),
r2 AS (SELECT *, sum(turn) OVER (PARTITION BY sensor, win ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS run, min(t) OVER (PARTITION BY sensor, win) AS w0, max(t) OVER (PARTITION BY sensor, win) AS w1 FROM r1),
rn AS (SELECT sensor, win AS "window", run, CASE WHEN bool_or(state = 'USABLE') THEN 'OBSERVED' ELSE 'MISSING' END AS state, min(t) AS start_us, max(t) AS end_us, count(*) AS slots, min(t) = min(w0) AS at_start, max(t) = max(w1) AS at_end FROM r2 GROUP BY 1, 2, 3)
"""


def slots(spark, sf_dir):
    rows = captured(spark, sf_dir)
    return missingness.window_slots(missingness.capture_windows(rows, HOUR, GAP), rows, HOUR)


@_query(CAPTURED + 'SELECT sensor, t, win AS "window", boundary FROM c3')
def capture_windows(spark, sf_dir):
    return missingness.capture_windows(captured(spark, sf_dir), HOUR, GAP)


@_query(CAPTURED + """SELECT sensor, win AS "window", min(t) AS start_us, max(t) AS end_us, count(*) AS expected, count(*) FILTER (state = 'USABLE') AS usable, count(*) FILTER (state <> 'USABLE') AS missing, count(*) FILTER (state = 'ABSENT_SLOT') AS absent,
  round(100.0::DOUBLE * count(*) FILTER (state = 'USABLE') / count(*), 2) AS coverage_pct, count(*) FILTER (state = 'SOURCE_MARKER') AS n_source_marker, count(*) FILTER (state = 'OTHER_NOT_USABLE') AS n_other_not_usable, count(*) FILTER (state = 'ABSENT_SLOT') AS n_absent_slot FROM st GROUP BY 1, 2""")
def missingness_windows(spark, sf_dir):
    return missingness.window_summary(slots(spark, sf_dir), TYPES)


@_query(CAPTURED + "SELECT count(DISTINCT sensor) AS sensors, count(*) AS expected, count(*) FILTER (state = 'USABLE') AS usable, round(100.0::DOUBLE * count(*) FILTER (state = 'USABLE') / count(*), 2) AS coverage_pct FROM st")
def missingness_network(spark, sf_dir):
    return missingness.network_coverage(missingness.window_summary(slots(spark, sf_dir), TYPES))


@_query(CAPTURED + RUNS + f'SELECT *, (slots - 1) * {HOUR} AS first_to_last_minutes, slots * {HOUR} AS slot_minutes FROM rn')
def missingness_runs(spark, sf_dir):
    return missingness.slot_runs(captured(spark, sf_dir), HOUR, GAP)


@_query(CAPTURED + RUNS + """SELECT sensor, state, count(*) AS n_runs, min(slots) AS min_slots, max(slots) AS max_slots, CASE WHEN count(*) >= 3 THEN 'OK' ELSE 'INSUFFICIENT_SAMPLE' END AS mean_status, CASE WHEN count(*) >= 3 THEN round(avg(slots), 6) END AS mean_slots,
  CASE WHEN count(*) >= 50 THEN round(quantile_cont(slots, 0.9), 6) END AS p90_slots, CASE WHEN count(*) >= 10 THEN round(quantile_cont(slots, 0.5), 6) END AS p50_slots FROM rn GROUP BY 1, 2""")
def run_lengths(spark, sf_dir):
    d = missingness.describe_runs(missingness.slot_runs(captured(spark, sf_dir), HOUR, GAP), ["sensor", "state"])
    return d.select("sensor", "state", "n_runs", "min_slots", "max_slots", F.col("mean_slots.status").alias("mean_status"), F.col("mean_slots.value").alias("mean_slots"), F.col("p50_slots.value").alias("p50_slots"), F.col("p90_slots.value").alias("p90_slots"))


@_query(CAPTURED + RUNS + "SELECT sensor, state, arg_max(start_us, (slots, -start_us)) AS start_us, arg_max(end_us, (slots, -start_us)) AS end_us, max(slots) AS slots FROM rn GROUP BY 1, 2")
def longest_runs(spark, sf_dir):
    return missingness.longest_run(missingness.slot_runs(captured(spark, sf_dir), HOUR, GAP), ["sensor", "state"])


#: Windows that bridge a day without captures, so that days are whole.
BRIDGED = CAPTURED.replace(f"+ {HOUR * US}, false)::INT AS new", f"+ {24 * HOUR * US}, false)::INT AS new").replace(f"t - p > {GAP * US}", f"t - p > {24 * HOUR * US}")


@_query(BRIDGED + f"SELECT sensor, (t + {480 * US}) // {1440 * US} AS day, count(DISTINCT t) AS slots FROM st GROUP BY 1, 2 HAVING count(DISTINCT t) >= 24")
def full_local_days(spark, sf_dir):
    rows = captured(spark, sf_dir)
    return missingness.full_days(missingness.window_slots(missingness.capture_windows(rows, 24 * HOUR, 24 * HOUR), rows, HOUR), 480, 24)


@_query(CAPTURED + "SELECT state, count(*) AS n FROM cap WHERE value > 150 GROUP BY 1")
def severity_states(spark, sf_dir):
    flags = F.when(F.col("value") > 150, F.array(F.lit("SOURCE_SEVERITY_ERROR"))).otherwise(F.array().cast("array<string>"))
    return missingness.severity_states(captured(spark, sf_dir).withColumn("quality_flags", flags), "SOURCE_SEVERITY_ERROR")


@_query(CAPTURED + "SELECT sensor, count(*) AS n_rows, count(*) FILTER (usable) AS usable, min(t) AS first_us, max(t) AS last_us, count(DISTINCT b) AS batches FROM cap GROUP BY 1")
def listing_availability(spark, sf_dir):
    return missingness.listing_availability(captured(spark, sf_dir))


@_query(f", c AS (SELECT sensor, t // {1440 * US} AS day FROM obs WHERE usable GROUP BY 1, 2 HAVING count(*) >= 20) SELECT a.sensor AS sensor_a, b.sensor AS sensor_b, count(*) AS n_shared FROM c a JOIN c b ON a.day = b.day AND a.sensor < b.sensor GROUP BY 1, 2")
def shared_day_pairs(spark, sf_dir):
    return missingness.shared_days(statistics.covered_days(observations(spark, sf_dir), F.floor(F.col("t") / (1440 * US)), 24))


@_query(f"SELECT sensor, (t - {HOUR * US}) // {1440 * US} AS day, count(*) AS usable_slots FROM obs WHERE usable GROUP BY 1, 2 HAVING count(*) >= 20")
def covered_rain_days(spark, sf_dir):
    return statistics.covered_days(observations(spark, sf_dir), statistics.interval_day(F.col("t"), HOUR), 24)


LEVELS = f""", ow AS (SELECT *, 1 + sum(coalesce(t - p > {1440 * US}, false)::INT) OVER (PARTITION BY sensor ORDER BY t ROWS UNBOUNDED PRECEDING) AS w FROM (SELECT *, lag(t) OVER (PARTITION BY sensor ORDER BY t) AS p FROM obs WHERE t % {97 * HOUR * US} > {30 * HOUR * US}))
"""


@_query(LEVELS + f"""SELECT *, CASE WHEN usable >= 2 THEN d END AS net_change, CASE WHEN usable < 2 THEN 'INSUFFICIENT_SAMPLE' WHEN d > 0 THEN 'RISE' WHEN d < 0 THEN 'FALL' ELSE 'NO_CHANGE' END AS net_status, (last_us - first_us) / {US}.0::DOUBLE AS minutes FROM
(SELECT sensor, w AS "window", count(*) AS usable, min(value) AS lowest, arg_min(t, (value, t)) AS lowest_us, max(value) AS highest, arg_max(t, (value, -t)) AS highest_us, arg_min(value, t) AS first_value, arg_max(value, t) AS last_value, min(t) AS first_us, max(t) AS last_us,
  round(arg_max(value, t) - arg_min(value, t), 6) AS d FROM ow WHERE usable GROUP BY 1, 2)""".replace("SELECT *, CASE", "SELECT * EXCLUDE (d), CASE"))
def level_windows(spark, sf_dir):
    o = observations(spark, sf_dir).where(F.col("t") % (97 * HOUR * US) > 30 * HOUR * US)
    return missingness.level_windows(islands.observation_windows(o))


@_query("""SELECT analysis, measured::DOUBLE AS measured, required, CASE WHEN measured >= required THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END AS verdict FROM (SELECT max(n) AS rows_, max(u) AS usable_ FROM (SELECT sensor, count(*) AS n, count(*) FILTER (usable) AS u FROM obs GROUP BY 1)), LATERAL (VALUES ('trend', rows_, 100.0::DOUBLE), ('seasons', usable_, 1e9::DOUBLE)) v(analysis, measured, required)""")
def sufficiency_verdicts(spark, sf_dir):
    facts = observations(spark, sf_dir).groupBy("sensor").agg(F.count("*").alias("n"), F.count_if("usable").alias("u"))
    return readiness.sufficiency(facts, {"trend": ("n", 100), "seasons": ("u", 1e9)})


@_query(f""", lab AS (SELECT a.sensor, a.t, h AS horizon, b.value >= 120 AS label FROM obs a, (VALUES {', '.join(f'({h})' for h in HORIZONS)}) v(h), obs b WHERE a.usable AND b.usable AND b.sensor = a.sensor AND b.t = a.t + h * {US}::BIGINT),
pos AS (SELECT DISTINCT horizon, t FROM lab WHERE label), ep AS (SELECT horizon, count(*) FILTER (p IS NULL OR t - p > {int(7.5 * US)}) AS episodes FROM (SELECT *, lag(t) OVER (PARTITION BY horizon ORDER BY t) AS p FROM pos) GROUP BY 1),
g AS (SELECT horizon, count(*) AS n_rows, count(*) FILTER (label) AS positives, count(*) FILTER (NOT label) AS negatives FROM lab GROUP BY 1)
SELECT v.h AS horizon, coalesce(n_rows, 0) AS n_rows, coalesce(positives, 0) AS positives, coalesce(negatives, 0) AS negatives, coalesce(episodes, 0) AS episodes, CASE WHEN coalesce(n_rows, 0) < 100 THEN 'TOO_FEW_ROWS' WHEN positives < 10 THEN 'TOO_FEW_POSITIVES' WHEN negatives < 10 THEN 'TOO_FEW_NEGATIVES' WHEN coalesce(episodes, 0) < 5 THEN 'TOO_FEW_EPISODES' ELSE 'FEASIBLE' END AS verdict
FROM (VALUES {', '.join(f'({h})' for h in (*HORIZONS, 999))}) v(h) LEFT JOIN g ON g.horizon = v.h LEFT JOIN ep ON ep.horizon = v.h""")
def feasibility_gate(spark, sf_dir):
    lab = labels.horizon_labels(observations(spark, sf_dir), cuts(spark, sf_dir).where("threshold_type = 'HIGH'"), HORIZONS)
    rows = lab.select("sensor", F.col("origin_us").alias("t"), "horizon", F.col("exceeds").alias("label"))
    return readiness.feasibility(rows, (*HORIZONS, 999), 100, 10, 10, 5)


PART = f"CASE WHEN t <= {SPLIT[0]} THEN CASE WHEN t <= {SPLIT[0] - 120 * US} THEN 'train' ELSE 'purged' END WHEN t <= {SPLIT[1]} THEN CASE WHEN t <= {SPLIT[1] - 120 * US} THEN 'validation' ELSE 'purged' END ELSE 'test' END"


@_query(f'SELECT {PART} AS part, count(*) AS n, min(t) AS "first", max(t) AS "last", true AS in_order FROM obs GROUP BY 1')
def split_report(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("part", labels.chronological_split(F.col("t"), *SPLIT))
    return readiness.split_report(rows, "part", "t")


@_query("SELECT place, t FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k, count(*) OVER () AS n FROM obs), (VALUES (1), (2)) v(place) WHERE k = CASE place WHEN 1 THEN n * 2 // 3 ELSE n * 5 // 6 END")
def split_boundaries(spark, sf_dir):
    found = readiness.boundaries(observations(spark, sf_dir), "t")
    return spark.createDataFrame(list(enumerate(found, 1)), "place int, t bigint")


@_query("SELECT event_id, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN coalesce(a >= 100, false) OR coalesce(b >= 5, false) THEN 1 ELSE 0 END AS label FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS a, CASE WHEN event_id % 4 <> 0 THEN user_id % 9 END AS b FROM events)")
def rule_classifier(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 9).alias("b"))
    return e.select("event_id", readiness.rule_label([(F.col("a"), 100), (F.col("b"), 5)]).alias("label"))


@_query(f""", lab AS (SELECT a.sensor, b.value IS NOT NULL AS known FROM obs a LEFT JOIN obs b ON b.usable AND b.sensor = a.sensor AND b.t = a.t + {120 * US} WHERE a.usable) SELECT count(*) FILTER (known) AS kept, count(*) FILTER (NOT known) AS missing FROM lab""")
def label_extraction(spark, sf_dir):
    lab = labels.horizon_labels(observations(spark, sf_dir), cuts(spark, sf_dir).where("threshold_type = 'LOW'"), HORIZONS)
    return readiness.horizon_labels(lab, 120)[1]


@_query(f""", f AS (SELECT sensor, avg(value) AS m, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1.0 END AS s FROM obs WHERE usable AND t <= {SPLIT[0]} AND sensor <> 'view' GROUP BY 1) SELECT o.sensor, o.t, round((o.value - f.m) / f.s, 6) + 0.0 AS scaled FROM obs o LEFT JOIN f USING (sensor)""")
def station_scaling(spark, sf_dir):
    o = observations(spark, sf_dir)
    fitted = readiness.fit_scalers(o.where(F.col("usable") & (F.col("t") <= SPLIT[0]) & (F.col("sensor") != "view")), "sensor", "value")
    return readiness.scale(o, fitted, "sensor", "value").select("sensor", "t", "scaled")


@_query(f""", tr AS (SELECT value AS a, CASE WHEN usable THEN t % 1000003 END::DOUBLE AS b FROM obs WHERE t <= {SPLIT[0]}), md AS (SELECT median(a) AS ma, median(b) AS mb FROM tr), ft AS (SELECT md.ma, md.mb, round(avg(coalesce(a, ma)), 6) AS aa, round(stddev_pop(coalesce(a, ma)), 6) AS sa, round(avg(coalesce(b, mb)), 6) AS ab, round(stddev_pop(coalesce(b, mb)), 6) AS sb FROM tr, md GROUP BY ma, mb)
SELECT sensor, t, round((value - aa) / sa, 6) + 0.0 AS a, round((coalesce(CASE WHEN usable THEN t % 1000003 END, mb) - ab) / sb, 6) + 0.0 AS b FROM obs, ft""")
def imputed_features(spark, sf_dir):
    o = observations(spark, sf_dir).select("sensor", "t", F.col("value").alias("a"), F.when(F.col("usable"), F.col("t") % 1000003).cast("double").alias("b"))
    fitted = labels.fit_preprocessor(o.where(F.col("t") <= SPLIT[0]), ["a", "b"])
    return readiness.impute_and_standardise(o, fitted, ["a", "b"])


@_query(f"""SELECT o.sensor, o.t, o.v AS rf_lag_60m, CASE WHEN x.usable THEN round(x.value, 6) END AS lag_60, y.e60, y.e120 FROM (SELECT sensor, t, value AS v FROM obs WHERE usable) o LEFT JOIN obs x ON x.sensor = o.sensor AND x.t = o.t - {60 * US}
LEFT JOIN (SELECT a.sensor, a.t, bool_or(b.value >= 120) FILTER (h = 60) AS e60, bool_or(b.value >= 120) FILTER (h = 120) AS e120 FROM obs a, (VALUES (60), (120)) v(h), obs b WHERE a.usable AND b.usable AND b.sensor = a.sensor AND b.t = a.t + h * {US}::BIGINT GROUP BY 1, 2) y ON y.sensor = o.sensor AND y.t = o.t""".replace("o.v AS rf_lag_60m, ", ""))
def features_with_labels(spark, sf_dir):
    o = observations(spark, sf_dir)
    feats = windows.lags(o, (60,), prefix="lag").select("sensor", "t", F.col("lag_60m").alias("lag_60"))
    lab = labels.horizon_labels(o, cuts(spark, sf_dir).where("threshold_type = 'HIGH'"), (60, 120))
    wide = labels.wide_labels(lab, (60, 120)).select("sensor", F.col("origin_us").alias("t"), F.col("60").alias("e60"), F.col("120").alias("e120"))
    return feats.join(wide, ["sensor", "t"], "left")


@_query("SELECT x.sensor, x.t FROM obs x WHERE x.t % 10800000000 = 0")
def on_grid_rows(spark, sf_dir):
    return observations(spark, sf_dir).where(contracts.on_grid(F.col("t"), 180)).select("sensor", "t")


@_query(f"""SELECT horizon, sensor, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) + 0.0 AS bias FROM (SELECT h AS horizon, a.sensor, a.value - b.value AS e FROM obs a, (VALUES (60), (120)) v(h), obs b WHERE a.usable AND b.usable AND b.sensor = a.sensor AND b.t = a.t + h * {US}::BIGINT) GROUP BY 1, 2""")
def persistence_scores(spark, sf_dir):
    return statistics.station_errors(statistics.persistence_pairs(observations(spark, sf_dir), (60, 120)), ["horizon", "sensor"])


@_query(f"""SELECT horizon, sum(n)::BIGINT AS n, round(sum(n * mae) / sum(n), 6) AS mae, round(avg(rmse), 6) AS mean_station_rmse FROM (SELECT h AS horizon, a.sensor, count(*) AS n, avg(abs(a.value - b.value)) AS mae, sqrt(avg((a.value - b.value) * (a.value - b.value))) AS rmse FROM obs a, (VALUES (60), (120)) v(h), obs b WHERE a.usable AND b.usable AND b.sensor = a.sensor AND b.t = a.t + h * {US}::BIGINT GROUP BY 1, 2) GROUP BY 1""")
def persistence_overall(spark, sf_dir):
    return statistics.overall_errors(statistics.persistence_pairs(observations(spark, sf_dir), (60, 120)), ["horizon"], "sensor")


_SHIFTED = BRIDGED.replace("SELECT sensor, t, value", f"SELECT sensor, t + CASE WHEN sensor = 'view' AND (t // {HOUR * US}) % 97 = 5 THEN {7 * US} ELSE 0 END AS t, value").replace(f"t // {6 * HOUR * US} AS b", f"t // {6 * HOUR * US} AS b, t AS slot", 1)


def shifted(spark, sf_dir):
    """Captured rows of which some lie off the grid, and the instants that only listings have: those of the captures that were left out, every fourth hour."""
    o, hour = observations(spark, sf_dir), F.col("t") / (HOUR * US)
    rows = captured(spark, sf_dir).withColumn("t", F.col("t") + F.when((F.col("sensor") == "view") & (hour % 97 == 5), 7 * US).otherwise(0))
    return rows, o.where(F.floor(F.col("t") / (6 * HOUR * US)) % 5 == 2).where(hour % 4 == 1).select("sensor", "t")


_LISTED = f""", li AS (SELECT sensor, t FROM obs WHERE (t // {6 * HOUR * US}) % 5 = 2 AND (t // {HOUR * US}) % 4 = 1),
wf AS (SELECT sensor, win, min(t) AS start_us, max(t) AS end_us, count(*) AS source_rows, count(*) FILTER (usable) AS source_usable, count(*) FILTER (t % {HOUR * US} <> 0) AS off_grid_rows FROM c3 GROUP BY 1, 2)
"""


@_query(_SHIFTED + _LISTED + """SELECT sensor, win AS "window", start_us, end_us, source_rows, source_usable, off_grid_rows, (SELECT count(*) FROM li WHERE li.sensor = wf.sensor AND li.t BETWEEN start_us AND end_us) AS listing_only_rows, CASE WHEN off_grid_rows > 0 THEN 'CADENCE_OFF_GRID' ELSE 'CADENCE_VERIFIED' END AS cadence_status FROM wf""")
def window_facts(spark, sf_dir):
    rows, listed = shifted(spark, sf_dir)
    return missingness.window_facts(missingness.capture_windows(rows, 24 * HOUR, 24 * HOUR), rows, HOUR, listed)


@_query(_SHIFTED + _LISTED + f"""SELECT sl.sensor, sl.win AS "window", sl.t, coalesce(c.state, CASE WHEN li.t IS NOT NULL THEN 'LISTING_ONLY_SLOT' ELSE 'ABSENT_SLOT' END) AS state FROM (SELECT wf.sensor, wf.win, g.t FROM wf, LATERAL (SELECT unnest(generate_series(start_us, end_us, {HOUR * US})) AS t) g WHERE off_grid_rows = 0) sl LEFT JOIN cap c ON c.sensor = sl.sensor AND c.t = sl.t LEFT JOIN li ON li.sensor = sl.sensor AND li.t = sl.t""")
def listing_only_slots(spark, sf_dir):
    rows, listed = shifted(spark, sf_dir)
    return missingness.window_slots(missingness.capture_windows(rows, 24 * HOUR, 24 * HOUR), rows, HOUR, listed)
