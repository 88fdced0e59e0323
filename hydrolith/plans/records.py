"""Queries of unit validation, canonical rows, contracts and checks over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import core
from hydrolith.operators import canonical, contracts, quality, units
from hydrolith.plans.catalog import HOUR, US, _query, table

POLICIES = [
    ("jps", "rain", r"Hujan \((.*)\)", "RAINFALL_INTERVAL", "mm", True, "rainfall", None, None),
    ("jps", "rain", "Nota", None, None, None, None, None, "free text"),
    ("jps", "level", "Aras", "WATER_LEVEL", "m", False, "water_level", None, None),
    ("jps", "level", "Waspada", "WATER_LEVEL_THRESHOLD", "m", False, "water_level", "WASPADA", None),
]


def raw_records(spark, sf_dir):
    """Raw records made of events: labels with and without units, markers, thresholds, odd sensor types."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    label = F.element_at(F.array(*map(F.lit, ("Hujan (mm)", "Hujan (m)", "Hujan ()", "Hujan (in)", "Lain"))), (F.col("event_id") % 5 + 1).cast("int"))
    rain = F.col("event_type") == "view"
    raw = F.when(F.col("event_id") % 13 == 0, "-9999.0").when(F.col("event_id") % 13 == 1, " ").when(F.col("event_id") % 13 == 2, "1,2").otherwise((F.col("event_id") % 1000).cast("string"))
    return e.select(
        "event_id",
        F.lit("jps").alias("source"),
        F.when(rain, "rain").otherwise("level").alias("dataset"),
        F.when(rain & (F.col("event_id") % 11 != 0), "rainfall").otherwise("water_level").alias("sensor_type"),
        F.when(rain, label).otherwise("Aras").alias("value_field"),
        raw.alias("value_raw"),
        F.when(F.col("event_id") % 7 == 0, "m").when(F.col("event_id") % 7 == 1, " mm ").alias("unit"),
        F.when(~rain & (F.col("event_id") % 3 == 0), F.create_map(F.lit("Waspada"), F.lit("2.5"), F.lit("Lama"), F.lit("1"))).alias("thresholds"),
        F.create_map(F.lit("Nota"), F.lit("9"), F.lit("Waspada"), F.lit("8")).alias("source_fields"),
    )


@_query("""WITH r AS (SELECT event_id, event_type = 'view' AS rain, CASE WHEN event_type = 'view' AND event_id % 11 <> 0 THEN 'rainfall' ELSE 'water_level' END AS st,
  CASE WHEN event_type = 'view' THEN ['Hujan (mm)', 'Hujan (m)', 'Hujan ()', 'Hujan (in)', 'Lain'][event_id % 5 + 1] ELSE 'Aras' END AS vf,
  CASE event_id % 13 WHEN 0 THEN '-9999.0' WHEN 1 THEN ' ' WHEN 2 THEN '1,2' ELSE (event_id % 1000)::VARCHAR END AS raw, CASE event_id % 7 WHEN 0 THEN 'm' WHEN 1 THEN 'mm' END AS unit
  FROM events WHERE event_type IN ('view', 'click')),
f AS (SELECT event_id, rain, st, vf AS field, 'PRIMARY_VALUE' AS role, raw, unit FROM r
  UNION ALL SELECT event_id, rain, st, 'Waspada', 'THRESHOLD', '2.5', NULL FROM r WHERE NOT rain AND event_id % 3 = 0
  UNION ALL SELECT event_id, rain, st, 'Lama', 'THRESHOLD', '1', NULL FROM r WHERE NOT rain AND event_id % 3 = 0
  UNION ALL SELECT event_id, rain, st, 'Waspada', 'SOURCE_FIELD', '8', NULL FROM r WHERE NOT rain AND event_id % 3 <> 0
  UNION ALL SELECT event_id, rain, st, 'Nota', 'SOURCE_FIELD', '9', NULL FROM r WHERE rain),
s AS (SELECT *, nullif(regexp_extract(field, '^Hujan \\((.*)\\)$', 1), '') AS lu, CASE WHEN field IN ('Lain', 'Lama') THEN 'none' WHEN field = 'Nota' THEN 'excluded' ELSE 'ok' END AS p FROM f),
t AS (SELECT *, CASE WHEN p <> 'ok' THEN 'UNKNOWN_MEASUREMENT_SEMANTICS' WHEN rain <> (st = 'rainfall') THEN 'SENSOR_TYPE_MISMATCH' WHEN rain AND lu IS NULL THEN 'MISSING_UNIT'
  WHEN rain AND lu <> 'mm' THEN CASE WHEN lu = 'm' THEN 'UNIT_MISMATCH' ELSE 'UNKNOWN_UNIT' END WHEN unit <> (CASE WHEN rain THEN 'mm' ELSE 'm' END) THEN 'UNIT_MISMATCH' ELSE 'VALID' END AS unit_status FROM s)
SELECT event_id, field, role, unit_status, CASE WHEN raw = '-9999.0' THEN 'SOURCE_MARKER' WHEN trim(raw) = '' THEN 'EMPTY' WHEN raw = '1,2' THEN 'NON_NUMERIC' ELSE 'NUMERIC' END AS value_parse_status,
  CASE WHEN unit_status = 'VALID' AND raw <> '-9999.0' THEN try_cast(raw AS DOUBLE) END AS parsed_value,
  CASE WHEN p = 'ok' THEN CASE WHEN rain THEN 'RAINFALL_INTERVAL' WHEN field = 'Aras' THEN 'WATER_LEVEL' ELSE 'WATER_LEVEL_THRESHOLD' END END AS measurement_type, CASE WHEN p = 'ok' AND field = 'Waspada' THEN 'WASPADA' END AS threshold_category,
  CASE WHEN p = 'none' THEN 'field not in the unit policy' WHEN p = 'excluded' THEN 'excluded: free text' WHEN unit_status = 'SENSOR_TYPE_MISMATCH' THEN CASE WHEN rain THEN 'RAINFALL_INTERVAL expects sensor rainfall' WHEN field = 'Aras' THEN 'WATER_LEVEL expects sensor water_level' ELSE 'WATER_LEVEL_THRESHOLD expects sensor water_level' END || ', record has ' || st
    WHEN unit_status = 'MISSING_UNIT' THEN 'field label carries no unit' WHEN unit_status <> 'VALID' THEN CASE WHEN rain AND lu <> 'mm' THEN 'label unit ''' || lu ELSE 'raw record unit ''' || CASE WHEN unit = 'mm' THEN ' mm ' ELSE unit END END || CASE WHEN unit_status = 'UNKNOWN_UNIT' THEN ''' is not an accepted unit' ELSE ''' is not ''' || CASE WHEN rain THEN 'mm' ELSE 'm' END || '''' END END AS reason,
  CASE WHEN p = 'ok' THEN CASE WHEN rain THEN 'IN_PAYLOAD' ELSE 'OFFICIAL_UI_OR_DOCS' END END AS unit_provenance, CASE WHEN p = 'ok' THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS semantics_status, CASE WHEN role = 'THRESHOLD' THEN 'CURRENT' END AS threshold_temporal_scope
FROM t""")
def unit_validation(spark, sf_dir):
    fields = units.record_fields(raw_records(spark, sf_dir).withColumn("threshold_temporal_scope", F.lit("CURRENT")), units.policy_table(spark, POLICIES))
    return units.validate_units(fields).select("event_id", "field", "role", "unit_status", "value_parse_status", "parsed_value", "measurement_type", "threshold_category", "reason", "unit_provenance", "semantics_status", "threshold_temporal_scope")


@_query("""WITH p AS (SELECT 'jps' AS source, p_brand AS dataset, p_type || ' ' || p_size % 5 AS field, CASE WHEN p_partkey % 7 <> 3 THEN 'WATER_LEVEL' END AS mt, CASE p_partkey % 4 WHEN 0 THEN 'ft' WHEN 1 THEN 'mm' ELSE 'm' END AS unit, p_partkey % 9 = 2 AS ex FROM part)
SELECT source, dataset, field, 'REPEATED_FIELD' AS problem FROM p GROUP BY 1, 2, 3 HAVING count(*) > 1
UNION ALL SELECT source, dataset, field, CASE WHEN NOT ex AND mt IS NULL THEN 'NO_MEASUREMENT_TYPE' WHEN NOT ex AND unit = 'ft' THEN 'UNKNOWN_UNIT' ELSE 'EXCLUDED_WITH_TYPE' END FROM p WHERE (NOT ex AND (mt IS NULL OR unit = 'ft')) OR (ex AND mt IS NOT NULL)""")
def policy_registry(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    policies = table(spark, sf_dir, "part").select(
        F.lit("jps").alias("source"), F.col("p_brand").alias("dataset"), F.concat_ws(" ", "p_type", (size % 5).cast("string")).alias("field"), F.when(key % 7 != 3, "WATER_LEVEL").alias("measurement_type"),
        F.when(key % 4 == 0, "ft").when(key % 4 == 1, "mm").otherwise("m").alias("canonical_unit"), F.when(key % 9 == 2, "why").alias("excluded_reason"),
    )
    return units.policy_problems(policies)


@_query("""SELECT c_custkey, round(try_cast(nullif(trim(x), '') AS DOUBLE), 6) AS lon, round(try_cast(nullif(trim(y), '') AS DOUBLE), 6) AS lat
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'x' ELSE ' ' || c_custkey || '.1234567 ' END AS x, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '5.5' END AS y FROM customer)""")
def spatial_features(spark, sf_dir):
    key = F.col("c_custkey")
    x = F.when(key % 4 == 0, " ").when(key % 4 == 1, "x").otherwise(F.concat(F.lit(" "), key.cast("string"), F.lit(".1234567 ")))
    lon, lat = units.spatial(x, F.when(key % 5 != 0, "5.5"))
    return table(spark, sf_dir, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))


KEY = ["source", "sensor_id", "measurement_type", "t"]
QUALITY = """WITH q AS (SELECT *, CASE WHEN raw = '' THEN 'EMPTY' WHEN raw = 'ERROR' THEN 'SOURCE_MARKER' ELSE 'NUMERIC' END AS st FROM (
  SELECT event_type AS sensor_id, CASE WHEN event_type IN ('view', 'click') THEN 'RAINFALL_INTERVAL' ELSE 'WATER_LEVEL' END AS mt, epoch_us(date_trunc('hour', ts)) AS t, 'b' || (user_id % 4) AS batch, event_id AS row,
    CASE WHEN event_id % 2 = 0 THEN 'x_history' ELSE 'x_listing' END AS dataset, epoch_us(ts) AS r, CASE WHEN event_id % 50 = 0 THEN 'ERROR' WHEN event_id % 51 = 0 THEN '' ELSE round(value / 100)::BIGINT::VARCHAR END AS raw, event_id FROM events)),
g AS (SELECT sensor_id, mt, t, count(*) AS n, min(r) AS first_retrieved_us, list_sort(list_distinct(list(CASE WHEN st = 'NUMERIC' THEN 'NUMERIC:' || raw || '.0' ELSE st || ':' || raw END))) AS sigs, list_sort(list_distinct(list(dataset))) AS ds,
    string_agg(batch || '/' || row, ',' ORDER BY r, batch, row) AS prov, first(raw ORDER BY r, batch, row) AS fr, first(st ORDER BY r, batch, row) AS fst, bool_or(st = 'EMPTY') AS fe, bool_or(st = 'SOURCE_MARKER') AS fm, bool_or(event_id % 3 = 0) AS tz
  FROM q WHERE event_id % 17 <> 0 GROUP BY 1, 2, 3),
canon AS (SELECT *, len(sigs) > 1 AS c, CASE WHEN len(sigs) = 1 AND fst = 'NUMERIC' THEN fr::DOUBLE END AS value,
    list_sort(list_filter([CASE WHEN len(sigs) > 1 THEN 'DUPLICATE_CONFLICT' WHEN n > 1 THEN 'DUPLICATE_IDENTICAL' END, CASE WHEN fe THEN 'VALUE_EMPTY' END, CASE WHEN fm THEN 'VALUE_MISSING_MARKER' END, CASE WHEN tz THEN 'TIMEZONE_ASSUMED' END], lambda x: x IS NOT NULL)) AS flags FROM g)
"""


def quality_rows(spark, sf_dir):
    """Quality rows made of events: repeats within an hour, markers, flags, and some that are excluded."""
    e = table(spark, sf_dir, "events").withColumn("us", core.micros(F.col("ts")))
    number = F.col("event_id")
    raw = F.when(number % 50 == 0, "ERROR").when(number % 51 == 0, "").otherwise(F.round(F.col("value") / 100).cast("bigint").cast("string"))
    status = core.value_status(F.col("value_raw"))
    flags = F.array_compact(F.array(F.when(number % 3 == 0, "TIMEZONE_ASSUMED"), F.when(status == "EMPTY", "VALUE_EMPTY"), F.when(status == "SOURCE_MARKER", "VALUE_MISSING_MARKER")))
    kind = F.when(F.col("event_type").isin("view", "click"), "RAINFALL_INTERVAL").otherwise("WATER_LEVEL")
    return e.withColumn("value_raw", raw).select(
        F.lit("jps").alias("source"), F.col("event_type").alias("sensor_id"), kind.alias("measurement_type"), core.floor_to(F.col("us"), HOUR).alias("t"),
        F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("batch"), number.alias("row"), F.lit("v").alias("field"), F.when(number % 2 == 0, "x_history").otherwise("x_listing").alias("dataset"), F.lit("0").alias("sha"),
        F.col("us").alias("retrieved_us"), "value_raw", core.parsed_value(F.col("value_raw")).alias("parsed_value"), status.alias("parse_status"), flags.alias("quality_flags"), F.when(number % 17 == 0, "FUTURE").alias("excluded"),
    )


@_query(QUALITY + """SELECT sensor_id, mt AS measurement_type, t, value, array_to_string(flags, ',') AS flags, value IS NOT NULL AND len(list_filter(flags, lambda x: x NOT IN ('TIMEZONE_ASSUMED', 'DUPLICATE_IDENTICAL'))) = 0 AS usable,
  CASE WHEN c THEN 'CONFLICT' WHEN n > 1 THEN 'IDENTICAL' ELSE 'UNIQUE' END AS duplicate_status, n AS duplicate_count, CASE WHEN c THEN array_to_string(sigs, '|') ELSE '' END AS clash, array_to_string(ds, ',') AS datasets, first_retrieved_us, prov AS captures,
  CASE WHEN c THEN CASE WHEN len(list_filter(sigs, lambda s: s LIKE 'NUMERIC:%')) = len(sigs) THEN 'NUMERIC_VALUES_DIFFER' WHEN len(list_filter(sigs, lambda s: s LIKE 'NUMERIC:%')) > 0 THEN 'MARKER_VS_NUMERIC' ELSE 'MARKERS_DIFFER' END END AS conflict_reason FROM canon""")
def canonical_rows(spark, sf_dir):
    rows = canonical.observations(quality_rows(spark, sf_dir), KEY)
    captures = F.array_join(F.transform("provenance", lambda p: F.concat_ws("/", p["batch"], p["row"].cast("string"))), ",")
    return rows.select(
        "sensor_id", "measurement_type", "t", "value", F.array_join("quality_flags", ",").alias("flags"), "usable", "duplicate_status", F.col("duplicate_count").cast("bigint").alias("duplicate_count"),
        F.array_join("conflicting_values", "|").alias("clash"), F.array_join("datasets", ",").alias("datasets"), "first_retrieved_us", captures.alias("captures"), "conflict_reason",
    )


def checked_rows(spark, sf_dir):
    """Canonical rows with planted defects, for the checks."""
    rows = canonical.observations(quality_rows(spark, sf_dir), KEY).withColumn("h", (F.col("t") / (HOUR * US)).cast("bigint"))
    hit = lambda k: F.col("h") % k == 0
    unit = F.when(F.col("measurement_type") == "WATER_LEVEL", "m").otherwise("mm")
    zone = F.when(hit(31), None).otherwise(F.when(F.array_contains("quality_flags", "TIMEZONE_ASSUMED") | hit(37), "UNSPECIFIED_ASSUMED").otherwise("KNOWN"))
    return rows.where(~hit(41)).withColumns({
        "unit": F.when(hit(11), "ft").otherwise(unit), "site_id": F.when(hit(13), "").otherwise("s"), "value": F.when(hit(19) & F.col("value").isNotNull(), -F.col("value")).otherwise(F.col("value")), "timezone_status": zone,
        "first_retrieved_us": F.when(hit(23), F.col("t") - HOUR * US).otherwise(F.col("first_retrieved_us")), "duplicate_count": F.when(hit(29), 9).otherwise(F.col("duplicate_count")),
        "row_no": F.when(hit(43), F.col("h") * 10 - 5000).otherwise(F.col("h") * 10) + F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("sensor_id")) * 1_000_000_000,
    })


@_query(QUALITY + f""", o AS (SELECT *, t // {HOUR * US} AS h, n AS dn, CASE WHEN (t // {HOUR * US}) % 19 = 0 THEN -value ELSE value END AS v FROM canon WHERE (t // {HOUR * US}) % 41 <> 0),
p AS (SELECT *, (CASE WHEN h % 43 = 0 THEN h * 10 - 5000 ELSE h * 10 END) + list_position(['click', 'error', 'purchase', 'signup', 'view'], sensor_id)::BIGINT * 1000000000 AS row_no, mt = 'RAINFALL_INTERVAL' AS rain,
  value IS NOT NULL AND len(list_filter(flags, lambda x: x NOT IN ('TIMEZONE_ASSUMED', 'DUPLICATE_IDENTICAL'))) = 0 AS usable, list_contains(flags, 'VALUE_EMPTY') OR list_contains(flags, 'VALUE_MISSING_MARKER') AS miss FROM o),
w AS (SELECT *, row(mt, t, sensor_id) AS k, lag(row(sensor_id, mt, t)) OVER (ORDER BY row_no) AS before FROM p),
c AS (SELECT 'canonical_key_unique' AS name, 0 AS failing
  UNION ALL SELECT 'chronological_order', count(*) FILTER (row(sensor_id, mt, t) <= before) FROM w
  UNION ALL SELECT 'no_row_lost', sum(n) FROM canon WHERE (t // {HOUR * US}) % 41 = 0
  UNION ALL SELECT 'verified_measurement_types_only', 0 UNION ALL SELECT 'unit_matches_measurement_type', count(*) FROM p WHERE h % 11 = 0 UNION ALL SELECT 'identity_complete', count(*) FROM p WHERE h % 13 = 0
  UNION ALL SELECT 'value_matches_status_and_flags', count(*) FILTER (CASE WHEN v IS NULL THEN NOT (miss OR c) ELSE miss END) FROM p
  UNION ALL SELECT 'zero_is_not_missing', count(*) FILTER (v = 0 AND miss) FROM p UNION ALL SELECT 'usable_matches_flags', 0 UNION ALL SELECT 'no_future_observation', count(*) FROM p WHERE h % 23 = 0
  UNION ALL SELECT 'timezone_assumption_marked', count(*) FROM p WHERE h % 31 = 0 OR (h % 37 = 0 AND NOT list_contains(flags, 'TIMEZONE_ASSUMED')) UNION ALL SELECT 'provenance_complete', count(*) FROM p WHERE h % 29 = 0 AND n <> 9
  UNION ALL SELECT 'conflicts_unresolved', 0 UNION ALL SELECT 'usable_rainfall_non_negative', count(*) FILTER (usable AND rain AND v < 0) FROM p UNION ALL SELECT 'quality_flags_known', 0)
SELECT name, coalesce(failing, 0) = 0 AS passed, coalesce(failing, 0)::BIGINT AS failing FROM c""")
def dataset_checks(spark, sf_dir):
    return contracts.dataset_checks(checked_rows(spark, sf_dir), quality_rows(spark, sf_dir))


@_query(f"""WITH r AS (SELECT event_id, event_type AS sensor_id, CASE WHEN event_id % 19 = 0 THEN 'SNOW' WHEN event_type IN ('view', 'click') THEN 'RAINFALL_INTERVAL' ELSE 'WATER_LEVEL' END AS mt, epoch_us(date_trunc('minute', ts)) AS t, value FROM events),
v AS (SELECT *, CASE WHEN mt = 'SNOW' THEN 'UNKNOWN_MEASUREMENT_TYPE' WHEN mt <> 'RAINFALL_INTERVAL' THEN NULL WHEN event_id % 7 = 0 THEN 'WRONG_UNIT' WHEN event_id % 11 = 0 THEN 'WRONG_SENSOR_TYPE' WHEN event_id % 13 = 0 THEN 'MISSING_IDENTITY' WHEN event_id % 17 = 0 THEN 'WRONG_TIME_ZONE'
  WHEN value < 20 THEN 'INVALID_USABLE_VALUE' END AS violation, count(*) OVER (PARTITION BY mt, CASE WHEN event_id % 13 = 0 THEN '' ELSE sensor_id END, t) AS again FROM r)
SELECT event_id, coalesce(violation, 'REPEATED_KEY') AS violation FROM v WHERE violation IS NOT NULL OR (mt = 'RAINFALL_INTERVAL' AND again > 1)""")
def measurement_contract(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", core.floor_to(core.micros(F.col("ts")), 1))
    n = F.col("event_id")
    kind = F.when(n % 19 == 0, "SNOW").when(F.col("event_type").isin("view", "click"), "RAINFALL_INTERVAL").otherwise("WATER_LEVEL")
    rows = e.select(
        "event_id", F.when(n % 13 != 0, F.col("event_type")).otherwise("").alias("sensor_id"), kind.alias("measurement_type"), "t", "value", F.lit(True).alias("usable"), F.when(n % 7 == 0, "cm").otherwise("mm").alias("unit"),
        F.when(n % 11 == 0, "water_level").otherwise("rainfall").alias("sensor_type"), (F.col("t") + F.when(n % 17 == 0, 60).otherwise(480).cast("bigint") * US).alias("local_us"),
    )
    return contracts.measurement_violations(rows, "RAINFALL_INTERVAL", value_ok=F.col("value") >= 20).select("event_id", "violation")


@_query("""SELECT event_id, violation, state FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NO_PROVENANCE' WHEN event_id % 11 = 0 THEN 'PROVENANCE_WITHOUT_BATCH' WHEN event_id % 13 = 0 THEN 'UNKNOWN_DATASET'
  WHEN value <= 200 AND event_id % 5 = 0 THEN 'USABLE_WITH_BLOCKING_FLAG' WHEN value > 200 AND event_id % 5 <> 0 THEN 'UNUSABLE_WITHOUT_FLAG' END AS violation,
  CASE WHEN value <= 200 THEN 'USABLE' WHEN event_id % 5 = 0 AND event_id % 2 = 0 THEN 'CONFLICT' WHEN event_id % 5 = 0 THEN 'EMPTY_VALUE' ELSE 'OTHER_NOT_USABLE' END AS state FROM events) WHERE violation IS NOT NULL""")
def row_contract(spark, sf_dir):
    n = F.col("event_id")
    flags = F.when(n % 5 == 0, F.when(n % 2 == 0, F.array(F.lit("VALUE_EMPTY"), F.lit("DUPLICATE_CONFLICT"))).otherwise(F.array(F.lit("VALUE_EMPTY")))).otherwise(F.array(F.lit("TIMEZONE_ASSUMED")))
    capture = F.struct(F.when(n % 13 == 0, "x_web").otherwise("x_history").alias("dataset"), F.when(n % 11 == 0, "").otherwise("b").alias("batch"))
    rows = table(spark, sf_dir, "events").select("event_id", flags.alias("quality_flags"), F.array(F.lit("x")).alias("datasets"), F.when(n % 7 == 0, F.array().cast("array<struct<dataset:string,batch:string>>")).otherwise(F.array(capture)).alias("provenance"), (F.col("value") <= 200).alias("usable"))
    return contracts.row_violations(rows).select("event_id", "violation", contracts.row_state().alias("state"))


@_query("""SELECT event_type, count(*) AS n_rows, count(*) FILTER (k <= p) AS out_of_order, count(*) - count(DISTINCT k) AS repeated FROM (SELECT *, lag(k) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM (SELECT event_type, event_id, epoch_us(date_trunc('minute', ts)) + CASE WHEN event_id % 97 = 0 THEN -86400000000 ELSE 0 END AS k FROM events)) GROUP BY 1""")
def monotonicity(spark, sf_dir):
    k = core.floor_to(core.micros(F.col("ts")), 1) + F.when(F.col("event_id") % 97 == 0, -86_400_000_000).otherwise(0)
    return contracts.disorder(table(spark, sf_dir, "events").select("event_type", "event_id", k.alias("k")), ["event_type"], "event_id", "k", block=64)


@_query("""SELECT k, CASE WHEN l IS NULL THEN 'MISSING_IN_orders' WHEN l > 1 THEN 'REPEATED_IN_orders' WHEN m IS NULL THEN 'MISSING_IN_lines' WHEN m > 1 THEN 'REPEATED_IN_lines' WHEN n IS NULL THEN 'MISSING_IN_parts' WHEN n > 1 THEN 'REPEATED_IN_parts' WHEN o IS NULL THEN 'MISSING_IN_supplies' ELSE 'REPEATED_IN_supplies' END AS problem
FROM (SELECT o_orderkey AS k, count(*) AS l FROM orders GROUP BY 1) FULL JOIN (SELECT l_orderkey AS k, count(*) AS m FROM lineitem WHERE l_linenumber < 3 GROUP BY 1) USING (k) FULL JOIN (SELECT p_partkey AS k, count(*) AS n FROM part GROUP BY 1) USING (k) FULL JOIN (SELECT s_suppkey AS k, count(*) AS o FROM supplier GROUP BY 1) USING (k)
WHERE NOT (coalesce(l, 0) = 1 AND coalesce(m, 0) = 1 AND coalesce(n, 0) = 1 AND coalesce(o, 0) = 1)""")
def four_layers(spark, sf_dir):
    key = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("k"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("k"))
    return canonical.layered({"orders": key("orders", "o_orderkey"), "lines": lines, "parts": key("part", "p_partkey"), "supplies": key("supplier", "s_suppkey")}, ["k"])[1]


def layers(spark, sf_dir):
    """(records, times, stations, units) made of events, by event_id as row of batches of a thousand."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    key = [F.floor(n / 1000).cast("bigint").alias("batch"), n.alias("row")]
    pick = lambda k, values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % k).cast("int") + 1)
    records = e.select(*key, F.concat(F.lit("s"), (n % 50).cast("string")).alias("sensor_id"), F.when(n % 2 == 0, "water_level_history").otherwise("rainfall_listing").alias("dataset"), F.when(n % 6 == 0, " ERROR ").alias("severity"), pick(19, [None] * 16 + ["MISSING_TIMESTAMP", "INVALID_ROW_STRUCTURE", "UNMAPPED_SENSOR"]).alias("quarantine_reason"))
    times = e.where(n % 23 != 0).select(*key, pick(9, ["VALID"] * 5 + ["AMBIGUOUS", "FUTURE", "INVALID_FORMAT", "VALID"]).alias("time_status"), F.when(n % 9 == 8, "DATE").otherwise("MINUTE").alias("time_precision"), F.when(n % 4 == 0, "UNSPECIFIED_ASSUMED").otherwise("EXPLICIT_IN_SOURCE").alias("timezone_status"))
    mapped = F.when(n % 29 == 0, "s_new").when(n % 11 < 9, F.concat(F.lit("s"), (n % 50).cast("string")))
    stations = e.where(n % 31 != 0).select(*key, F.concat(F.lit("s"), (n % 50).cast("string")).alias("raw_sensor_id"), pick(11, ["MAPPED"] * 9 + ["UNMAPPED", "SENSOR_TYPE_MISMATCH"]).alias("mapping_status"), mapped.alias("sensor_id"))
    raw = F.when(n % 13 == 0, "ERROR").when(n % 13 == 1, " ").when(n % 13 == 2, "-9999.0").when(n % 13 == 3, "-1.5").otherwise((n % 1000).cast("string"))
    primary = e.select(*key, F.lit("v").alias("field"), F.lit("PRIMARY_VALUE").alias("role"), raw.alias("value_raw"), F.when(n % 7 != 5, F.when(n % 2 == 0, "WATER_LEVEL").otherwise("RAINFALL_INTERVAL")).alias("measurement_type"), pick(7, ["VALID"] * 5 + ["UNKNOWN_MEASUREMENT_SEMANTICS", "UNIT_MISMATCH"]).alias("unit_status"))
    more = e.where(n % 5 == 0).select(*key, F.lit("w").alias("field"), F.lit("SOURCE_FIELD").alias("role"), F.lit("7").alias("value_raw"), F.when(n % 10 == 0, "WATER_LEVEL").alias("measurement_type"), F.lit("VALID").alias("unit_status"))
    status = core.value_status(F.col("value_raw"))
    units_ = primary.unionByName(more).withColumns({"value_parse_status": status, "parsed_value": F.when(F.col("unit_status") == "VALID", core.parsed_value(F.col("value_raw")))})
    return records, times, stations, units_


@_query("""WITH r AS (SELECT event_id AS n, CASE event_id % 19 WHEN 16 THEN 'MISSING_TIMESTAMP' WHEN 17 THEN 'INVALID_ROW_STRUCTURE' WHEN 18 THEN 'UNMAPPED_SENSOR' END AS q,
  CASE WHEN event_id % 23 <> 0 THEN CASE event_id % 9 WHEN 5 THEN 'AMBIGUOUS' WHEN 6 THEN 'FUTURE' WHEN 7 THEN 'INVALID_FORMAT' ELSE 'VALID' END END AS ts, event_id % 31 <> 0 AS has_s, CASE event_id % 11 WHEN 9 THEN 'UNMAPPED' WHEN 10 THEN 'SENSOR_TYPE_MISMATCH' ELSE 'MAPPED' END AS ms FROM events),
un AS (SELECT *, 'v' AS field, CASE n % 13 WHEN 0 THEN 'ERROR' WHEN 1 THEN ' ' WHEN 2 THEN '-9999.0' WHEN 3 THEN '-1.5' ELSE (n % 1000)::VARCHAR END AS raw, CASE WHEN n % 7 <> 5 THEN CASE WHEN n % 2 = 0 THEN 'WATER_LEVEL' ELSE 'RAINFALL_INTERVAL' END END AS mt, CASE n % 7 WHEN 5 THEN 'MEASUREMENT_SEMANTICS_UNKNOWN' WHEN 6 THEN 'UNIT_MISMATCH' END AS uf FROM r
  UNION ALL SELECT *, 'w', '7', 'WATER_LEVEL', NULL FROM r WHERE n % 10 = 0),
f AS (SELECT *, CASE WHEN uf IS NULL THEN try_cast(nullif(raw, '-9999.0') AS DOUBLE) END AS parsed_value, list_sort(list_distinct(list_filter([CASE WHEN q IS NOT NULL THEN 'RAW_QUARANTINED' END, CASE q WHEN 'MISSING_TIMESTAMP' THEN 'TIMESTAMP_MISSING' WHEN 'INVALID_ROW_STRUCTURE' THEN 'ROW_STRUCTURE_INVALID' END, CASE ts WHEN 'AMBIGUOUS' THEN 'TIMESTAMP_AMBIGUOUS' WHEN 'FUTURE' THEN 'TIMESTAMP_FUTURE' WHEN 'INVALID_FORMAT' THEN 'TIMESTAMP_INVALID_FORMAT' END,
  CASE WHEN ts IS NOT NULL AND n % 4 = 0 THEN 'TIMEZONE_ASSUMED' END, CASE WHEN ts IS NOT NULL AND n % 9 = 8 THEN 'TIMESTAMP_DATE_ONLY' END, CASE WHEN NOT has_s THEN 'NO_STATION_SENSOR' END, CASE WHEN has_s THEN CASE ms WHEN 'UNMAPPED' THEN 'SENSOR_UNMAPPED' WHEN 'SENSOR_TYPE_MISMATCH' THEN 'SENSOR_TYPE_MISMATCH' END END,
  CASE WHEN has_s AND (n % 29 = 0 OR n % 11 >= 9) THEN 'STATION_MASTER_CHANGED_SINCE_INGEST' END, CASE WHEN n % 6 = 0 THEN 'SOURCE_SEVERITY_ERROR' END, uf,
  CASE WHEN mt IS NOT NULL THEN CASE raw WHEN 'ERROR' THEN 'VALUE_SOURCE_ERROR' WHEN ' ' THEN 'VALUE_EMPTY' WHEN '-9999.0' THEN 'VALUE_MISSING_SENTINEL' WHEN '-1.5' THEN CASE WHEN mt = 'RAINFALL_INTERVAL' AND uf IS NULL THEN 'RAINFALL_NEGATIVE' END END END], lambda x: x IS NOT NULL))) AS fl FROM un)
SELECT n // 1000 AS batch, n AS row, field, mt AS measurement_type, parsed_value, CASE WHEN has_s THEN CASE WHEN n % 29 = 0 THEN 's_new' WHEN n % 11 < 9 THEN 's' || n % 50 END END AS sensor_id, CASE WHEN q IS NULL THEN 'records' ELSE 'quarantine' END AS raw_file, array_to_string(fl, ',') AS flags,
  parsed_value IS NOT NULL AND len(list_filter(fl, lambda x: x NOT IN ('TIMEZONE_ASSUMED', 'STATION_MASTER_CHANGED_SINCE_INGEST', 'SOURCE_SEVERITY_ERROR', 'DUPLICATE_IDENTICAL'))) = 0 AS usable FROM f""")
def quality_projection(spark, sf_dir):
    got = quality.quality_rows(*layers(spark, sf_dir), ["batch", "row"])
    return got.select("batch", "row", "field", "measurement_type", "parsed_value", "sensor_id", "raw_file", F.array_join("quality_flags", ",").alias("flags"), "usable")
