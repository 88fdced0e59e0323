"""Queries of ingestion, live polls, registry and discovery feeds over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import core
from hydrolith.operators import feeds, ingestion, registry
from hydrolith.plans.catalog import HOUR, US, _query, observations, table

NOTE = "CASE WHEN p_partkey % 5 = 0 THEN ' ' WHEN p_partkey % 5 = 1 THEN 'No Data' WHEN p_partkey % 5 = 2 THEN 'D' || (p_partkey % 40) ELSE ' d' || p_partkey || ' ' END"


def mapping(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.lit("jps").alias("source"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("station_id"), F.when(F.col("s_suppkey") % 2 == 0, "rainfall").otherwise("water_level").alias("sensor_type"), F.concat(F.lit("fg"), F.col("s_suppkey").cast("string")).alias("sensor_id"))


@_query("""WITH r AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN 's 1' WHEN 2 THEN 'zz' ELSE ' s' || (c_custkey % 70 + 1) || ' ' END AS station_id, CASE WHEN c_custkey % 3 = 0 THEN 'rainfall' ELSE 'water_level' END AS st FROM customer),
m AS (SELECT 's' || s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'rainfall' ELSE 'water_level' END AS mt, 'fg' || s_suppkey AS sensor_id FROM supplier)
SELECT c_custkey, CASE WHEN mt = st THEN sensor_id END AS sensor_id, CASE WHEN trim(station_id) = '' OR contains(trim(station_id), ' ') THEN 'INVALID_STATION_ID' WHEN k IS NULL THEN 'UNMAPPED_STATION' WHEN mt <> st THEN 'SENSOR_TYPE_MISMATCH' END AS quarantine FROM r LEFT JOIN m ON m.k = trim(station_id)""")
def station_resolution(spark, sf_dir):
    k = F.col("c_custkey")
    station = F.when(k % 9 == 0, " ").when(k % 9 == 1, "s 1").when(k % 9 == 2, "zz").otherwise(F.concat(F.lit(" s"), (k % 70 + 1).cast("string"), F.lit(" ")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("jps").alias("source"), station.alias("station_id"), F.when(k % 3 == 0, "rainfall").otherwise("water_level").alias("sensor_type"))
    return ingestion.resolve_stations(rows, mapping(spark, sf_dir)).select("c_custkey", "sensor_id", "quarantine")


def payloads(spark, sf_dir):
    """One payload for each customer: the station of a supplier and a number; some contents repeat, some succeeded before."""
    c = table(spark, sf_dir, "customer")
    content = F.concat_ws(",", F.concat(F.lit("s"), (F.col("c_custkey") % 120).cast("string")), (F.col("c_custkey") % 600).cast("string"))
    return c.select(F.lit("jps").alias("source"), F.lit("rain").alias("dataset"), F.when(F.col("c_custkey") % 2 == 0, "p").alias("partition"), F.format_string("b%08d", "c_custkey").alias("batch"), F.col("c_custkey").alias("retrieved_us"), content.alias("content"))


def ingested(spark, sf_dir):
    p = payloads(spark, sf_dir)
    done = p.where("retrieved_us % 11 = 0").select("source", "dataset", "partition", F.sha2(F.col("content").cast("binary"), 256).alias("payload_sha256"), F.lit("SUCCEEDED").alias("status"))

    def parse(new):
        part = F.split("content", ",")
        twice = F.explode(F.when(part[1].cast("int") % 3 == 0, F.array(part[1], part[1])).otherwise(F.array(part[1])))
        return new.select("batch", "source", part[0].alias("station_id"), F.lit("rainfall").alias("sensor_type"), twice.alias("value_raw"))

    return ingestion.ingest(p, done, parse, mapping(spark, sf_dir))


@_query("""WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'p' END AS part, 's' || (c_custkey % 120) || ',' || (c_custkey % 600) AS content FROM customer),
n AS (SELECT min(k) AS k, part, content FROM p WHERE NOT EXISTS (SELECT 1 FROM p d WHERE d.k % 11 = 0 AND d.content = p.content AND d.part IS NOT DISTINCT FROM p.part) GROUP BY part, content)
SELECT format('b{:08d}', k) AS batch, part AS "partition", sha256(content) AS payload_sha256, CASE WHEN k % 600 % 3 = 0 THEN 2 ELSE 1 END AS "rows", CASE WHEN k % 600 % 3 = 0 THEN 1 ELSE 0 END AS duplicates,
  CASE WHEN s_suppkey IS NULL OR s_suppkey % 2 = 1 THEN CASE WHEN k % 600 % 3 = 0 THEN 2 ELSE 1 END ELSE 0 END AS quarantined FROM n LEFT JOIN supplier ON s_suppkey = k % 120""")
def ingest_batches(spark, sf_dir):
    return ingested(spark, sf_dir)[1].select("batch", "partition", "payload_sha256", "rows", "duplicates", "quarantined")


@_query("""WITH m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'p' END AS part, sha256(('x' || c_custkey % 900)) AS sha, CASE WHEN c_custkey % 13 = 0 THEN 'DONE' WHEN c_custkey % 7 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, c_custkey % 17 = 0 AS bad FROM customer)
SELECT CASE WHEN bad THEN 'x' ELSE sha END AS payload_sha256, part AS "partition", CASE WHEN bad THEN 'BAD_DIGEST' ELSE 'UNKNOWN_STATUS' END AS problem FROM m WHERE bad OR status = 'DONE'
UNION ALL SELECT s, part, 'SUCCEEDED_TWICE' FROM (SELECT CASE WHEN bad THEN 'x' ELSE sha END AS s, part, count(*) AS n FROM m WHERE status = 'SUCCEEDED' GROUP BY 1, 2) WHERE n > 1""")
def manifest_problems(spark, sf_dir):
    return ingestion.manifest_problems(manifest(spark, sf_dir)).select("payload_sha256", "partition", "problem")


def manifest(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.lit("jps").alias("source"), F.lit("rain").alias("dataset"), F.when(k % 2 == 0, "p").alias("partition"), F.when(k % 17 == 0, "x").otherwise(F.sha2(F.concat(F.lit("x"), (k % 900).cast("string")).cast("binary"), 256)).alias("payload_sha256"),
        F.when(k % 13 == 0, "DONE").when(k % 7 == 0, "FAILED").otherwise("SUCCEEDED").alias("status"), F.concat(F.lit("b"), k.cast("string")).alias("batch"), k.alias("retrieved_us"), F.lit(1).alias("rows"), F.lit(0).alias("quarantined"), F.lit(0).alias("duplicates"),
    )


@_query("""SELECT CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE sha256('x' || c_custkey % 900) END AS payload_sha256, CASE WHEN c_custkey % 2 = 0 THEN 'p' END AS "partition", 'b' || min(c_custkey) AS batch FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 7 <> 0 GROUP BY 1, 2""")
def succeeded_batches(spark, sf_dir):
    return ingestion.succeeded(manifest(spark, sf_dir)).select("payload_sha256", "partition", "batch")


@_query("""SELECT c_custkey % 50 AS batch, count(*) AS "rows", count(*) - count(DISTINCT c_nationkey || '/' || c_mktsegment) AS duplicates FROM customer GROUP BY 1""")
def source_duplicates(spark, sf_dir):
    return ingestion.source_duplicates(table(spark, sf_dir, "customer").withColumn("batch", F.col("c_custkey") % 50), "batch", ["c_nationkey", "c_mktsegment"])


@_query("""SELECT o_orderkey, 'jps/' || CASE WHEN o_custkey % 2 = 0 THEN 'rain' ELSE 'level' END || CASE WHEN o_custkey % 3 = 0 THEN '/p' || (o_custkey % 5) ELSE '' END || '/' || strftime(o_orderdate, '%Y/%m/%d') AS folder FROM orders""")
def raw_folders(spark, sf_dir):
    k = F.col("o_custkey")
    part = F.when(k % 3 == 0, F.concat(F.lit("p"), (k % 5).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", ingestion.raw_folder(F.lit("jps"), F.when(k % 2 == 0, "rain").otherwise("level"), part, F.col("o_orderdate")).alias("folder"))


@_query("""SELECT page_id AS path, CASE WHEN page_id % 5 = 0 THEN 'NOT_IN_MANIFEST' ELSE 'DIGEST_DIFFERS' END AS problem FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0""")
def unverified_files(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("content"))
    named = files.where("path % 5 <> 0").select("path", F.when(F.col("path") % 7 == 0, "0").otherwise(F.sha2(F.col("content").cast("binary"), 256)).alias("payload_sha256"))
    return ingestion.verified(files, named)[1]


@_query(f"""WITH r AS (SELECT CASE user_id % 7 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'BLOCKED' ELSE 'SUCCEEDED' END AS status, event_id AS s, CASE WHEN event_id % 10 <> 0 THEN event_id + (user_id % 5) * {US} END AS e, user_id % 11 AS n FROM events)
SELECT count(*) AS poll_attempts, count(*) FILTER (e IS NOT NULL AND status = 'SUCCEEDED') AS successful_polls, count(*) FILTER (e IS NOT NULL AND status = 'FAILED') AS failed_polls, count(*) FILTER (e IS NOT NULL AND status = 'BLOCKED') AS blocked_polls, count(*) FILTER (e IS NULL) AS incomplete,
  sum(n)::BIGINT AS received, sum(n)::BIGINT AS inserted, sum(n)::BIGINT AS duplicates, sum(n)::BIGINT AS quarantined, round(avg((e - s) / {US}.0::DOUBLE), 6) AS mean_minutes, max(e) FILTER (status = 'SUCCEEDED') AS last_success_us FROM r""")
def run_metrics(spark, sf_dir):
    n, u = F.col("event_id"), F.col("user_id")
    runs = table(spark, sf_dir, "events").select(F.when(u % 7 == 0, "FAILED").when(u % 7 == 1, "BLOCKED").otherwise("SUCCEEDED").alias("status"), n.alias("started_us"), F.when(n % 10 != 0, n + (u % 5) * US).alias("ended_us"), *[(u % 11).alias(c) for c in ("received", "inserted", "duplicates", "quarantined")])
    return ingestion.run_metrics(runs)


@_query("""WITH o AS (SELECT s_suppkey AS k, s_acctbal::DOUBLE AS v FROM supplier WHERE s_suppkey % 3 = 0), n AS (SELECT s_suppkey % 80 AS k, min(s_acctbal::DOUBLE) AS v FROM supplier GROUP BY 1) SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)""")
def poll_merge(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    old = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").cast("double").alias("v"))
    return ingestion.merge_rows(old, s.select((F.col("s_suppkey") % 80).alias("k"), F.col("s_acctbal").cast("double").alias("v")), ["k"])


@_query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 10 END AS outcome, CASE WHEN s_suppkey % 4 = 0 THEN 'TIMEOUT' END AS failure FROM supplier""")
def poll_outcomes(spark, sf_dir):
    k = F.col("s_suppkey")
    return ingestion.each_target(table(spark, sf_dir, "supplier").select("s_suppkey"), k % 10, F.when(k % 4 == 0, "TIMEOUT"))


@_query(f"""SELECT sensor, t AS origin_us, h AS horizon, CASE WHEN h = 360 THEN 'SKIPPED_NO_ELIGIBLE_MODEL' ELSE 'SCORED' END AS status, CASE h WHEN 60 THEN 'b' WHEN 120 THEN 'c' END AS model FROM obs, (VALUES (60), (120), (360)) v(h) WHERE usable""")
def live_inference(spark, sf_dir):
    models = spark.createDataFrame([(60, 1, "a"), (60, 2, "b"), (120, 1, "c")], "horizon int, version int, model string")
    return ingestion.live_inference(observations(spark, sf_dir).where("usable").select("sensor", F.col("t").alias("origin_us")), models, (60, 120, 360))


@_query(f"""SELECT sha256(sensor || '/' || t || '/60/m') AS prediction_id, sensor, t AS origin_us, t + {HOUR * US} AS target_us, 60 AS horizon, 'm' AS model, value::DECIMAL(12, 4)::DOUBLE AS value, value >= 120 AS exceeds FROM obs WHERE usable""")
def stored_predictions(spark, sf_dir):
    rows = observations(spark, sf_dir).where("usable").select("sensor", F.col("t").alias("origin_us"), F.lit(60).alias("horizon"), F.lit("m").alias("model"), "value")
    return ingestion.predictions(rows, F.col("value"), 120).withColumn("value", F.col("value").cast("double"))


@_query("""SELECT c_custkey AS "version", k AS step, stage, stage_reason IS NULL AS allowed, stage_reason AS reason FROM (SELECT c_custkey, k, stage, CASE WHEN before IS NULL AND stage <> 'CANDIDATE' THEN 'MUST_START_AS_CANDIDATE' WHEN before IS NOT NULL AND before || '>' || stage NOT IN ('CANDIDATE>VALIDATED', 'VALIDATED>PRODUCTION', 'CANDIDATE>ARCHIVED', 'VALIDATED>ARCHIVED', 'PRODUCTION>ARCHIVED') THEN 'NO_SUCH_EDGE'
  WHEN stage = 'PRODUCTION' AND c_custkey % 3 = 0 THEN 'REASON_NEEDED' END AS stage_reason FROM (SELECT c_custkey, k, ['CANDIDATE', 'VALIDATED', 'PRODUCTION', 'ARCHIVED'][(c_custkey * k) % 4 + 1] AS stage, lag(['CANDIDATE', 'VALIDATED', 'PRODUCTION', 'ARCHIVED'][(c_custkey * k) % 4 + 1]) OVER (PARTITION BY c_custkey ORDER BY k) AS before FROM customer, (VALUES (0), (1), (2), (3)) v(k)))""")
def stage_changes(spark, sf_dir):
    stage = F.element_at(F.array(*map(F.lit, ("CANDIDATE", "VALIDATED", "PRODUCTION", "ARCHIVED"))), ((F.col("version") * F.col("step")) % 4 + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("version"), F.explode(F.array(*map(F.lit, range(4)))).alias("step"))
    rows = c.select(F.lit("m").alias("name"), "version", "step", stage.alias("stage"), F.when(F.col("version") % 3 != 0, "good").alias("reason_text"))
    return registry.stages(rows).select("version", "step", "stage", "allowed", "reason")


@_query("""SELECT s_suppkey AS run_id, 'DIGEST_DIFFERS' AS problem FROM supplier WHERE s_suppkey % 9 = 0 UNION ALL SELECT s_suppkey, 'REPEATED_RUN' FROM supplier WHERE s_suppkey % 10 = 0""")
def experiment_audit(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), F.col("s_name").alias("task"), F.col("s_acctbal").cast("string").alias("score"))
    log = s.withColumn("digest", registry.digest("task", "score")).withColumn("task", F.when(F.col("run_id") % 9 == 0, "changed").otherwise(F.col("task")))
    twice = log.where("run_id % 10 = 0 and run_id % 9 <> 0").union(log.where("run_id % 10 = 0 and run_id % 9 = 0").withColumn("digest", registry.digest("task", "score")))
    return registry.audit(log.union(twice), ["task", "score"])


@_query("""SELECT s_suppkey AS run_id, CASE WHEN s_suppkey % 4 = 0 THEN 'NO_MANIFEST' WHEN s_suppkey % 5 = 0 THEN 'DIGEST_DIFFERS' ELSE 'VERIFIED' END AS status FROM supplier""")
def model_lineage(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), F.col("s_name").alias("dataset_version"), F.sha2("s_name", 256).alias("dataset_digest"))
    m = s.where("run_id % 4 <> 0").select("dataset_version", F.when(F.col("run_id") % 5 == 0, "0").otherwise(F.col("dataset_digest")).alias("digest"))
    return registry.lineage(s, m).select("run_id", "status")


@_query("""SELECT c_mktsegment AS name, c_custkey AS run_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey) AS "version" FROM customer""")
def model_versions(spark, sf_dir):
    return registry.versions(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("registered_us"))).select("name", "run_id", F.col("version").cast("bigint").alias("version"))


@_query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def find_runs(spark, sf_dir):
    return registry.find_runs(table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_nationkey=3, c_phone=None).select("c_custkey")


@_query("SELECT DISTINCT c_mktsegment AS model_family FROM customer")
def model_families(spark, sf_dir):
    return registry.families(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("model_family")))


@_query("""SELECT event_id, 'Warn ' || event_id AS title, event_id % 3 = 0 AS early, event_id % 4 = 0 AS matches FROM events""")
def weather_warnings(spark, sf_dir):
    n = F.col("event_id").cast("string")
    body = F.concat(F.lit('[{"warning_issue":{"issued":"2024-01-02T10:00:00","title_en":"Warn '), n, F.lit('"},"valid_from":"'), F.when(F.col("event_id") % 3 == 0, "2024-01-02T09:00:00").otherwise("2024-01-02T11:00:00"), F.lit('","text_en":"over '), F.when(F.col("event_id") % 4 == 0, "PULAU Pinang").otherwise("Kedah"), F.lit('"}]'))
    e = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return feeds.warnings(e, "body", "pulau pinang|penang").select("event_id", "title", "early", "matches")


@_query("""SELECT event_id, 1 AS layer_id, CASE WHEN event_id % 2 = 0 THEN 'Banjir ' || (1990 + event_id % 40) ELSE 'Banjir 12345' END AS name, CASE WHEN event_id % 2 = 0 THEN 1990 + event_id % 40 END::INT AS year, 'TARIKH,d' AS date_fields FROM events""")
def layer_metadata(spark, sf_dir):
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Banjir "), (F.col("event_id") % 40 + 1990).cast("string"))).otherwise("Banjir 12345")
    body = F.concat(F.lit('{"layers":[{"id":1,"name":"'), name, F.lit('","fields":[{"name":"TARIKH","type":"esriFieldTypeString"},{"name":"x","type":"esriFieldTypeDouble"},{"name":"d","type":"esriFieldTypeDate"}]}]}'))
    rows = feeds.layer_metadata(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body")
    return rows.withColumn("date_fields", F.array_join("date_fields", ","))


@_query("""SELECT event_type, count(*) FILTER (event_id % 6 <> 0) AS dated, count(*) FILTER (event_id % 6 = 0) AS undated, count(DISTINCT CASE WHEN event_id % 6 <> 0 THEN ts::DATE END) AS days, min(CASE WHEN event_id % 6 <> 0 THEN ts::DATE END) AS first_day, max(CASE WHEN event_id % 6 <> 0 THEN ts::DATE END) AS last_day FROM events GROUP BY 1""")
def layer_dates(spark, sf_dir):
    millis = F.when(F.col("event_id") % 6 != 0, F.floor(core.micros(F.col("ts")) / 1000))
    return feeds.date_summary(table(spark, sf_dir, "events"), ["event_type"], millis)


@_query("""WITH k AS (SELECT s_suppkey AS k FROM supplier UNION SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0), f AS (SELECT p_partkey AS k, p_size::DOUBLE AS lon, p_retailprice::DOUBLE AS lat FROM part WHERE p_partkey % 4 <> 0)
SELECT k.k, lon, lat, CASE WHEN f.k IS NULL THEN 'NOT_IN_FEED' WHEN NOT (lon BETWEEN 5 AND 40 AND lat BETWEEN 900 AND 1500) THEN 'OUTSIDE_BOX' END AS problem FROM k LEFT JOIN f USING (k)""")
def station_inventory(spark, sf_dir):
    feed = table(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("lon"), F.col("p_retailprice").cast("double").alias("lat"))
    keys = [table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))]
    return feeds.station_inventory(feed, keys, "k", "lon", "lat", (5, 900, 40, 1500))


@_query(f"""WITH n AS (SELECT p_partkey, lower(trim({NOTE})) AS k FROM part) SELECT p_partkey, CASE WHEN k = '' THEN 'missing' WHEN k = 'no data' THEN 'no_data_text' WHEN count(*) OVER (PARTITION BY k) > 1 THEN 'duplicate' ELSE 'ok' END AS display_flag FROM n""")
def display_ids(spark, sf_dir):
    return feeds.display_id_flags(table(spark, sf_dir, "part").select("p_partkey", F.expr(NOTE).alias("shown")), "shown").select("p_partkey", "display_flag")


def sites(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sensor_id"), (F.col("s_suppkey") % 30).alias("site_id"), F.when(F.col("s_suppkey") % 7 < 4, "rainfall").otherwise("water_level").alias("sensor_type"), F.when(F.col("s_suppkey") % 3 == 0, "STALE").otherwise("FRESH").alias("freshness"), (F.col("s_suppkey") % 4).alias("risk"))
    return s, s.groupBy("site_id").agg(F.collect_list(F.struct(F.col("sensor_type").alias("type"), "freshness", "risk")).alias("sensors")).select("site_id", (F.col("site_id") % 5).cast("string").alias("district"), F.concat(F.lit("Site "), F.col("site_id").cast("string")).alias("name"), "sensors")


SENSORS = "SELECT s_suppkey AS sensor_id, s_suppkey % 30 AS site_id, CASE WHEN s_suppkey % 7 < 4 THEN 'rainfall' ELSE 'water_level' END AS st, CASE WHEN s_suppkey % 3 = 0 THEN 'STALE' ELSE 'FRESH' END AS fresh, s_suppkey % 4 AS risk FROM supplier"


@_query(f"SELECT site_id FROM ({SENSORS}) WHERE site_id % 5 = 2 GROUP BY 1 HAVING count(DISTINCT st) = 2 AND bool_or(fresh = 'FRESH') AND max(risk) >= 2 AND contains('site ' || site_id, 'e 1')")
def shared_sites(spark, sf_dir):
    return feeds.site_filter(sites(spark, sf_dir)[1], "2", "SHARED", "FRESH", 2, "E 1").select("site_id")


@_query(f"SELECT st AS sensor_type, count(*) AS n_sensors, count(*) FILTER (fresh = 'FRESH') AS reporting, count(*) FILTER (risk >= 1) AS at_risk FROM ({SENSORS}) GROUP BY 1")
def sensor_tallies(spark, sf_dir):
    return feeds.sensor_tallies(sites(spark, sf_dir)[0])


@_query(f"SELECT site_id, count(*) AS n_sensors, string_agg(sensor_id::VARCHAR || CASE WHEN sensor_id % 2 = 0 THEN ':WASPADA' ELSE '' END, ',' ORDER BY sensor_id) AS listed FROM ({SENSORS}) GROUP BY 1 UNION ALL SELECT 99, 0, ''")
def site_payloads(spark, sf_dir):
    s, places = sites(spark, sf_dir)
    t = s.where("sensor_id % 2 = 0").select("sensor_id", F.lit("WASPADA").alias("threshold_type"), F.lit(1.0).alias("value"))
    out = feeds.with_sensors(places.select("site_id").union(spark.sql("select 99L")), s.select("site_id", "sensor_id", "sensor_type"), t)
    one = F.transform("sensors", lambda x: F.concat(x["sensor_id"].cast("string"), F.when(F.size(x["thresholds"]) > 0, F.concat(F.lit(":"), x["thresholds"][0]["threshold_type"])).otherwise("")))
    return out.select("site_id", F.col("n_sensors").cast("bigint").alias("n_sensors"), F.coalesce(F.array_join(one, ","), F.lit("")).alias("listed"))


@_query("SELECT event_id FROM events WHERE event_type = 'error' AND user_id % 3 = 0")
def active_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("alert_id"), F.col("event_type").alias("sensor"), core.micros(F.col("ts")).alias("raised_us"), F.when(F.col("user_id") % 3 != 0, 1).alias("resolved_us"))
    return feeds.active_alerts(e, "error").select("event_id")


@_query("""SELECT p_partkey AS sensor_id, CASE WHEN p_partkey % 8 = 0 THEN 'UNKNOWN_TYPE' WHEN p_partkey % 9 = 0 THEN 'WRONG_UNIT' WHEN p_partkey % 10 = 0 THEN 'NOT_A_NUMBER' ELSE 'TIME_WITHOUT_ZONE' END AS reason FROM part WHERE p_partkey % 8 = 0 OR p_partkey % 9 = 0 OR p_partkey % 10 = 0 OR p_partkey % 11 = 0""")
def threshold_contract(spark, sf_dir):
    return feeds.threshold_rows(threshold_texts(spark, sf_dir))[1].select("sensor_id", "reason")


def threshold_texts(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("NORMAL", "WASPADA", "AMARAN", "BAHAYA"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("sensor_id"), F.when(k % 8 == 0, "ODD").otherwise(kind).alias("threshold_type"), F.when(k % 10 == 0, "x").otherwise((k % 30).cast("string")).alias("value"), F.when(k % 9 == 0, "ft").otherwise("m").alias("unit"), F.when(k % 11 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00+08:00").alias("captured_at"))


@_query("""SELECT p_partkey AS sensor_id, p_partkey % 4 AS place, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 3 < 1 END AS captured_after FROM part WHERE p_partkey % 4 > 0 AND p_partkey % 9 <> 0 AND p_partkey % 10 <> 0 AND p_partkey % 11 <> 0""")
def threshold_reference(spark, sf_dir):
    good = feeds.threshold_rows(threshold_texts(spark, sf_dir))[0].withColumn("captured_us", F.lit(10))
    last = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("sensor_id"), (F.lit(9) + F.col("p_partkey") % 3).alias("last_us"))
    return feeds.threshold_reference(good, last).select("sensor_id", F.col("place").cast("bigint").alias("place"), "captured_after")


@_query("""SELECT c_custkey, trim(regexp_replace('  ' || c_name || '  x ' || c_mktsegment || chr(9), '\\s+', ' ', 'g')) AS name FROM customer""")
def collapsed_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", feeds.collapsed(F.concat(F.lit("  "), "c_name", F.lit("  x "), "c_mktsegment", F.lit("\t"))).alias("name"))


@_query("""SELECT s_suppkey, s_acctbal::DOUBLE AS acctbal FROM supplier WHERE s_nationkey = 3 ORDER BY s_suppkey LIMIT 5""")
def listed_sites(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("acctbal"), F.col("s_nationkey").cast("string").alias("district"))
    return feeds.list_sites(s, "s_suppkey", "3", 5).select("s_suppkey", "acctbal")
