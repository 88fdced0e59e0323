"""Discovery feeds: forecasts, warnings, map feeds, layer metadata, and the small rules of dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WARNING = "array<struct<warning_issue:struct<issued:string,title_en:string>,valid_from:string,valid_to:string,text_en:string>>"
LAYERS = "struct<layers:array<struct<id:int,name:string,fields:array<struct<name:string,type:string>>>>>"


def of_places(forecasts: DataFrame, places: DataFrame) -> DataFrame:
    """Forecast rows of the wanted locations, in order; temperature_range is null unless both ends are known."""
    kept = forecasts.join(places.select("location_id").distinct(), "location_id", "left_semi")
    return kept.withColumn("temperature_range", F.col("max_temp_c") - F.col("min_temp_c")).orderBy("location_id", "forecast_date")


def warnings(payloads: DataFrame, body: str, pattern: str) -> DataFrame:
    """Rows of warning JSON with early (valid before it was issued) and matches (its text names the place, whatever the case)."""
    rows = payloads.select(*[c for c in payloads.columns if c != body], F.posexplode(F.from_json(body, WARNING)).alias("k", "w"))
    issued, start = F.col("w.warning_issue.issued").try_cast("timestamp"), F.col("w.valid_from").try_cast("timestamp")
    return rows.select(*[c for c in rows.columns if c != "w"], F.col("w.warning_issue.title_en").alias("title"), issued.alias("issued"), start.alias("valid_from"), (start < issued).alias("early"), F.coalesce(F.col("w.text_en").rlike(f"(?i){pattern}"), F.lit(False)).alias("matches"))


def station_inventory(feed: DataFrame, inventories: list[DataFrame], key: str, lon: str, lat: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Distinct keys of all inventories with the feed's place and a problem: not in the feed, repeated there, or outside the box."""
    keys = inventories[0].select(key)
    for other in inventories[1:]:
        keys = keys.union(other.select(key))
    one = feed.groupBy(key).agg(F.count("*").alias("_n"), F.min(lon).alias(lon), F.min(lat).alias(lat))
    outside = ~(F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3]))
    problem = F.when(F.col("_n").isNull(), "NOT_IN_FEED").when(F.col("_n") > 1, "REPEATED_IN_FEED").when(F.coalesce(outside, F.lit(True)), "OUTSIDE_BOX")
    return keys.where(F.col(key).isNotNull()).distinct().join(one, key, "left").select(key, lon, lat, problem.alias("problem"))


def layer_metadata(payloads: DataFrame, body: str) -> DataFrame:
    """(..., layer_id, name, year, date_fields): year is the first of 19xx or 20xx in the name."""
    rows = payloads.select(*[c for c in payloads.columns if c != body], F.explode(F.from_json(body, LAYERS)["layers"]).alias("l"))
    dates = F.transform(F.filter("l.fields", lambda f: f["type"].endswith("Date") | F.lower(f["name"]).contains("tarikh")), lambda f: f["name"])
    return rows.select(*[c for c in rows.columns if c != "l"], F.col("l.id").alias("layer_id"), F.col("l.name").alias("name"), F.nullif(F.regexp_extract("l.name", r"(?<!\d)((?:19|20)\d\d)(?!\d)", 1), F.lit("")).cast("int").alias("year"), dates.alias("date_fields"))


def date_summary(rows: DataFrame, by: list[str], millis: Column) -> DataFrame:
    """Dated and undated rows, distinct days, first and last day of epoch milliseconds."""
    day = F.to_date(F.timestamp_millis(millis))
    return rows.withColumn("_d", F.when(millis.isNotNull(), day)).groupBy(*by).agg(F.count("_d").alias("dated"), F.count_if(F.col("_d").isNull()).alias("undated"), F.count_distinct("_d").alias("days"), F.min("_d").alias("first_day"), F.max("_d").alias("last_day"))


def missing_display_id(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("", "no data"), F.lit(True))


def display_id_flags(rows: DataFrame, display: str) -> DataFrame:
    """rows with display_flag: missing, no_data_text, duplicate or ok. Repeats are counted by id, not in windows over rows."""
    clean = F.lower(F.trim(F.col(display)))
    again = rows.where(~missing_display_id(F.col(display))).groupBy(clean.alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1")
    flag = F.when(F.coalesce(clean, F.lit("")) == "", "missing").when(clean == "no data", "no_data_text").when(F.col("_n").isNotNull(), "duplicate").otherwise("ok")
    return rows.join(again, clean == F.col("_k"), "left").select(*rows.columns, flag.alias("display_flag"))


def collapsed(name: Column) -> Column:
    """A name with single spaces, none outside."""
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def site_filter(sites: DataFrame, district: str | None = None, kind: str | None = None, freshness: str | None = None, least_risk: int | None = None, search: str | None = None) -> DataFrame:
    """Sites that meet every condition asked for; kind SHARED needs sensors of both types. sensors: array of (type, freshness, risk)."""
    has = lambda t: F.exists("sensors", lambda s: s["type"] == t)
    out = sites
    if district is not None:
        out = out.where(F.col("district") == district)
    if kind == "SHARED":
        out = out.where(has("rainfall") & has("water_level"))
    elif kind is not None:
        out = out.where(has(kind))
    if freshness is not None:
        out = out.where(F.exists("sensors", lambda s: s["freshness"] == freshness))
    if least_risk is not None:
        out = out.where(F.exists("sensors", lambda s: s["risk"] >= least_risk))
    if search:
        out = out.where(F.lower("name").contains(search.lower()))
    return out


def list_sites(sites: DataFrame, order: str, district: str | None, limit: int) -> DataFrame:
    """The first sites of a district, or of all, by id: what an interface lists."""
    return (sites if district is None else sites.where(F.col("district") == district)).orderBy(order).limit(limit)


def with_sensors(sites: DataFrame, sensors: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row for each site with its sensors, each with its thresholds, as ordered arrays; sites without sensors have an empty one."""
    t = thresholds.groupBy("sensor_id").agg(F.array_sort(F.collect_list(F.struct("threshold_type", "value"))).alias("thresholds"))
    none = F.array().cast("array<struct<threshold_type:string,value:double>>")
    s = sensors.join(t, "sensor_id", "left").groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("sensor_id", "sensor_type", F.coalesce("thresholds", none).alias("thresholds")))).alias("sensors"))
    return sites.join(s, "site_id", "left").withColumn("n_sensors", F.coalesce(F.size("sensors"), F.lit(0)))


def sensor_tallies(sensors: DataFrame) -> DataFrame:
    """Per type: sensors, those that report (FRESH or DELAYED), and those at a risk of 1 or more."""
    return sensors.groupBy("sensor_type").agg(F.count("*").alias("n_sensors"), F.count_if(F.col("freshness").isin("FRESH", "DELAYED")).alias("reporting"), F.count_if(F.col("risk") >= 1).alias("at_risk"))


def active_alerts(alerts: DataFrame, sensor: str) -> DataFrame:
    """Open alerts of a sensor, the newest first."""
    return alerts.where((F.col("sensor") == sensor) & F.col("resolved_us").isNull()).orderBy(F.desc("raised_us"), F.desc("alert_id"))


def threshold_rows(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(thresholds with a decimal value, rows that break the contract with the reason) of text rows (sensor_id, threshold_type, value, unit, captured_at).

    The value must be a finite number, the unit m, the type known, and captured_at must name its time zone. A sensor with
    two values of one type is flagged in both.
    """
    number = F.col("value").try_cast("decimal(10,3)")
    zoned = F.col("captured_at").rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$")
    reason = F.when(~F.coalesce(F.col("threshold_type").isin("NORMAL", "WASPADA", "AMARAN", "BAHAYA"), F.lit(False)), "UNKNOWN_TYPE").when(~F.col("unit").eqNullSafe("m"), "WRONG_UNIT").when(number.isNull(), "NOT_A_NUMBER").when(~F.coalesce(zoned, F.lit(False)), "TIME_WITHOUT_ZONE")
    rows = text.withColumn("reason", reason)
    good = rows.where("reason is null").withColumn("value", number)
    clash = good.groupBy("sensor_id", "threshold_type").agg((F.count_distinct("value") > 1).alias("conflict"))
    return good.drop("reason").join(clash, ["sensor_id", "threshold_type"]), rows.where("reason is not null")


def threshold_reference(thresholds: DataFrame, last_usable: DataFrame) -> DataFrame:
    """Thresholds but NORMAL, with `captured_after`: taken after the sensor's last usable row; `place` in the order of severity."""
    place = F.array_position(F.array(F.lit("WASPADA"), F.lit("AMARAN"), F.lit("BAHAYA")), F.col("threshold_type"))
    own = thresholds.where(place > 0).withColumn("place", place)
    return own.join(last_usable.select("sensor_id", "last_us"), "sensor_id", "left").withColumn("captured_after", F.col("captured_us") > F.col("last_us"))


def thresholds_of_sensors(evidence: DataFrame, sensors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence with its water-level sensor, evidence that has none)."""
    own = sensors.where("sensor_type = 'water_level'").select("key", "sensor_id")
    return evidence.join(own, "key"), evidence.join(own, "key", "left_anti")
