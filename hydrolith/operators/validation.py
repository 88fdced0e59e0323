"""Row validation: timestamps, station ids, exclusion reasons, flags, invariant checks and quality summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE, first_of, micros, percent_of

# Sensor types of a station.
SENSOR_TYPES = ("rainfall", "water_level")


def timestamp_status(text: Column, formats: tuple[str, ...], offset_minutes: int | None, reference_us: Column, skew_minutes: int = 10) -> tuple[Column, Column]:
    """(status, instant in microseconds) of local time texts: MISSING, INVALID_FORMAT, UNSPECIFIED_TIMEZONE, FUTURE or VALID.

    The first format that reads the text counts. offset_minutes is the zone that the source is assumed to use; without
    one no instant is known. A FUTURE time, later than the reference by more than the skew, keeps its instant.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    local = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in formats])
    us = F.lit(None).cast("bigint") if offset_minutes is None else micros(local) - offset_minutes * MINUTE
    status = F.when(t == "", "MISSING").when(local.isNull(), "INVALID_FORMAT")
    if offset_minutes is None:
        return status.otherwise("UNSPECIFIED_TIMEZONE"), us
    return status.when(us > reference_us + skew_minutes * MINUTE, "FUTURE").otherwise("VALID"), us


def source_key(source_id: Column) -> Column:
    """Id without outer white space; null where it is blank or has white space inside."""
    t = F.trim(source_id)
    return F.when((t != "") & ~t.rlike(r"\s"), t)


def map_stations(rows: DataFrame, mapping: DataFrame, types: tuple[str, ...] = SENSOR_TYPES) -> DataFrame:
    """rows (source_id, sensor_type, ...) with (mapping_status, sensor_id) by mapping (key, sensor_type, sensor_id).

    INVALID_SOURCE_ID goes before INVALID_SENSOR_TYPE; a key that the mapping has for another type alone is a
    SENSOR_TYPE_MISMATCH, an unknown one UNMAPPED. Both look-ups are equality joins on a key without repeats.
    """
    exact = mapping.groupBy(F.col("key").alias("_key"), F.col("sensor_type").alias("_type")).agg(F.min("sensor_id").alias("_sensor_id"))
    known = mapping.groupBy(F.col("key").alias("_any")).agg(F.lit(True).alias("_known"))
    keyed = rows.withColumn("_k", source_key(F.col("source_id")))
    found = keyed.join(exact, (F.col("_k") == F.col("_key")) & (F.col("sensor_type") == F.col("_type")), "left").join(known, F.col("_k") == F.col("_any"), "left")
    valid = F.col("sensor_type").isNotNull() & F.col("sensor_type").isin(*types)
    status = F.when(F.col("_k").isNull(), "INVALID_SOURCE_ID").when(~valid, "INVALID_SENSOR_TYPE").when(F.col("_key").isNotNull(), "MAPPED").when(F.col("_known"), "SENSOR_TYPE_MISMATCH").otherwise("UNMAPPED")
    return found.select(*rows.columns, status.alias("mapping_status"), F.when(status == "MAPPED", F.col("_sensor_id")).alias("sensor_id"))


def exclusion(station: Column, unit_valid: Column, sensor: Column, time: Column) -> Column:
    """First reason why a row is no canonical observation, null for an eligible row. Null conditions count as false."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return first_of((no(station), "NOT_A_STATION_OBSERVATION"), (no(unit_valid), "UNIT_NOT_VALID"), (no(sensor), "NO_CANONICAL_SENSOR"), (no(time), "NO_VALID_OBSERVATION_TIME"))


def flags_of(conditions: dict[str, Column]) -> Column:
    """Sorted array of the names whose condition holds."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()])))


def flag_counts(rows: DataFrame, flags: str, domain: tuple[str, ...]) -> DataFrame:
    """(flag, n) over a fixed domain, zeros kept: one aggregate, no row is exploded."""
    counts = rows.agg(*[F.count_if(F.array_contains(flags, f)).alias(f) for f in domain])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"`{f}`").alias("n")) for f in domain])).alias("r")).select("r.*")


def checks(rows: DataFrame, failing: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """(name, passed, failing): rows that break each invariant in one aggregate, and repeats beyond the first of each key."""
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in failing.items()])
    out = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("failing")) for n in failing])).alias("r")).select("r.*")
    for name, key in (unique or {}).items():
        repeats = rows.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failing"))
        out = out.union(repeats.select(F.lit(name).alias("name"), "failing"))
    return out.select("name", (F.col("failing") == 0).alias("passed"), "failing")


def summary_sets(rows: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Counts over several groupings of one table in one pass; a column outside a grouping is null."""
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(F.grouping_id().cast("bigint").alias("grouping"), F.count("*").alias("n"), F.count_if("usable").alias("usable"))


def null_coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, present, total, coverage_pct) of each column, from one aggregate."""
    counts = rows.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    long = counts.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("present")) for c in columns])).alias("r"))
    return long.select("r.feature", "r.present", F.col("_n").alias("total"), percent_of(F.col("r.present"), F.col("_n")).alias("coverage_pct"))


def calendar_rollup(rows: DataFrame, slots_least: int, days_least: int = 20) -> DataFrame:
    """(sensor, month, days, total, complete): covered days of each month and the sum of their usable values.

    A day is covered with at least slots_least usable slots, a month complete with at least days_least covered days.
    """
    instant = F.timestamp_micros("t")
    day = rows.where("usable").groupBy("sensor", F.to_date(instant).alias("day")).agg(F.count("*").alias("slots"), F.sum("value").alias("total")).where(F.col("slots") >= slots_least)
    month = day.groupBy("sensor", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("days"), F.round(F.sum("total"), 4).alias("total"))
    return month.withColumn("complete", F.col("days") >= days_least)


def calendar_years(months: DataFrame, months_least: int = 12) -> DataFrame:
    """(sensor, year, months, days, total, complete) of calendar_rollup's months: a year is complete with months_least complete months."""
    own = months.where("complete").groupBy("sensor", F.substring("month", 1, 4).cast("int").alias("year"))
    g = own.agg(F.count("*").alias("months"), F.sum("days").alias("days"), F.round(F.sum("total"), 4).alias("total"))
    return g.withColumn("complete", F.col("months") >= months_least)
