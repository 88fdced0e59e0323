"""Quality rows: what the layers of a raw record, its time, station and units, say of each of its measurements, as flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.functions.core import INFORMATIONAL

# Flags by the status of each layer, source markers that have a flag of their own, and rainfall types.
TIME_FLAGS = {"MISSING": "TIMESTAMP_MISSING", "INVALID_FORMAT": "TIMESTAMP_INVALID_FORMAT", "AMBIGUOUS": "TIMESTAMP_AMBIGUOUS", "FUTURE": "TIMESTAMP_FUTURE", "UNSPECIFIED_TIMEZONE": "TIMESTAMP_UNSPECIFIED_TIMEZONE"}
QUARANTINE_FLAGS = {"MISSING_TIMESTAMP": "TIMESTAMP_MISSING", "UNPARSEABLE_TIMESTAMP": "TIMESTAMP_INVALID_FORMAT", "INVALID_ROW_STRUCTURE": "ROW_STRUCTURE_INVALID"}
STATION_FLAGS = {"UNMAPPED": "SENSOR_UNMAPPED", "INVALID_SOURCE_ID": "SOURCE_ID_INVALID", "SENSOR_TYPE_MISMATCH": "SENSOR_TYPE_MISMATCH", "INVALID_SENSOR_TYPE": "SENSOR_TYPE_INVALID"}
UNIT_FLAGS = {"MISSING_UNIT": "UNIT_MISSING", "UNKNOWN_UNIT": "UNIT_UNKNOWN", "UNIT_MISMATCH": "UNIT_MISMATCH", "SENSOR_TYPE_MISMATCH": "UNIT_SENSOR_TYPE_MISMATCH", "UNKNOWN_MEASUREMENT_SEMANTICS": "MEASUREMENT_SEMANTICS_UNKNOWN"}
VALUE_FLAGS = {"EMPTY": "VALUE_EMPTY", "NON_NUMERIC": "VALUE_NON_NUMERIC"}
MARKER_FLAGS = {"ERROR": "VALUE_SOURCE_ERROR", "Tiada Data": "VALUE_NO_DATA_MARKER"}
RAINFALL = ("RAINFALL_INTERVAL", "RAINFALL_1H_TOTAL")


def _flag(status: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), status)


def value_flag(measurement_type: Column, parse_status: Column, value_raw: Column, parsed: Column) -> Column:
    """Flag of a measurement's value text, null for a good one, and for a field that is no measurement."""
    marker = F.coalesce(_flag(F.trim(value_raw), MARKER_FLAGS), F.lit("VALUE_MISSING_SENTINEL"))
    negative = measurement_type.isin(*RAINFALL) & (parsed < 0)
    return F.when(measurement_type.isNotNull(), F.when(parse_status == "SOURCE_MARKER", marker).when(parse_status.isin(*VALUE_FLAGS), _flag(parse_status, VALUE_FLAGS)).when(negative, "RAINFALL_NEGATIVE"))


def quality_rows(records: DataFrame, times: DataFrame, stations: DataFrame, units: DataFrame, key: list[str]) -> DataFrame:
    """One row for each measurement of each record: its primary value, and source fields that a policy promotes; with flags and whether it is usable.

    records: key, sensor_id, dataset, severity, quarantine_reason and further columns, which are kept. times: key, time_status,
    time_precision, timezone_status, ... stations: key, raw_sensor_id, mapping_status, sensor_id. units: key, field, role, value_raw,
    value_parse_status, parsed_value, measurement_type, canonical_unit, unit_status. All columns of the layers are carried, so a
    row says where it comes from. Flags are sorted and distinct. A record has at most one row of times and stations, and exactly one
    PRIMARY_VALUE among its units: a record without one, or a layer that names another sensor, is an error that names the key.
    Layers are joined on the key alone.
    """
    layer = lambda df, prefix: df.select(*key, F.struct(*[c for c in df.columns if c not in key]).alias(prefix))
    measured = units.where((F.col("role") == "PRIMARY_VALUE") | ((F.col("role") == "SOURCE_FIELD") & F.col("measurement_type").isNotNull()))
    of_record = measured.groupBy(*key).agg(F.collect_list(F.struct(*[c for c in measured.columns if c not in key])).alias("_u"))
    d = records.join(layer(times, "_t"), key, "left").join(layer(stations, "_s"), key, "left").join(of_record, key, "left")
    primary = F.size(F.filter("_u", lambda u: u["role"] == "PRIMARY_VALUE"))
    named = F.concat(F.lit("record "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key]))
    problem = F.when(F.coalesce(primary, F.lit(0)) != 1, F.concat(named, F.lit(": not one PRIMARY_VALUE"))).when(F.col("_s").isNotNull() & ~F.col("_s.raw_sensor_id").eqNullSafe(F.col("sensor_id")), F.concat(named, F.lit(": the station layer names another sensor")))
    u = d.withColumn("_u", F.explode(F.when(problem.isNull(), F.col("_u")).otherwise(F.raise_error(problem))))
    when = lambda c, name: F.when(c, F.lit(name))
    flags = [
        when(F.col("quarantine_reason").isNotNull(), "RAW_QUARANTINED"), _flag(F.col("quarantine_reason"), QUARANTINE_FLAGS), _flag(F.col("_t.time_status"), TIME_FLAGS),
        when(F.col("_t.timezone_status") == "UNSPECIFIED_ASSUMED", "TIMEZONE_ASSUMED"), when(F.col("_t.time_precision") == "DATE", "TIMESTAMP_DATE_ONLY"), when(F.col("_s").isNull(), "NO_STATION_SENSOR"),
        _flag(F.col("_s.mapping_status"), STATION_FLAGS), when(F.col("_s").isNotNull() & ~F.col("_s.sensor_id").eqNullSafe(F.col("_s.raw_sensor_id")), "STATION_MASTER_CHANGED_SINCE_INGEST"),
        when((F.trim("severity") == "ERROR") & (F.col("dataset") == "water_level_history"), "SOURCE_SEVERITY_ERROR"), _flag(F.col("_u.unit_status"), UNIT_FLAGS),
        value_flag(F.col("_u.measurement_type"), F.col("_u.value_parse_status"), F.col("_u.value_raw"), F.col("_u.parsed_value")),
    ]
    out = u.withColumn("quality_flags", F.array_sort(F.array_distinct(F.array_compact(F.array(*flags)))))
    informational = F.array(*map(F.lit, INFORMATIONAL))
    usable = (F.size(F.array_except("quality_flags", informational)) == 0) & F.col("_u.parsed_value").isNotNull()
    own = [c for c in records.columns if c != "sensor_id"]
    place = [c for c in stations.columns if c not in (*key, "raw_sensor_id")]
    return out.select(
        *own, *[F.col(f"_s.{c}").alias(c) for c in place], *[F.col(f"_t.{c}").alias(c) for c in times.columns if c not in key], *[F.col(f"_u.{c}").alias(c) for c in measured.columns if c not in key],
        F.when(F.col("quarantine_reason").isNull(), "records").otherwise("quarantine").alias("raw_file"), "quality_flags", usable.alias("usable"),
    )
