"""Units and measurement semantics: which source fields are promoted, by a policy table, and why others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.functions.core import first_of, parsed_value, value_status

# Units that source texts may name, each standing for itself.
KNOWN_UNITS = ("mm", "m", "°C")
POLICY = "source string, dataset string, field string, measurement_type string, canonical_unit string, unit_in_label boolean, expected_sensor string, threshold_category string, excluded_reason string"


def policy_table(spark, policies: list[tuple]) -> DataFrame:
    """Rows of POLICY. `field` is a whole name or a pattern; with unit_in_label its first group is the unit that the label prints.

    A row with excluded_reason is a measurement that is known and never promoted.
    """
    return spark.createDataFrame(policies, POLICY)


def policy_problems(policies: DataFrame) -> DataFrame:
    """(source, dataset, field, problem): repeated fields, promoted fields with an unknown unit or no type, excluded ones with a type."""
    n = policies.groupBy("source", "dataset", "field").agg(F.count("*").alias("n")).where("n > 1").select("source", "dataset", "field", F.lit("REPEATED_FIELD").alias("problem"))
    promoted = F.col("excluded_reason").isNull()
    problem = first_of(
        (promoted & F.col("measurement_type").isNull(), "NO_MEASUREMENT_TYPE"),
        (promoted & ~F.coalesce(F.col("canonical_unit").isin(*KNOWN_UNITS), F.lit(False)), "UNKNOWN_UNIT"),
        (~promoted & F.col("measurement_type").isNotNull(), "EXCLUDED_WITH_TYPE"),
    )
    return n.union(policies.select("source", "dataset", "field", problem.alias("problem")).where("problem is not null"))


def record_fields(records: DataFrame, policies: DataFrame) -> DataFrame:
    """One row for each field to validate: the primary value, every threshold, and other source fields that a policy names.

    records: value_field, value_raw, thresholds and source_fields (maps of texts), unit, source, dataset and further columns,
    which are kept; a column threshold_temporal_scope is that of the thresholds alone. Fields are exploded in place; only the
    table of policies is joined.
    """
    field = lambda name, role, value, unit: F.struct(name.alias("field"), F.lit(role).alias("role"), value.alias("value_raw_of"), unit.alias("record_unit"))
    none = F.lit(None).cast("string")
    of = lambda entries, role: F.transform(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")), lambda e: field(e["key"], role, e["value"], none))
    seen = F.array_append(F.coalesce(F.map_keys("thresholds"), F.array().cast("array<string>")), F.col("value_field"))
    others = F.filter(F.map_entries("source_fields"), lambda e: ~F.array_contains(seen, e["key"]))
    fields = F.concat(F.array(field(F.col("value_field"), "PRIMARY_VALUE", F.col("value_raw"), F.col("unit"))), of(F.map_entries("thresholds"), "THRESHOLD"), of(others, "SOURCE_FIELD"))
    kept = [c for c in records.columns if c not in ("value_field", "value_raw", "thresholds", "source_fields", "unit")]
    rows = records.select(*kept, F.explode(fields).alias("f")).select(*kept, "f.field", "f.role", F.col("f.value_raw_of").alias("value_raw"), "f.record_unit")
    if "threshold_temporal_scope" in kept:
        rows = rows.withColumn("threshold_temporal_scope", F.when(F.col("role") == "THRESHOLD", F.col("threshold_temporal_scope")))
    matched = with_policy(rows, policies)
    return matched.where((F.col("role") != "SOURCE_FIELD") | F.col("policy").isNotNull())


def with_policy(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """rows with `policy`, the struct of the policy of their source, dataset and field, or null.

    Distinct (source, dataset, field) triples are matched with the patterns, not rows: fields are few, whatever the rows.
    """
    key = ["source", "dataset", "field"]
    p = policies.select(*[F.col(c).alias(f"p_{c}") for c in policies.columns])
    names = rows.select(*key).distinct()
    hit = names.join(p, (F.col("source") == F.col("p_source")) & (F.col("dataset") == F.col("p_dataset")) & F.expr("field rlike concat('^(?:', p_field, ')$')"))
    one = hit.groupBy(*key).agg(F.min(F.struct(*[F.col(f"p_{c}").alias(c) for c in policies.columns])).alias("policy"))
    return rows.join(one, key, "left")


def validate_units(fields: DataFrame) -> DataFrame:
    """fields (with policy) with value_parse_status, parsed_value, label_unit, measurement_type, canonical_unit, unit_provenance, semantics_status, unit_status and reason.

    The first failing step decides: semantics, sensor type, a unit in the label, the label's unit, the record's unit. A value
    is parsed only where the unit is valid and the text a number, so an unverified field never leaks as one.
    """
    p = F.col("policy")
    label = F.when(p["unit_in_label"], F.expr("nullif(regexp_extract(field, concat('^(?:', policy.field, ')$'), 1), '')"))
    promoted = p.isNotNull() & p["excluded_reason"].isNull()
    wrong = lambda unit: unit.isNotNull() & (F.trim(unit) != p["canonical_unit"])
    known = lambda unit: F.trim(unit).isin(*KNOWN_UNITS)
    record = F.col("record_unit")
    status = (
        F.when(~promoted | p.isNull(), "UNKNOWN_MEASUREMENT_SEMANTICS")
        .when(~F.col("sensor_type").eqNullSafe(p["expected_sensor"]), "SENSOR_TYPE_MISMATCH")
        .when(p["unit_in_label"] & F.col("label_unit").isNull(), "MISSING_UNIT")
        .when(wrong(F.col("label_unit")), F.when(known(F.col("label_unit")), "UNIT_MISMATCH").otherwise("UNKNOWN_UNIT"))
        .when(wrong(record), F.when(known(record), "UNIT_MISMATCH").otherwise("UNKNOWN_UNIT"))
        .otherwise("VALID")
    )
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    said = lambda what, unit: F.concat(F.lit(f"{what} "), quoted(unit), F.when(known(unit), F.concat(F.lit(" is not "), quoted(p["canonical_unit"]))).otherwise(" is not an accepted unit"))
    # fixed values: the texts of reasons
    reason = (
        F.when(p.isNull(), "field not in the unit policy")
        .when(~promoted, F.concat(F.lit("excluded: "), p["excluded_reason"]))
        .when(F.col("unit_status") == "SENSOR_TYPE_MISMATCH", F.concat(p["measurement_type"], F.lit(" expects sensor "), F.coalesce(p["expected_sensor"], F.lit("None")), F.lit(", record has "), F.coalesce("sensor_type", F.lit("None"))))
        .when(F.col("unit_status") == "MISSING_UNIT", "field label carries no unit")
        .when(F.col("unit_status") != "VALID", F.when(wrong(F.col("label_unit")), said("label unit", F.col("label_unit"))).otherwise(said("raw record unit", record)))
    )
    provenance = F.when(promoted, F.when(p["unit_in_label"], "IN_PAYLOAD").otherwise("OFFICIAL_UI_OR_DOCS"))
    valid = F.col("unit_status") == "VALID"
    rows = fields.withColumn("label_unit", label).withColumn("value_parse_status", value_status(F.col("value_raw"))).withColumn("unit_status", status)
    return rows.select(
        "*",
        F.when(valid, parsed_value(F.col("value_raw"))).alias("parsed_value"),
        *[F.when(promoted, p[c]).alias(c) for c in ("measurement_type", "canonical_unit", "threshold_category")],
        provenance.alias("unit_provenance"),
        F.when(promoted, "VERIFIED").otherwise("UNVERIFIED").alias("semantics_status"),
        reason.alias("reason"),
    ).drop("policy")


def spatial(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Coordinates of texts, six decimals; blank, missing or no number: null."""
    number = lambda x: F.round(F.nullif(F.trim(x), F.lit("")).try_cast("double"), 6)
    return number(lon), number(lat)
