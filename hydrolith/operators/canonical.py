"""Canonical observations: duplicate resolution, flags, exclusion reasons, layer consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.functions.core import first_of, parsed_value, usable_flags, value_status


def signature(raw: str = "value_raw") -> Column:
    """NUMERIC:<value> with negative zero folded, or <status>:<trimmed text>."""
    status = value_status(F.col(raw))
    number = parsed_value(F.col(raw)) + F.lit(0.0)
    return F.when(status == "NUMERIC", F.concat(F.lit("NUMERIC:"), number.cast("string"))).otherwise(F.concat_ws(":", status, F.trim(F.coalesce(F.col(raw), F.lit("")))))


def resolve(rows: DataFrame, key: list[str], order: list[str], raw: str = "value_raw") -> DataFrame:
    """One row for each key: UNIQUE, IDENTICAL or CONFLICT, the first member's value, and the count of members.

    A conflict has no value; its reason tells numbers that differ from markers that differ and from a mix of both.
    Members need nothing but partial aggregates, so a key with very many captures is no bottleneck.
    """
    sig = rows.withColumn("sig", signature(raw)).withColumn("number", F.col("sig").startswith("NUMERIC:"))
    g = sig.groupBy(*key).agg(F.count("*").alias("duplicate_count"), F.count_distinct("sig").alias("n_values"), F.min_by(raw, F.struct(*order)).alias("first_raw"), F.max("number").alias("any_number"), F.min("number").alias("all_numbers"))
    status = F.when(F.col("duplicate_count") == 1, "UNIQUE").when(F.col("n_values") == 1, "IDENTICAL").otherwise("CONFLICT")
    clash = F.col("n_values") > 1
    reason = F.when(clash, F.when(F.col("all_numbers"), "NUMERIC_VALUES_DIFFER").when(F.col("any_number"), "MARKER_VS_NUMERIC").otherwise("MARKERS_DIFFER"))
    flags = F.when(status == "IDENTICAL", F.array(F.lit("DUPLICATE_IDENTICAL"))).when(status == "CONFLICT", F.array(F.lit("DUPLICATE_CONFLICT"))).otherwise(F.array().cast("array<string>"))
    value = F.when(~clash, parsed_value(F.col("first_raw")))
    out = g.select(*key, status.alias("duplicate_status"), "duplicate_count", reason.alias("conflict_reason"), value.alias("value"), flags.alias("quality_flags"))
    return out.withColumn("usable", F.col("value").isNotNull() & usable_flags(F.col("quality_flags")))


#: Columns on which all captures of a key have to agree.
AGREED = ("site_id", "unit", "local_us", "sensor_type")


def observations(quality: DataFrame, key: list[str], agreed: tuple[str, ...] = AGREED) -> DataFrame:
    """One canonical row for each key of the quality rows that no reason excludes.

    quality: the key, batch, row, field, dataset, sha, retrieved_us, value_raw, parsed_value, parse_status, quality_flags,
    excluded and further columns, which come from the earliest capture. Flags are the union over all captures; a conflict
    has no value and lists the signatures that differ; provenance lists the captures in order. A key's captures, as many as
    it was captured, are one array; nothing else is gathered. Captures of a key that disagree on a column of `agreed`
    that there is are an error that names the key and the column: no row of such a table is given.
    """
    order = ["retrieved_us", "batch", "row", "field"]
    rows = quality.where("excluded is null").withColumn("value_signature", signature("value_raw"))
    other = [c for c in quality.columns if c not in (*key, *order, "dataset", "sha", "excluded", "quality_flags")]
    g = rows.groupBy(*key).agg(
        F.min_by(F.struct(*other, "retrieved_us"), F.struct(*order)).alias("rep"),
        F.array_sort(F.collect_set("value_signature")).alias("signatures"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("quality_flags")))).alias("flags"),
        F.array_sort(F.collect_set("dataset")).alias("datasets"),
        F.array_sort(F.collect_list(F.struct(*order, "sha", "dataset", "value_signature"))).alias("provenance"),
        first_of(*[(F.count_distinct(F.struct(c)) > 1, c) for c in agreed if c in quality.columns] or [(F.lit(False), "")]).alias("disagrees"),
    )
    named = F.concat(F.lit("canonical key "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key]), F.lit(": captures disagree on "), F.col("disagrees"))
    g = g.withColumn("rep", F.when(F.col("disagrees").isNull(), F.col("rep")).otherwise(F.raise_error(named)))
    n, conflict = F.size("provenance"), F.size("signatures") > 1
    status = F.when(conflict, "CONFLICT").when(n > 1, "IDENTICAL").otherwise("UNIQUE")
    added = F.when(conflict, F.array(F.lit("DUPLICATE_CONFLICT"))).when(n > 1, F.array(F.lit("DUPLICATE_IDENTICAL"))).otherwise(F.array().cast("array<string>"))
    numbers = F.size(F.filter("signatures", lambda s: s.startswith("NUMERIC:")))
    reason = F.when(conflict, F.when(numbers == F.size("signatures"), "NUMERIC_VALUES_DIFFER").when(numbers > 0, "MARKER_VS_NUMERIC").otherwise("MARKERS_DIFFER"))
    value = F.when(~conflict, F.col("rep.parsed_value"))
    flags = F.array_sort(F.array_union("flags", added))
    kept = [c for c in other if c not in ("value_raw", "parsed_value", "parse_status", "value_signature")]
    return g.select(
        *key,
        *[F.col("rep")[c].alias(c) for c in kept],
        value.alias("value"),
        F.when(~conflict, F.col("rep.value_raw")).alias("value_raw"),
        F.when(~conflict, F.col("rep.parse_status")).alias("parse_status"),
        flags.alias("quality_flags"),
        (value.isNotNull() & usable_flags(flags)).alias("usable"),
        status.alias("duplicate_status"),
        n.alias("duplicate_count"),
        reason.alias("conflict_reason"),
        F.when(conflict, F.col("signatures")).otherwise(F.array().cast("array<string>")).alias("conflicting_values"),
        F.col("rep.retrieved_us").alias("first_retrieved_us"),
        "datasets",
        "provenance",
    )


def in_canonical_order(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows range-partitioned and sorted by key, as files of a dataset are written."""
    return rows.repartitionByRange(*key).sortWithinPartitions(*key)


def layered(layers: dict[str, DataFrame], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of all layers joined by key, keys that some layer lacks or has more than once with the first such layer's problem)."""
    names = list(layers)
    counted = [df.groupBy(*key).agg(F.count("*").alias(f"n_{n}")) for n, df in layers.items()]
    both = counted[0]
    for c in counted[1:]:
        both = both.join(c, key, "full")
    problem = F.coalesce(*[F.when(F.col(f"n_{n}").isNull(), f"MISSING_IN_{n}").when(F.col(f"n_{n}") > 1, f"REPEATED_IN_{n}") for n in names])
    out = layers[names[0]]
    for n in names[1:]:
        out = out.join(layers[n], key)
    return out, both.select(*key, problem.alias("problem")).where("problem is not null")


def one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(orphans on the left, orphans on the right, repeated keys) of two layers that should match row by row."""
    a = left.groupBy(*key).agg(F.count("*").alias("l"))
    b = right.groupBy(*key).agg(F.count("*").alias("r"))
    return a.join(b, key, "full").agg(F.count_if(F.expr("r is null")).alias("left_orphans"), F.count_if(F.expr("l is null")).alias("right_orphans"), F.count_if(F.expr("l > 1 or r > 1")).alias("repeated_keys"))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that either side has more often than the other, with multiplicity."""
    return left.exceptAll(right).union(right.exceptAll(left))
