"""Contracts of canonical rows: violations as rows, row states, order and uniqueness reports, and the named checks over a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions.core import INFORMATIONAL, MINUTE, first_of

# Unit and sensor of each measurement; flags in the order in which they name the kind of a missing value.
MEASUREMENTS = {"RAINFALL_INTERVAL": ("mm", "rainfall"), "RAINFALL_1H_TOTAL": ("mm", "rainfall"), "WATER_LEVEL": ("m", "water_level")}
MISSING_BY_FLAG = (("DUPLICATE_CONFLICT", "CONFLICT"), ("VALUE_MISSING_MARKER", "SOURCE_MARKER"), ("VALUE_EMPTY", "EMPTY_VALUE"), ("VALUE_NON_NUMERIC", "NON_NUMERIC"), ("NEGATIVE_RAINFALL", "NEGATIVE_RAINFALL"))
MISSING_FLAGS = ("VALUE_MISSING_MARKER", "VALUE_EMPTY", "VALUE_NON_NUMERIC")
FLAGS = (*INFORMATIONAL, "DUPLICATE_CONFLICT", *MISSING_FLAGS, "NEGATIVE_RAINFALL")
OTHER = "OTHER_NOT_USABLE"


def _has(flag: str) -> Column:
    return F.array_contains("quality_flags", flag)


def blocking(flags: str = "quality_flags") -> Column:
    """Flags that make a row unusable."""
    return F.array_except(flags, F.array(*map(F.lit, INFORMATIONAL)))


def row_state() -> Column:
    """USABLE, or the missing type of the first flag, in the order of MISSING_BY_FLAG, that the row has."""
    return F.when(F.col("usable"), "USABLE").otherwise(F.coalesce(first_of(*[(_has(f), name) for f, name in MISSING_BY_FLAG]), F.lit(OTHER)))


def is_history() -> Column:
    """Some capture of the row's provenance is of a history dataset."""
    return F.exists("provenance", lambda p: p["dataset"].endswith("_history"))


def on_grid(us: Column, minutes: int = 5) -> Column:
    return F.pmod(us, F.lit(minutes * MINUTE)) == 0


def measurement_violations(rows: DataFrame, measurement: str, utc_offset_minutes: int = 480, value_ok: Column | None = None) -> DataFrame:
    """rows of a measurement (and rows of none that is known) that break the contract, with the first reason.

    Reasons by row come from one projection; repeated keys (sensor, instant) from one aggregation by key.
    """
    unit, sensor = MEASUREMENTS[measurement]
    own = F.col("measurement_type") == measurement
    bad_value = F.col("usable") & ~F.coalesce((F.abs("value") < float("inf")) & ~F.isnan("value") & (F.lit(True) if value_ok is None else value_ok), F.lit(False))
    reason = first_of(
        (~F.coalesce(F.col("measurement_type").isin(*MEASUREMENTS), F.lit(False)), "UNKNOWN_MEASUREMENT_TYPE"),
        (own & ~F.col("unit").eqNullSafe(unit), "WRONG_UNIT"),
        (own & ~F.col("sensor_type").eqNullSafe(sensor), "WRONG_SENSOR_TYPE"),
        (own & (F.coalesce("sensor_id", F.lit("")) == ""), "MISSING_IDENTITY"),
        (own & (F.col("t").isNull() | F.col("local_us").isNull()), "MISSING_TIME"),
        (own & (F.col("local_us") - F.col("t") != utc_offset_minutes * MINUTE), "WRONG_TIME_ZONE"),
        (own & F.col("usable").isNull(), "USABLE_NOT_BOOLEAN"),
        (own & bad_value, "INVALID_USABLE_VALUE"),
    )
    judged = rows.withColumn("violation", reason)
    again = rows.where(own).groupBy("sensor_id", "t").agg(F.count("*").alias("n")).where("n > 1").select("sensor_id", "t")
    repeated = judged.where(own & F.col("violation").isNull()).join(again, ["sensor_id", "t"], "left_semi").withColumn("violation", F.lit("REPEATED_KEY"))
    return judged.where("violation is not null").unionByName(repeated)


def row_violations(rows: DataFrame) -> DataFrame:
    """rows that break the contract of flags and provenance, with the first reason."""
    reason = first_of(
        (F.col("quality_flags").isNull() | F.col("datasets").isNull(), "NO_FLAGS_OR_DATASETS"),
        (F.coalesce(F.size("provenance"), F.lit(0)) <= 0, "NO_PROVENANCE"),
        (F.exists("provenance", lambda p: p["dataset"].isNull() | (F.coalesce(p["batch"], F.lit("")) == "")), "PROVENANCE_WITHOUT_BATCH"),
        (F.exists("provenance", lambda p: ~p["dataset"].rlike("_(history|listing)$")), "UNKNOWN_DATASET"),
        (F.col("usable") & (F.size(blocking()) > 0), "USABLE_WITH_BLOCKING_FLAG"),
        (~F.col("usable") & (F.size(blocking()) == 0), "UNUSABLE_WITHOUT_FLAG"),
    )
    return rows.withColumn("violation", reason).where("violation is not null")


def select_measurement(rows: DataFrame, measurement: str, **kinds) -> tuple[DataFrame, DataFrame]:
    """(rows of the measurement, counts of the others by type); any violation is an error that names the first reasons."""
    broken = measurement_violations(rows, measurement, **kinds).groupBy("violation").count().orderBy("violation").limit(20).collect()
    if broken:
        raise ValueError(f"{measurement}: " + ", ".join(f"{r[0]} ({r[1]})" for r in broken))
    other = rows.where(F.col("measurement_type") != measurement).groupBy("measurement_type").agg(F.count("*").alias("n"))
    return rows.where(F.col("measurement_type") == measurement), other


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that an index by `key` would meet more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows, if no key occurs twice; else an error that names the first five keys that do."""
    again = repeated_keys(rows, key).orderBy(*key).limit(5).collect()
    if again:
        raise ValueError(f"repeated {', '.join(key)}: " + "; ".join(str(tuple(r[k] for k in key)) for r in again))
    return rows


def disorder(rows: DataFrame, series: list[str], order: str, key: str, block: int = 4096) -> DataFrame:
    """Per series: rows whose key is not above that of the row before, in the order of a row number, and repeated keys.

    The order is cut into blocks of row numbers: rows are compared inside a block, and a block's first row with the last
    of the block before, so a long series is spread over tasks.
    """
    cut = rows.withColumn("_b", F.floor(F.col(order) / block))
    inner = cut.withColumn("_p", F.lag(key).over(Window.partitionBy(*series, "_b").orderBy(order))).groupBy(*series, "_b").agg(
        F.count_if(F.col(key) <= F.col("_p")).alias("falls"), F.min_by(key, order).alias("first"), F.max_by(key, order).alias("last"), F.count("*").alias("n"))
    edges = inner.withColumn("_e", F.lag("last").over(Window.partitionBy(*series).orderBy("_b")))
    falls = edges.groupBy(*series).agg(F.sum("n").alias("n_rows"), (F.sum("falls") + F.count_if(F.col("first") <= F.col("_e"))).alias("out_of_order"))
    again = rows.groupBy(*series, key).agg(F.count("*").alias("n")).groupBy(*series).agg(F.sum(F.col("n") - 1).alias("repeated"))
    return falls.join(again, series)


def dataset_checks(obs: DataFrame, quality: DataFrame) -> DataFrame:
    """(name, passed, failing) of the fifteen invariants of canonical rows and the quality rows that they were made of.

    obs: source, sensor_id, site_id, measurement_type, t, unit, value, parse_status, quality_flags, usable, timezone_status,
    first_retrieved_us, duplicate_status, duplicate_count, conflicting_values, provenance (batch, row, field), row_no.
    quality: batch, row, field, parsed_value, quality_flags, excluded (a reason or null). All row rules are one pass.
    """
    zero = lambda v: (v == 0) & F.arrays_overlap("quality_flags", F.array(*map(F.lit, MISSING_FLAGS)))
    odd = F.exists("quality_flags", lambda f: ~f.isin(*FLAGS)) | (F.array_sort(F.array_distinct("quality_flags")) != F.col("quality_flags"))
    missing = F.arrays_overlap("quality_flags", F.array(*map(F.lit, MISSING_FLAGS)))
    consistent = F.when(F.col("value").isNull(), missing | _has("DUPLICATE_CONFLICT")).otherwise(~missing & F.col("parse_status").eqNullSafe("NUMERIC"))
    expected = F.create_map(*[x for k, (u, _) in MEASUREMENTS.items() for x in (F.lit(k), F.lit(u))])
    rules = {
        "verified_measurement_types_only": ~F.coalesce(F.col("measurement_type").isin(*MEASUREMENTS), F.lit(False)),
        "unit_matches_measurement_type": ~F.try_element_at(expected, F.col("measurement_type")).eqNullSafe(F.col("unit")),
        "identity_complete": (F.coalesce("sensor_id", F.lit("")) == "") | (F.coalesce("site_id", F.lit("")) == "") | F.col("t").isNull(),
        "value_matches_status_and_flags": ~consistent,
        "usable_matches_flags": F.col("usable") != (F.col("value").isNotNull() & (F.size(blocking()) == 0)),
        "no_future_observation": F.col("t") > F.col("first_retrieved_us") + 10 * MINUTE,
        "timezone_assumption_marked": F.col("timezone_status").isNull() | ((F.col("timezone_status") == "UNSPECIFIED_ASSUMED") & ~_has("TIMEZONE_ASSUMED")),
        "provenance_complete": (F.col("duplicate_count") != F.size("provenance")) | (F.size("provenance") <= 0) | ((F.col("duplicate_count") == 1) != (F.col("duplicate_status") == "UNIQUE")) | F.exists("provenance", lambda p: p["batch"].isNull() | p["row"].isNull()),
        "conflicts_unresolved": (F.col("duplicate_status") == "CONFLICT") & ~(F.col("value").isNull() & (F.size("conflicting_values") >= 2)),
        "usable_rainfall_non_negative": F.col("usable") & F.col("measurement_type").startswith("RAINFALL") & (F.col("value") < 0),
        "zero_is_not_missing": zero(F.col("value")),
        "quality_flags_known": odd,
    }
    by_row = obs.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    more = quality.agg(F.count_if(F.coalesce(zero(F.col("parsed_value")), F.lit(False))).alias("zero_is_not_missing"), F.count_if(F.coalesce(odd, F.lit(False))).alias("quality_flags_known"))
    key = ["source", "sensor_id", "measurement_type", "t"]
    again = repeated_keys(obs, key).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("canonical_key_unique"))
    order = disorder(obs.select("row_no", F.struct(*key).alias("k"), F.lit(0).alias("all")), ["all"], "row_no", "k").agg(F.coalesce(F.sum("out_of_order"), F.lit(0)).alias("chronological_order"))
    entering = quality.where("excluded is null").select("batch", "row", "field", F.lit(1).alias("n"))
    used = obs.select(F.explode("provenance").alias("p")).select("p.batch", "p.row", "p.field", F.lit(-1).alias("n"))
    lost = entering.union(used).groupBy("batch", "row", "field").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("no_row_lost"))
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("n")) for c in df.columns])).alias("s")).select("s.name", "s.n")
    out = long(by_row).union(long(more)).union(long(again)).union(long(order)).union(long(lost))
    return out.groupBy("name").agg(F.sum("n").alias("failing")).select("name", (F.col("failing") == 0).alias("passed"), "failing")
