"""Local time texts of sources in zones with daylight saving: instants, folds and gaps, dates without a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE, first_of, micros

HOUR_US, DAY_US = 60 * MINUTE, 1440 * MINUTE


def _offset(us: Column, zone: Column) -> Column:
    """Microseconds that a zone's clocks are ahead of UTC at an instant."""
    ntz = F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return micros(F.convert_timezone(F.lit("UTC"), zone, ntz)) - us


def zone_years(spark: SparkSession, zones: list[str], first: int = 1970, last: int = 2100) -> DataFrame:
    """(zone, year, offset, changes): a zone's offset at a local year's start, and its changes (from_us, upto_us, before, after) in that year, in order.

    Local times from from_us up to upto_us occur twice (clocks go back) or never. Taken from Spark's own zone data: days over
    which the offset changes, then the minute. One row for each zone and year, whatever the size of the data.
    """
    years = spark.createDataFrame([(z,) for z in zones], "zone string").withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    start = lambda year: micros(F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    days = years.withColumn("a", start(F.col("year"))).withColumn("b", start(F.col("year") + 1))
    days = days.withColumn("d", F.explode(F.sequence(F.col("a") - DAY_US, F.col("b") + DAY_US, F.lit(DAY_US))))
    turned = days.where(_offset(F.col("d"), F.col("zone")) != _offset(F.col("d") + DAY_US, F.col("zone")))
    minutes = turned.withColumn("m", F.explode(F.sequence(F.col("d"), F.col("d") + DAY_US - MINUTE, F.lit(MINUTE))))
    at = minutes.withColumns({"before": _offset(F.col("m"), F.col("zone")), "after": _offset(F.col("m") + MINUTE, F.col("zone"))}).where("before <> after")
    change = at.withColumns({"from_us": F.col("m") + MINUTE + F.least("before", "after"), "upto_us": F.col("m") + MINUTE + F.greatest("before", "after")}).where("from_us >= a and from_us < b")
    of_year = change.groupBy("zone", "year").agg(F.array_sort(F.collect_set(F.struct("from_us", "upto_us", "before", "after"))).alias("changes"))
    out = years.join(of_year, ["zone", "year"], "left").withColumn("changes", F.coalesce("changes", F.array().cast("array<struct<from_us:bigint,upto_us:bigint,before:bigint,after:bigint>>")))
    local = start(F.col("year"))
    early = _offset(local - _offset(local, F.col("zone")), F.col("zone"))
    return out.withColumn("offset", F.when(F.size("changes") > 0, F.when(F.col("changes")[0]["from_us"] > local, F.col("changes")[0]["before"]).otherwise(early)).otherwise(early))


def normalised_times(rows: DataFrame, text: str, formats: list[tuple[str, str]], years: DataFrame, zone: str, reference_us: str, skew_minutes: int = 10) -> DataFrame:
    """rows, with all their columns, and what a local time text says: `time_status`, `time_detail`, `time_precision`, `time_us`, `local_date`, `utc_offset_minutes`, `timezone_name`, `timezone_status`.

    formats: (pattern, DATE, MINUTE or SECOND), the first that reads the text counts; a pattern with XXX takes the offset from the text
    (EXPLICIT_IN_SOURCE). Else the zone is that of the column `zone`, assumed by a policy (UNSPECIFIED_ASSUMED), or none (UNSPECIFIED_NO_POLICY).
    Status: MISSING for blank or null texts, INVALID_FORMAT, UNSPECIFIED_TIMEZONE without a policy's zone, AMBIGUOUS for local
    times that a zone has twice (detail FOLD, with the earlier instant's and the later one's offset untold) or never (GAP),
    FUTURE later than the reference by more than the skew, or VALID. A DATE is a label: valid, with a date, without an instant.
    A zone or year that `years` lacks counts as no policy. `years` (zone_years) is bounded by zones and years, so it is broadcast.
    """
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    # texts without an offset are read as UTC, whatever the session's zone is, and that only to get the local clock's number
    read, precision, explicit = [], [], []
    for pattern, kind in formats:
        own = "XXX" in pattern
        read.append(F.unix_micros(F.try_to_timestamp(t, F.lit(pattern)) if own else F.try_to_timestamp(F.concat(t, F.lit(" +00:00")), F.lit(f"{pattern} XXX"))))
        precision.append(kind)
        explicit.append(own)
    first = F.coalesce(*[F.when(r.isNotNull(), F.struct(r.alias("us"), F.lit(p).alias("precision"), F.lit(e).alias("explicit"))) for r, p, e in zip(read, precision, explicit, strict=True)])
    d = rows.withColumn("_p", first).withColumn("_year", F.year(F.timestamp_add("MICROSECOND", F.col("_p.us"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))))
    right = years.select(F.col("zone").alias("_zone"), F.col("year").alias("_of"), F.col("offset").alias("_offset"), F.col("changes").alias("_changes"))
    d = d.join(F.broadcast(right), (F.col(zone) == F.col("_zone")) & (F.col("_year") == F.col("_of")), "left")
    us, own, dated = F.col("_p.us"), F.coalesce(F.col("_p.explicit"), F.lit(False)), F.col("_p.precision") == "DATE"
    past = F.filter("_changes", lambda c: c["from_us"] <= us)
    latest = F.try_element_at(past, F.lit(-1))
    unclear = F.coalesce(us < latest["upto_us"], F.lit(False)) & ~own & ~dated
    offset = F.when(own, F.lit(None)).otherwise(F.coalesce(latest["after"], F.col("_offset")))
    known = own | F.col("_zone").isNotNull()
    at = F.when(own, us).otherwise(us - offset)
    status = first_of(
        (t == "", "MISSING"), (us.isNull(), "INVALID_FORMAT"), (~known, "UNSPECIFIED_TIMEZONE"), (dated, "VALID"), (unclear, "AMBIGUOUS"),
        (at > F.col(reference_us) + skew_minutes * MINUTE, "FUTURE"), (F.lit(True), "VALID"),
    )
    d = d.withColumn("time_status", status)
    placed = F.col("time_status").isin("VALID", "FUTURE") & ~dated
    local_day = F.date_format(F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd")
    return d.select(
        *rows.columns, "time_status", F.when(unclear, F.when(latest["after"] < latest["before"], "FOLD").otherwise("GAP")).alias("time_detail"), F.col("_p.precision").alias("time_precision"),
        F.when(placed, at).alias("time_us"), F.when(dated, local_day).alias("local_date"), F.when(placed, (offset / MINUTE).cast("int")).alias("utc_offset_minutes"),
        F.when(us.isNotNull() & known & ~own, F.col("_zone")).alias("timezone_name"),
        F.when(us.isNotNull(), F.when(own, "EXPLICIT_IN_SOURCE").when(known, "UNSPECIFIED_ASSUMED").otherwise("UNSPECIFIED_NO_POLICY")).alias("timezone_status"),
    )
