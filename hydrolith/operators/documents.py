"""Whole-analysis documents: one nested document for each kind of measurement, from mergeable partials of its days."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.functions.core import percent_of, round6
from hydrolith.operators.statistics import interval_day

_FACTS = ("rows", "usable", "zero", "wet", "total", "square", "least", "most", "first_us", "last_us", "covered_days")


def _summary(n: Column | None = None) -> list[Column]:
    """The fields of a level, in their order: counts, shares, total, guarded mean and deviation, extremes, span."""
    usable, total = F.col("usable"), F.col("total")
    spread = F.col("square") - total * total / usable
    return [
        F.col("rows").alias("rows"), usable.alias("usable"), (F.col("rows") - usable).alias("missing"), percent_of(usable, F.col("rows")).alias("usable_pct"), F.col("zero").alias("zero"), F.col("wet").alias("wet"),
        round6(total).alias("total"), F.when(usable > 0, round6(total / usable)).alias("mean"), F.when(usable > 1, F.round(F.sqrt(F.greatest(spread, F.lit(0.0)) / (usable - 1)), 4)).alias("std"),
        round6(F.col("least")).alias("least"), round6(F.col("most")).alias("most"), F.col("first_us").alias("first_us"), F.col("last_us").alias("last_us"), F.col("covered_days").alias("covered_days"),
    ]


def level_summaries(rows: DataFrame, interval_minutes: int, slots_per_day: int, wet: float = 0.0, least_coverage: float = 0.8, offset_minutes: int = 0) -> DataFrame:
    """(level, measurement_type, sensor, ...): facts of each sensor, of each type, and of the whole network (levels SENSOR, TYPE, NETWORK).

    rows: (sensor, measurement_type, t, value, usable). Days are summed up once; all levels are merged from those partials, by
    grouping sets over one shuffle of them. A covered day has least_coverage of its slots usable.
    """
    value = F.when(F.col("usable"), F.col("value"))
    days = rows.groupBy("measurement_type", "sensor", interval_day(F.col("t"), interval_minutes, offset_minutes).alias("day")).agg(
        F.count("*").alias("rows"), F.count(value).alias("usable"), F.count_if(value == 0).alias("zero"), F.count_if(value > wet).alias("wet"), F.sum(value.cast("decimal(28,6)")).alias("total"),
        F.sum((value * value).cast("decimal(38,6)")).alias("square"), F.min(value).alias("least"), F.max(value).alias("most"), F.min("t").alias("first_us"), F.max("t").alias("last_us"),
    )
    days = days.withColumn("covered_days", (F.col("usable") >= math.ceil(least_coverage * slots_per_day - 1e-9)).cast("bigint"))
    merges = {"least": F.min, "first_us": F.min, "most": F.max, "last_us": F.max}
    key = [F.col("measurement_type"), F.col("sensor")]
    g = days.groupingSets([key, key[:1], []], *key).agg(F.grouping_id().alias("_g"), *[merges.get(c, F.sum)(c).alias(c) for c in _FACTS])
    level = F.when(F.col("_g") == 0, "SENSOR").when(F.col("_g") == 1, "TYPE").otherwise("NETWORK")
    g = g.withColumns({"total": F.coalesce(F.col("total").cast("double"), F.lit(0.0)), "square": F.coalesce(F.col("square").cast("double"), F.lit(0.0))})
    return g.select(level.alias("level"), "measurement_type", "sensor", *_summary())


def analysis_documents(summaries: DataFrame, version: str, definitions: dict[str, str]) -> DataFrame:
    """(measurement_type, document): one JSON text for each type, with its sensors in order, the type's own level and the network's.

    Fields and entries stand in a fixed order, so a document is the same text whatever the partitions. It has an entry for each sensor
    of the type, one summary each, and nothing that grows with rows.
    """
    fields = [c for c in summaries.columns if c not in ("level", "measurement_type")]
    stations = F.array_sort(F.collect_list(F.when(F.col("level") == "SENSOR", F.struct(*fields))))
    own = F.max(F.when(F.col("level") == "TYPE", F.struct(*[c for c in fields if c != "sensor"])))
    network = summaries.where("level = 'NETWORK'").select(F.struct(*[c for c in fields if c != "sensor"]).alias("network"))
    g = summaries.where("level <> 'NETWORK'").groupBy("measurement_type").agg(stations.alias("stations"), own.alias("summary")).crossJoin(F.broadcast(network))
    said = F.struct(*[F.lit(v).alias(k) for k, v in sorted(definitions.items())])
    document = F.struct(F.lit(version).alias("dataset_version"), said.alias("definitions"), "measurement_type", "network", F.size("stations").alias("stations_analysed"), "stations", "summary")
    return g.select("measurement_type", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))
