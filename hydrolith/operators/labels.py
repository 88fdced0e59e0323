"""Multi-horizon labels, splits with embargo, and preprocessing that is fitted on training rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE, round6
from hydrolith.operators import selection


def horizon_labels(series: DataFrame, thresholds: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Long labels: each usable origin, horizon and threshold of the sensor, with the usable row at exactly t + h.

    Both sides are joined on (sensor, instant), so rows of one sensor are spread by instant.
    """
    origins = series.where("usable").select("sensor", "t", "value").withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    origins = origins.withColumn("target_t", F.col("t") + F.col("horizon").cast("bigint") * MINUTE)
    future = series.where("usable").select("sensor", F.col("t").alias("target_t"), F.col("value").alias("target"))
    rows = origins.join(future, ["sensor", "target_t"], "left").join(thresholds, "sensor")
    known = F.col("target").isNotNull()
    return rows.select(
        "sensor", F.col("t").alias("origin_us"), "horizon", "threshold_type",
        F.when(known, "TARGET_EVALUATED").otherwise("MISSING_FUTURE_TARGET").alias("status"),
        round6(F.col("target") - F.col("value")).alias("delta"),
        F.when(known, F.col("target") >= F.col("threshold")).alias("exceeds"),
        F.when(known, (F.col("value") < F.col("threshold")) & (F.col("target") >= F.col("threshold"))).alias("escalates"),
    )


def prevalence(labels: DataFrame) -> DataFrame:
    """Per horizon and threshold: evaluable origins, positives, escalations, prevalence and negatives per positive."""
    n, p = F.count("exceeds"), F.count_if(F.col("exceeds"))
    return labels.groupBy("horizon", "threshold_type").agg(
        F.count("*").alias("origins"), n.alias("evaluable"), p.alias("positives"), F.count_if(F.col("escalates")).alias("escalations"),
        F.when(n > 0, F.round(100.0 * p / n, 2)).alias("prevalence_pct"), F.when(p > 0, F.round((n - p) / p, 4)).alias("negatives_per_positive"),
    )


def wide_labels(labels: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """One row for each origin and threshold, a column for each horizon."""
    return labels.groupBy("sensor", "origin_us", "threshold_type").pivot("horizon", list(horizons)).agg(F.first("exceeds"))


def chronological_split(t: Column, train_end: int, validation_end: int, embargo_minutes: int = 120) -> Column:
    gap = embargo_minutes * MINUTE
    return (
        F.when(t <= train_end, F.when(t <= train_end - gap, "train").otherwise("purged"))
        .when(t <= validation_end, F.when(t <= validation_end - gap, "validation").otherwise("purged"))
        .otherwise("test")
    )


def _in_fold(fold: int):
    return lambda part: F.struct(F.lit(fold).alias("fold"), part.alias("part"))


def walk_forward(rows: DataFrame, boundaries: list[int], embargo_minutes: int = 120) -> DataFrame:
    """(fold, part, ...) for each expanding fold; the first fold validates on its own training rows."""
    gap, bounds = embargo_minutes * MINUTE, sorted(boundaries)
    parts = []
    for k, b in enumerate(bounds):
        since = bounds[k - 1] if k else None
        after = F.lit(True) if since is None else F.col("t") > since
        part = F.array_compact(F.array(F.when(F.col("t") <= b - gap, "train"), F.when((F.col("t") <= b - gap) & after, "validation"), F.when((F.col("t") > b - gap) & (F.col("t") <= b) & after, "purged")))
        parts.append(F.transform(part, _in_fold(k + 1)))
    return rows.withColumn("_p", F.explode(F.concat(*parts))).select("*", "_p.fold", "_p.part").drop("_p")


def fit_preprocessor(train: DataFrame, numeric: list[str]) -> DataFrame:
    """Long table (feature, median, mean, std): exact median, and mean and population deviation of the imputed values."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in numeric])).alias("f")).select("f.feature", "f.x")
    median = selection.quantiles(long, ["feature"], "x", (0.5,)).select("feature", F.col("quantiles")[0].alias("median"))
    # one row for each name in `numeric`
    filled = long.join(F.broadcast(median), "feature").withColumn("x", F.coalesce("x", "median"))
    return filled.groupBy("feature", "median").agg(round6(F.avg("x")).alias("mean"), round6(F.stddev_pop("x")).alias("std"))


def class_weights(labels: DataFrame, label: str) -> DataFrame:
    """n / (2 * n_c) for each class."""
    by = labels.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).select(label, "n", F.round(F.col("total") / (2.0 * F.col("n")), 6).alias("weight"))
