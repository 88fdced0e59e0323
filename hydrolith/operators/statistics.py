"""Guarded statistics and evaluation metrics. A statistic without enough samples is null with a status, not a number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE, percent_of, round6
from hydrolith.operators import blocks, selection


def needed(q: float, tail: int = 5) -> int:
    """Fewest samples at which quantile q is reported."""
    return math.ceil(tail / min(q, 1 - q) - 1e-9)


def describe(rows: DataFrame, by: list[str], value: str = "value", quantiles: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Count, sum, mean, extremes, sample deviation, adjusted skewness and interpolated quantiles, each under its guard."""
    n = F.count(value)
    sd = F.stddev_samp(value)
    skew = F.skewness(value) * F.sqrt(n * (n - 1.0)) / (n - 2)
    aggs = [n.alias("n"), round6(F.sum(value)).alias("total"), round6(F.avg(value)).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.when(n > 1, round6(sd)).alias("std"), F.when((n > 2) & (sd > 0), F.round(skew, 4)).alias("skew")]
    wide = selection.quantiles(rows, by, value, quantiles, aggs)
    return wide.select(*[c for c in wide.columns if c != "quantiles"], *[F.when(F.col("n") >= needed(q), round6(F.col("quantiles")[k])).alias(f"p{round(q * 100)}") for k, q in enumerate(quantiles)])


def concentration(rows: DataFrame, by: list[str], value: str = "value", share: float = 0.5) -> DataFrame:
    """Fewest largest values that hold `share` of the total."""
    some = rows.where(F.col(value) > 0)
    cut = selection.by_rank(some.withColumn("_tie", selection.told_apart(some)), [F.desc(value), F.col("_tie")]).withColumn("_unique", F.monotonically_increasing_id())
    order = [F.desc(value), F.col("_tie"), F.col("_unique")]
    ranked = blocks.chained(cut, by, order, F.col(blocks.BLOCK), running={"_reached": F.col(value), "_place": F.lit(1)}, totals={"_whole": "_reached"})
    return ranked.where(F.col("_reached") >= F.col("_whole") * share).groupBy(*by).agg(F.min("_place").cast("int").alias("intervals"))


def covered_days(rows: DataFrame, day: Column, slots_per_day: int, least: float = 0.8) -> DataFrame:
    """(sensor, day, usable) of days with enough usable slots."""
    return rows.where("usable").groupBy("sensor", day.alias("day")).agg(F.count("*").alias("usable_slots")).where(F.col("usable_slots") >= math.ceil(least * slots_per_day - 1e-9))


def confusion(rows: DataFrame, by: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Counts, precision, recall, F1 and accuracy; a zero denominator gives null, F1 is 0 when both are 0."""
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    tp, fp, fn, tn = (F.count_if(c) for c in (y & p, ~y & p, y & ~p, ~y & ~p))
    g = rows.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).when(precision + recall == 0, 0.0)
    return g.select(*by, "tp", "fp", "fn", "tn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("accuracy"))


def average_precision(rows: DataFrame, by: list[str], score: str, truth: str, tie: str) -> DataFrame:
    """Mean over positives of hits by rank; ties of the score go by `tie`; null with a single class."""
    cut = selection.by_rank(rows, [F.desc(score), F.col(tie)])
    ranked = blocks.chained(cut, by, [F.desc(score), F.col(tie)], F.col(blocks.BLOCK), running={"place": F.lit(1), "hits": F.col(truth)})
    pos = F.sum(truth)
    ap = F.sum(F.when(F.col(truth) == 1, F.col("hits") / F.col("place"))) / pos
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), pos.alias("positives"), F.when((pos > 0) & (pos < F.count("*")), round6(ap)).alias("average_precision"))


def threshold_grid(rows: DataFrame, score: str, truth: str, grid: tuple[float, ...] = tuple(k / 10 for k in range(1, 10))) -> DataFrame:
    """(threshold, tp, fp, fn, f1, best): the lowest threshold of the largest F1 is best."""
    at = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, grid)))).withColumn("predicted", (F.col(score) >= F.col("threshold")).cast("int"))
    g = confusion(at, ["threshold"], truth).select("threshold", "tp", "fp", "fn", "f1")
    best = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("f1"), "threshold")) == 1
    return g.withColumn("best", best)


def errors(rows: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    e = F.col(truth) - F.col(predicted)
    return rows.groupBy(*by).agg(F.count(e).alias("n"), round6(F.avg(F.abs(e))).alias("mae"), round6(F.sqrt(F.avg(e * e))).alias("rmse"))


def coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Slot-weighted coverage of a grid: usable over expected slots."""
    return rows.groupBy(*by).agg(F.count("*").alias("expected"), F.count_if(F.col("state") == "USABLE").alias("usable"), percent_of(F.count_if(F.col("state") == "USABLE"), F.count("*")).alias("coverage_pct"))


def interval_day(t: Column, interval_minutes: int, offset_minutes: int = 0) -> Column:
    """Day of the start of the interval that ends at t: rain that falls up to midnight is that day's."""
    return F.floor((t + (offset_minutes - interval_minutes) * MINUTE) / (1440 * MINUTE))


def persistence_pairs(series: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(sensor, horizon, t, predicted, truth): the level at t as the forecast of the usable one at exactly t + horizon."""
    good = series.where("usable")
    asked = good.select("sensor", "t", F.col("value").alias("predicted"), F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    asked = asked.withColumn("target_t", F.col("t") + F.col("horizon").cast("bigint") * MINUTE)
    return asked.join(good.select("sensor", F.col("t").alias("target_t"), F.col("value").alias("truth")), ["sensor", "target_t"]).drop("target_t")


def station_errors(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute error, root mean square error and bias of predicted against truth."""
    e = F.col("predicted") - F.col("truth")
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), round6(F.avg(F.abs(e))).alias("mae"), round6(F.sqrt(F.avg(e * e))).alias("rmse"), round6(F.avg(e)).alias("bias"))


def overall_errors(pairs: DataFrame, by: list[str], station: str) -> DataFrame:
    """Over all stations: the error weighed by samples, and the mean of the stations' root mean square errors."""
    e = F.col("predicted") - F.col("truth")
    s = pairs.groupBy(*by, station).agg(F.count("*").alias("k"), F.avg(F.abs(e)).alias("m"), F.sqrt(F.avg(e * e)).alias("r"))
    return s.groupBy(*by).agg(F.sum("k").alias("n"), round6(F.sum(F.col("k") * F.col("m")) / F.sum("k")).alias("mae"), round6(F.avg("r")).alias("mean_station_rmse"))
