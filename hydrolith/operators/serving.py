"""What a dashboard or an interface reads: ranges, pages, attention order, chart gaps, cadence and freshness summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE, minutes_between, percent_of

DAY = 1440 * MINUTE


def steps(series: DataFrame, block_minutes: int = 1440, keep: tuple[str, ...] = ()) -> DataFrame:
    """(sensor, t, prev_t, *keep): each row with the instant of the row before it, null for a sensor's first.

    Rows are ordered inside (sensor, block) and only one row for each block goes into the sensor's own window, so a
    sensor with very many rows is spread over tasks. Rows of one instant have it as their predecessor too.
    """
    rows = series.withColumn("_block", F.floor(F.col("t") / (block_minutes * MINUTE)))
    last = rows.groupBy("sensor", "_block").agg(F.max("t").alias("_end"))
    before = last.select("sensor", "_block", F.lag("_end").over(Window.partitionBy("sensor").orderBy("_block")).alias("_before"))
    own = F.lag("t").over(Window.partitionBy("sensor", "_block").orderBy("t"))
    return rows.withColumn("_own", own).join(before, ["sensor", "_block"]).select("sensor", "t", F.coalesce("_own", "_before").alias("prev_t"), *keep)


def series_summary(series: DataFrame) -> DataFrame:
    """Rows, usable rows, first and last instant of each sensor, and its largest gap between usable rows in minutes."""
    whole = series.groupBy("sensor").agg(F.count("*").alias("observations"), F.count_if("usable").alias("usable"), F.min("t").alias("first_us"), F.max("t").alias("last_us"))
    gaps = steps(series.where("usable")).groupBy("sensor").agg(F.max(minutes_between(F.col("t"), F.col("prev_t"))).alias("largest_gap_minutes"))
    return whole.join(gaps, "sensor", "left")


def cadence_summary(series: DataFrame) -> DataFrame:
    """Dominant step (the shortest of the most frequent), share of other steps, largest step and repeated instants.

    Steps are counted by length first; only a row for each distinct step reaches the sensor's group.
    """
    step = minutes_between(F.col("t"), F.col("prev_t")).alias("step")
    counted = steps(series).where("prev_t is not null").select("sensor", step).groupBy("sensor", "step").agg(F.count("*").alias("n"))
    return counted.groupBy("sensor").agg(
        F.max_by("step", F.struct("n", -F.col("step"))).alias("dominant_minutes"),
        percent_of(F.sum("n") - F.max("n"), F.sum("n")).alias("irregular_pct"),
        F.max("step").alias("largest_minutes"),
        F.sum(F.when(F.col("step") == 0, F.col("n")).otherwise(0)).alias("duplicates"),
    )


def chart_rows(series: DataFrame, interval_minutes: int, factor: int = 2) -> DataFrame:
    """(sensor, t, value, is_break): unusable values are null, and a null row stands one interval after the row before a longer gap."""
    gap = F.col("t") - F.col("prev_t") > factor * interval_minutes * MINUTE
    row = F.struct(F.col("t"), F.when(F.col("usable"), F.col("value")).alias("value"), F.lit(False).alias("is_break"))
    hole = F.struct((F.col("prev_t") + interval_minutes * MINUTE).alias("t"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("is_break"))
    rows = steps(series, keep=("value", "usable"))
    return rows.select("sensor", F.explode(F.when(gap, F.array(row, hole)).otherwise(F.array(row))).alias("r")).select("sensor", "r.*")


def in_range(rows: DataFrame, time: str, start: int, end: int) -> DataFrame:
    """Rows from start to end, both included; the predicate reaches the scan."""
    return rows.where(F.col(time).between(start, end))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` from 0 in a total order."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def worst_state(rows: DataFrame, by: list[str], state: str, ranks: list[str]) -> DataFrame:
    """The state of each group that stands last in `ranks`; states that are not listed rank below all."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(state))
    return rows.groupBy(*by).agg(F.max_by(state, F.struct(rank, state)).alias(state))


def threshold_order(low: Column, middle: Column, high: Column) -> Column:
    """ok for strictly ascending thresholds, not_ascending, or missing."""
    return F.when(low.isNull() | middle.isNull() | high.isNull(), "missing").when((low < middle) & (middle < high), "ok").otherwise("not_ascending")
