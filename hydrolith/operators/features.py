"""The whole feature row of each usable origin, from one shuffle into time blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.functions.core import calendar, minutes_between, round6
from hydrolith.operators import blocks
from hydrolith.operators.contracts import require_unique
from hydrolith.operators.joins import with_dimension
from hydrolith.operators.windows import at_lag, in_blocks, level_columns, rolling_columns


def feature_rows(
    series: DataFrame,
    windows: tuple[int, ...],
    antecedent: tuple[int, ...],
    lags: tuple[int, ...],
    level_windows: tuple[int, ...],
    cadence: int,
    wet: float = 0.0,
    offset_minutes: int = 0,
    metadata: DataFrame | None = None,
) -> DataFrame:
    """Usable rows of series (sensor, t, value, usable) with all their features: rolling and antecedent sums, lags, minutes since the last wet row, level changes, calendar, and the sensor's metadata.

    A repeated (sensor, t), or a sensor that the metadata (sensor, ...) has twice, is an error: a feature row is made of one
    observation. All bounded windows are computed over the same blocks of time; the look-back for a wet row has no bound and is carried
    from block to block. The calendar is that of the local clock, offset_minutes ahead of UTC.
    """
    require_unique(series, ["sensor", "t"])
    wet_at = F.when(F.col("usable") & (F.col("value") > wet), F.col("t"))
    rows = blocks.running(series.select("sensor", "t", "value", "usable"), ["sensor"], [F.col("t")], blocks.by_time(), {"_wet": wet_at}, "max")
    columns = rolling_columns(windows, cadence, wet=wet) | rolling_columns(antecedent, cadence, wet=wet, prefix="rf_antecedent", kinds=("sum", "coverage", "wet_count"))
    columns |= {f"rf_lag_{m}m": round6(at_lag(F.col("value"), m)) for m in lags} | level_columns(level_windows, cadence)
    cut = in_blocks(rows, max(*windows, *antecedent, *lags, *level_windows))
    out = cut.withColumns(columns).where("own and usable").drop("block", "own", "usable")
    out = out.withColumn("rf_minutes_since_last_wet", minutes_between(F.col("t"), F.col("_wet"))).drop("_wet")
    local = F.timestamp_add("MICROSECOND", F.col("t") + offset_minutes * 60_000_000, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    out = out.withColumns(calendar(local))
    return out if metadata is None else with_dimension(out, require_unique(metadata, ["sensor"]), ["sensor"])
