"""Point-in-time window features over per-sensor series: (sensor, t, value, usable), t in microseconds.

Trailing windows are left-open and right-closed. Windows of bounded length are computed in time blocks: each row goes to
its own block, and once more to the next as history, so that a sensor with very many rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE, minutes_between, round6
from hydrolith.operators import blocks

BLOCKS = 24


def in_blocks(series: DataFrame, reach_minutes: int) -> DataFrame:
    """series with (block, own): every row in its block, and as history in the next; reach is the longest look-back."""
    block = F.floor(F.col("t") / F.lit(max(reach_minutes, 1) * BLOCKS * MINUTE)).cast("bigint")
    late = F.pmod(F.col("t"), F.lit(max(reach_minutes, 1) * BLOCKS * MINUTE)) >= F.lit((BLOCKS - 1) * max(reach_minutes, 1) * MINUTE)
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    more = F.struct((block + 1).alias("block"), F.lit(False).alias("own"))
    return series.withColumn("_b", F.explode(F.when(late, F.array(own, more)).otherwise(F.array(own)))).select("*", "_b.block", "_b.own").drop("_b")


def trailing(minutes: int) -> Window:
    return Window.partitionBy("sensor", "block").orderBy("t").rangeBetween(-minutes * MINUTE + 1, 0)


def at_lag(value: Column, minutes: int) -> Column:
    """Usable value at exactly t - minutes, else null."""
    w = Window.partitionBy("sensor", "block").orderBy("t").rangeBetween(-minutes * MINUTE, -minutes * MINUTE)
    return F.max(F.when(F.col("usable"), value)).over(w)


def rolling_columns(windows: tuple[int, ...], cadence: int, least: float = 0.8, wet: float = 0.0, prefix: str = "rf_roll", kinds: tuple[str, ...] = ("sum", "max", "wet_count", "coverage", "is_wet")) -> dict[str, Column]:
    """Columns over a block's rows: sum, max, wet count, coverage and wet flag of each window, null where coverage is under `least`."""
    value = F.when(F.col("usable"), F.col("value"))
    out: dict[str, Column] = {}
    for m in windows:
        w = trailing(m)
        n = F.count(value).over(w)
        cover = F.round(n / float(m // cadence), 6)
        gate = (cover >= least) & (n > 0)
        total = F.sum(value).over(w)
        made = {"sum": F.when(gate, round6(total)), "max": F.when(gate, round6(F.max(value).over(w))), "wet_count": F.when(gate, F.count(F.when(value > wet, 1)).over(w)), "coverage": cover, "is_wet": F.when(gate, (round6(total) > wet).cast("int"))}
        out |= {f"{prefix}_{m}m_{k}": made[k] for k in kinds}
    return out


def rolling(series: DataFrame, windows: tuple[int, ...], cadence: int, least: float = 0.8, wet: float = 0.0, prefix: str = "rf_roll") -> DataFrame:
    """Usable rows with sum, max, wet count, coverage and wet flag of each window, null where coverage is under `least`."""
    cut = in_blocks(series, max(windows))
    return cut.withColumns(rolling_columns(windows, cadence, least, wet, prefix)).where("own and usable").drop("block", "own")


def lags(series: DataFrame, minutes: tuple[int, ...], prefix: str = "rf_lag") -> DataFrame:
    """Usable rows with the usable value at each exact earlier instant."""
    out = {f"{prefix}_{m}m": round6(at_lag(F.col("value"), m)) for m in minutes}
    return in_blocks(series, max(max(minutes), 1)).withColumns(out).where("own and usable").drop("block", "own")


def minutes_since(series: DataFrame, above: float, name: str = "rf_minutes_since_last_wet") -> DataFrame:
    """Usable rows with the minutes since the latest usable row over `above`, itself included, without limit of look-back."""
    wet = F.when(F.col("usable") & (F.col("value") > above), F.col("t"))
    rows = blocks.running(series, ["sensor"], [F.col("t")], blocks.by_time(), {"_last": wet}, "max")
    return rows.withColumn(name, minutes_between(F.col("t"), F.col("_last"))).drop("_last").where("usable")


def level_changes(series: DataFrame, windows: tuple[int, ...], cadence: int, least: float = 0.8, tolerance: float = 0.01) -> DataFrame:
    """Usable rows with exact delta, rate per hour, gated min, max, mean, range, coverage and trend of each window."""
    return in_blocks(series, max(windows)).withColumns(level_columns(windows, cadence, least, tolerance)).where("own and usable").drop("block", "own")


def level_columns(windows: tuple[int, ...], cadence: int, least: float = 0.8, tolerance: float = 0.01) -> dict[str, Column]:
    """Columns over a block's rows: see level_changes."""
    value = F.when(F.col("usable"), F.col("value"))
    out: dict[str, Column] = {}
    for m in windows:
        w = trailing(m)
        n = F.count(value).over(w)
        cover = F.round(n / float(m // cadence), 6)
        gate = (cover >= least) & (n > 0)
        delta = round6(F.col("value") - at_lag(F.col("value"), m))
        low, high = F.min(value).over(w), F.max(value).over(w)
        first = F.min(F.when(value.isNotNull(), F.struct("t", "value"))).over(w)["value"]
        move = F.coalesce(delta, F.col("value") - first)
        out[f"wl_delta_{m}m"] = delta
        out[f"wl_rate_{m}m"] = round6((F.col("value") - at_lag(F.col("value"), m)) / (m / 60.0))
        out[f"wl_min_{m}m"] = F.when(gate, round6(low))
        out[f"wl_max_{m}m"] = F.when(gate, round6(high))
        out[f"wl_mean_{m}m"] = F.when(gate, round6(F.avg(value).over(w)))
        out[f"wl_range_{m}m"] = F.when(gate, round6(high - low))
        out[f"wl_coverage_{m}m"] = cover
        out[f"wl_trend_{m}m"] = F.when(gate, F.when(move > tolerance, "RISING").when(move < -tolerance, "FALLING").otherwise("STABLE"))
    return out


def threshold_distance(series: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Usable rows with value minus each threshold of the sensor: (sensor, threshold_type, threshold) in long form."""
    return series.where("usable").join(thresholds, "sensor").withColumn("distance", round6(F.col("value") - F.col("threshold")))
