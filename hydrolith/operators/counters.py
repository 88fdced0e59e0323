"""Cumulative series: whether a sensor reports intervals or an accumulated total, and increments restored over its restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE, percent_of, round6
from hydrolith.operators import blocks


def steps(series: DataFrame, cadence: int) -> DataFrame:
    """Usable rows of series (sensor, t, value, usable) with the usable row before (`from_t`, `from_value`), `regular` (exactly a cadence apart) and `falls` (the value is lower)."""
    rows = blocks.chained(series.where("usable and value is not null").select("sensor", "t", "value"), ["sensor"], ["t"], blocks.by_time(), before={"from_t": "t", "from_value": "value"})
    return rows.withColumns({"regular": F.coalesce(F.col("t") - F.col("from_t") == cadence * MINUTE, F.lit(False)), "falls": F.coalesce(F.col("value") < F.col("from_value"), F.lit(False))})


def semantics(series: DataFrame, cadence: int, low: float = 0.1, least_steps: int = 24, rising: float = 95.0, restarts: float = 80.0) -> DataFrame:
    """(sensor, steps, falls, restarts, rising_pct, verdict): ACCUMULATED, INTERVAL or UNDETERMINED, by the regular steps of each sensor.

    A total never falls but when it starts again: at least `rising` percent of its steps don't fall, and of those that do
    at least `restarts` percent fall to no more than `low` of the value before. Fewer than least_steps steps decide nothing.
    """
    s = steps(series, cadence).where("regular")
    restart = F.col("falls") & (F.col("value") <= low * F.col("from_value"))
    g = s.groupBy("sensor").agg(F.count("*").alias("steps"), F.count_if("falls").alias("falls"), F.count_if(restart).alias("restarts"))
    share = percent_of(F.col("steps") - F.col("falls"), F.col("steps"))
    total = (share >= rising) & (100 * F.col("restarts") >= restarts * F.col("falls"))
    return g.select("*", share.alias("rising_pct"), F.when(F.col("steps") < least_steps, "UNDETERMINED").when(total, "ACCUMULATED").otherwise("INTERVAL").alias("verdict"))


def increments(series: DataFrame, cadence: int) -> DataFrame:
    """Usable rows of a cumulative series with `increment`, `restarted` and `total`: what fell since the row before, and since the first.

    A value below the one before is a restart: the counter began at zero in between, so the value itself is what fell at
    least. A sensor's first row has no increment, and one over missing rows holds all that fell meanwhile (`regular` false).
    """
    s = steps(series, cadence)
    add = F.when(F.col("from_t").isNotNull(), F.when(F.col("falls"), F.col("value")).otherwise(F.col("value") - F.col("from_value")))
    s = s.withColumn("increment", round6(add))
    out = blocks.running(s, ["sensor"], [F.col("t")], blocks.by_time(), {"total": F.col("increment")})
    return out.select("sensor", "t", "value", "increment", F.col("falls").alias("restarted"), "regular", round6(F.col("total")).alias("total"))


def consistency(rows: DataFrame, cadence: int, tolerance: float = 1e-6) -> DataFrame:
    """(sensor, name, matches, checked): how often fields of one history agree, as evidence of what they mean.

    rows: (sensor, t, raw, clean, daily, yearly), numbers or null. Checked are rows a cadence after the one before:
    raw and clean against the step of the yearly total, the daily total against the one before plus raw (but for a day's first row),
    and clean against the sum of raw over three rows.
    """
    names = ("raw", "clean", "daily", "yearly")
    two = blocks.chained(rows.select("sensor", "t", *names), ["sensor"], ["t"], blocks.by_time(), before={"_t": "t", **{f"_{c}": c for c in names}}, keep_block=True)
    three = blocks.chained(two, ["sensor"], ["t"], F.col(blocks.BLOCK), before={"_tt": "_t", "_rr": "_raw"})
    step = cadence * MINUTE
    near = F.col("t") - F.col("_t") == step
    day_start = F.pmod(F.col("t"), F.lit(1440 * MINUTE)) == step
    same = lambda a, b: F.when(near, F.abs(a - b) < tolerance)
    rise = F.col("yearly") - F.col("_yearly")
    both = F.when(rise.isNotNull() & F.col("raw").isNotNull() & F.col("clean").isNotNull(), rise)
    checks = {
        "raw_eq_yearly_step": same(both, F.col("raw")),
        "clean_eq_yearly_step": same(both, F.col("clean")),
        "daily_eq_previous_plus_raw": F.when(~day_start, same(F.col("daily") - F.col("_daily"), F.col("raw"))),
        "clean_eq_raw_sum": F.when(F.col("_t") - F.col("_tt") == step, same(F.col("raw") + F.col("_raw") + F.col("_rr"), F.col("clean"))),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("ok")) for n, c in checks.items()]))
    return three.select("sensor", each.alias("c")).groupBy("sensor", "c.name").agg(F.count_if("c.ok").alias("matches"), F.count("c.ok").alias("checked"))
