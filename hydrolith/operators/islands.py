"""Gaps and islands: observation windows, exceedance episodes, change pairs and runs, slot grids and missing runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE, minutes_between, round6
from hydrolith.operators import blocks


def observation_windows(series: DataFrame, gap_minutes: int = 1440) -> DataFrame:
    """series with `window`, from 1: a new one starts where the gap to the row before is longer than gap_minutes."""
    starts = F.coalesce((F.col("t") - F.col("_p") > gap_minutes * MINUTE).cast("int"), F.lit(0))
    rows = blocks.chained(series, ["sensor"], ["t"], blocks.by_time(), before={"_p": "t"}, running={"window": starts})
    return rows.withColumn("window", F.col("window") + 1).drop("_p")


def episodes(series: DataFrame, thresholds: DataFrame, step_minutes: int, gap_minutes: int = 1440) -> DataFrame:
    """One row for each run of exceeding rows of a sensor and threshold within an observation window.

    A run goes on while each exceeding row is at most step_minutes after the exceeding row before. It ends below the
    threshold, by missing data (an unusable row, or a longer step to the next exceeding one), or at the window's edge.
    The index counts on over windows. Rows meet their sensor's thresholds inside their block, which is then cut to runs.
    """
    over = lambda s: F.coalesce(s["usable"] & (s["value"] >= F.col("threshold")), F.lit(False))
    apart = lambda a, b: b["t"] - a["t"]
    found = blocks.runs(
        series, ["sensor"], blocks.by_time(), ["t", "value", "usable"],
        lambda a, b: (over(a) == over(b)) & (~over(b) | (apart(a, b) <= min(step_minutes, gap_minutes) * MINUTE)),
        {"observations": ("sum", lambda s: F.lit(1)), "peak": ("max", lambda s: s["value"])}, {"episode": lambda _, b: over(b)},
        extend=lambda rows: rows.join(thresholds, "sensor"), extra=["threshold_type", "threshold"],
    ).where(over(F.col("first")))
    after, last = F.col("after"), F.col("last")
    reason = F.when(after.isNull() | (apart(last, after) > gap_minutes * MINUTE), "WINDOW_EDGE").when(over(after) | ~after["usable"], "INTERRUPTED_BY_MISSING_DATA").otherwise("ENDED_BELOW_THRESHOLD")
    return found.select(
        "sensor", "threshold_type", "threshold", "episode", F.col("first.t").alias("start_us"), F.col("last.t").alias("end_us"), "observations", round6(F.col("peak")).alias("peak"),
        round6(F.col("peak") - F.col("threshold")).alias("max_exceedance"), reason.alias("termination"), minutes_between(F.col("last.t"), F.col("first.t")).alias("duration_minutes"),
    )


def change_pairs(series: DataFrame, step_minutes: int) -> DataFrame:
    """Each eligible row after the first, with the change from the eligible row before, or the reason of the break."""
    before = {"_ok": "usable", "_t": "t", "_value": "value"}
    latest = F.when(F.col("_ok"), F.struct(F.col("_t").alias("t"), F.col("_value").alias("value")))
    rows = blocks.chained(series, ["sensor"], ["t"], blocks.by_time(), before, running={"_from": latest}, kind="max").where("usable and _from is not null")
    out = rows.select("sensor", F.col("_from.t").alias("from_t"), "t", round6(F.col("value") - F.col("_from.value")).alias("change"), "_ok")
    out = out.withColumn("break_reason", F.when(~F.col("_ok"), "NOT_USABLE_ROW_BETWEEN").when(F.col("t") - F.col("from_t") > step_minutes * MINUTE, "GAP_EXCEEDS_MAX"))
    pair = F.col("break_reason").isNull()
    hours = minutes_between(F.col("t"), F.col("from_t")) / 60.0
    return out.select("sensor", "from_t", "t", "break_reason", F.when(pair, F.col("change")).alias("change"), F.when(pair, round6(F.col("change") / hours)).alias("rate_per_hour"), F.when(pair, F.signum("change").cast("int")).alias("direction"))


def change_runs(series: DataFrame, step_minutes: int) -> DataFrame:
    """Maximal chains of change pairs without a break: sensor, run (from 0, one for each break before), pairs, start, end."""
    near = lambda a, b: (a["usable"] == b["usable"]) & (~b["usable"] | (b["t"] - a["t"] <= step_minutes * MINUTE))
    found = blocks.runs(series, ["sensor"], blocks.by_time(), ["t", "usable"], near, {"rows": ("sum", lambda s: F.lit(1))}, {"run": lambda _, b: b["usable"]})
    return found.where(F.col("first.usable") & (F.col("rows") > 1)).select("sensor", (F.col("run") - 1).alias("run"), (F.col("rows") - 1).alias("pairs"), F.col("first.t").alias("start_us"), F.col("last.t").alias("end_us"))


def slot_grid(series: DataFrame, cadence: int) -> DataFrame:
    """A row for each slot from a sensor's first to its last, with its state: USABLE, NOT_USABLE or ABSENT_SLOT."""
    span = series.groupBy("sensor").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    # whole spans are cut into days before they are exploded, so that no task makes one sensor's whole grid
    day = 1440 * MINUTE
    days = span.select("sensor", "a", "b", F.explode(F.sequence(F.lit(0), F.floor((F.col("b") - F.col("a")) / day))).alias("d")).repartition("sensor", "d")
    first = F.col("a") + F.col("d") * day
    slots = days.select("sensor", F.explode(F.sequence(first, F.least(F.col("b"), first + day - cadence * MINUTE), F.lit(cadence * MINUTE))).alias("t"))
    state = F.when(F.col("usable"), "USABLE").when(F.col("usable").isNull(), "ABSENT_SLOT").otherwise("NOT_USABLE")
    return slots.join(series.select("sensor", "t", "usable"), ["sensor", "t"], "left").select("sensor", "t", state.alias("state"))


def missing_runs(series: DataFrame, cadence: int) -> DataFrame:
    """Maximal runs of usable, or of missing, slots from a sensor's first row to its last, with their lengths and whether they touch an edge.

    Rows lie on the cadence; a slot without a row is missing. Slots between two rows are one gap, however many they are,
    so nothing is made for each of them.
    """
    found = blocks.runs(
        series.withColumn("there", F.lit(True)), ["sensor"], blocks.by_time(), ["t", "usable", "there"], lambda a, b: a["usable"] == b["usable"],
        {"slots": ("sum", lambda s: s["slots"]), "absent_slots": ("sum", lambda s: F.when(s["there"], 0).otherwise(s["slots"]))}, {"run": lambda _, b: F.lit(True)},
        fill=(lambda a, b: F.lit(True), cadence * MINUTE, {"usable": F.lit(False), "there": F.lit(False)}),
    )
    return found.select(
        "sensor", (F.col("run") - 1).alias("run"), F.col("first.usable").alias("usable"), F.col("first.t").alias("start_us"), F.col("last.upto").alias("end_us"), "slots", "absent_slots",
        ((F.col("slots") - 1) * cadence).alias("first_to_last_minutes"), F.col("before").isNull().alias("at_start"), F.col("after").isNull().alias("at_end"),
    )


def merged_windows(spans: DataFrame, slack_minutes: int = 5) -> DataFrame:
    """Union of (sensor, a, b) intervals: those that overlap, or start at most slack_minutes after the furthest end so far, are one."""
    rows = blocks.chained(spans, ["sensor"], ["a", "b"], blocks.by_time("a"), running={"_upto": F.col("b")}, kind="max", keep_block=True)
    new = F.coalesce((F.col("a") > F.col("_reached") + slack_minutes * MINUTE).cast("int"), F.lit(0))
    rows = blocks.chained(rows, ["sensor"], ["a", "b"], F.col(blocks.BLOCK), before={"_reached": "_upto"}, running={"merged": new})
    return rows.groupBy("sensor", "merged").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("captures"))


def termination_counts(found: DataFrame, by: list[str]) -> DataFrame:
    """Episodes of each key by the reason of their end, every reason a column, with the longest and the total duration."""
    reasons = ("WINDOW_EDGE", "INTERRUPTED_BY_MISSING_DATA", "ENDED_BELOW_THRESHOLD")
    return found.groupBy(*by).agg(F.count("*").alias("episodes"), *[F.count_if(F.col("termination") == r).alias(r.lower()) for r in reasons], F.max("duration_minutes").alias("longest_minutes"), F.sum("duration_minutes").alias("total_minutes"), F.max("peak").alias("peak"))
