"""Missing values of captured series: capture windows, slot states by type, runs with guarded summaries, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE, first_of, minutes_between, percent_of, round6
from hydrolith.operators import blocks


def guarded(value: Column, n: Column, required: int) -> Column:
    """(status, value, n, required_n): the value only from a sample of the required size."""
    enough = n >= required
    return F.struct(F.when(enough, "OK").otherwise("INSUFFICIENT_SAMPLE").alias("status"), F.when(enough, round6(value)).alias("value"), n.cast("bigint").alias("n"), F.lit(required).alias("required_n"))


def _captured(rows: DataFrame, cadence: int, keep: list[str]) -> DataFrame:
    """One row (sensor, t, keep, new) for each instant, in blocks of days; new: a capture starts here that follows no other within a cadence.

    A capture spans its batch's first to last row. Captures are few beside rows: their first rows alone meet by sensor.
    """
    batch = Window.partitionBy("sensor", "batch")
    d = rows.select("sensor", "batch", "t", *keep, F.max("t").over(batch).alias("_b"), (F.row_number().over(batch.orderBy("t")) == 1).alias("_first"))
    d = d.withColumn("_inside", F.when(~F.col("_first"), F.col("batch")))
    meet = Window.partitionBy("sensor", "_first", "_inside").orderBy("t", "_b")
    reached = F.max("_b").over(meet.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("new", F.coalesce(F.col("_first") & (F.col("t") > reached + cadence * MINUTE), F.lit(False))).withColumn(blocks.BLOCK, blocks.by_time())
    again = F.lag("t").over(Window.partitionBy("sensor", blocks.BLOCK).orderBy("t", F.desc("new"), *keep))
    return d.withColumn("_again", F.coalesce(F.col("t") == again, F.lit(False))).where("not _again").select("sensor", "t", *keep, "new", blocks.BLOCK)


def capture_windows(rows: DataFrame, cadence: int, max_gap_minutes: int) -> DataFrame:
    """(sensor, t) of rows (sensor, t, batch, ...) with `window`, from 0, and `boundary`: why the window before ended, null inside one.

    Captures that overlap or follow within a cadence are one. A window ends with its captures (SEPARATE_CAPTURES) or at a
    gap over max_gap_minutes (GAP_EXCEEDS_MAX_ABSENT).
    """
    late = F.coalesce(F.col("t") - F.col("_p") > max_gap_minutes * MINUTE, F.lit(False))
    out = blocks.chained(_captured(rows, cadence, []), ["sensor"], ["t"], F.col(blocks.BLOCK), before={"_p": "t"}, running={"window": (F.col("new") | late).cast("int")})
    boundary = F.when(F.col("_p").isNotNull(), F.when(F.col("new"), "SEPARATE_CAPTURES").when(late, "GAP_EXCEEDS_MAX_ABSENT"))
    return out.select("sensor", "t", F.col("window").cast("bigint").alias("window"), boundary.alias("boundary"))


def window_facts(windowed: DataFrame, rows: DataFrame, cadence: int, listed: DataFrame | None = None) -> DataFrame:
    """Per (sensor, window): start, end, source rows, usable ones, rows off the cadence's grid, listing-only instants within, and cadence_status.

    windowed: capture_windows of rows (sensor, t, usable, ...). listed: instants (sensor, t) that only listings captured. A window with a row
    off the grid is CADENCE_OFF_GRID: no slots, runs or coverage are derived for it.
    """
    own = windowed.select("sensor", "t", "window").join(rows.select("sensor", "t", "usable"), ["sensor", "t"])
    g = own.groupBy("sensor", "window").agg(
        F.min("t").alias("start_us"), F.max("t").alias("end_us"), F.count("*").alias("source_rows"), F.count_if("usable").alias("source_usable"), F.count_if(F.pmod("t", F.lit(cadence * MINUTE)) != 0).alias("off_grid_rows"),
    )
    if listed is not None:
        # a window is met by the days that it spans, so its instants are found by an equality
        day = lambda c: F.floor(c / (1440 * MINUTE))
        days = g.select("sensor", "window", "start_us", "end_us", F.explode(F.sequence(day(F.col("start_us")), day(F.col("end_us")))).alias("_day"))
        met = days.join(listed.select("sensor", "t", day(F.col("t")).alias("_day")).distinct(), ["sensor", "_day"]).where("t between start_us and end_us")
        g = g.join(met.groupBy("sensor", "window").agg(F.count("*").alias("listing_only_rows")), ["sensor", "window"], "left")
    count = F.coalesce(F.col("listing_only_rows"), F.lit(0)) if listed is not None else F.lit(0)
    status = F.when(F.col("off_grid_rows") > 0, "CADENCE_OFF_GRID").otherwise("CADENCE_VERIFIED")
    return g.withColumn("listing_only_rows", count.cast("bigint")).withColumn("cadence_status", status)


def window_slots(windowed: DataFrame, states: DataFrame, cadence: int, listed: DataFrame | None = None) -> DataFrame:
    """(sensor, window, t, state) of each expected slot of each window on the grid; where states (sensor, t, state) has none, LISTING_ONLY_SLOT for an instant of `listed`, else ABSENT_SLOT.

    A window is cut into days before it is exploded, so no task makes a long one whole. Windows with a row off the grid have no slots.
    """
    day, step = 1440 * MINUTE, cadence * MINUTE
    span = windowed.groupBy("sensor", "window").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max(F.pmod("t", F.lit(step))).alias("_off")).where("_off = 0").drop("_off")
    days = span.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("b") - F.col("a")) / day))).alias("d")).repartition("sensor", "window", "d")
    first = F.col("a") + F.col("d") * day
    slots = days.select("sensor", "window", F.explode(F.sequence(first, F.least(F.col("b"), first + day - step), F.lit(step))).alias("t"))
    met = slots.join(states.select("sensor", "t", "state"), ["sensor", "t"], "left")
    state = [F.col("state"), F.lit("ABSENT_SLOT")]
    if listed is not None:
        met = met.join(listed.select("sensor", "t", F.lit("LISTING_ONLY_SLOT").alias("_listed")).distinct(), ["sensor", "t"], "left")
        state.insert(1, F.col("_listed"))
    return met.select("sensor", "window", "t", F.coalesce(*state).alias("state"))


def window_summary(slots: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Per window: expected, usable, missing and absent slots, coverage, and a count for each missing type of the domain."""
    n = F.count("*")
    usable = F.count_if(F.col("state") == "USABLE")
    return slots.groupBy("sensor", "window").agg(
        F.min("t").alias("start_us"), F.max("t").alias("end_us"), n.alias("expected"), usable.alias("usable"), (n - usable).alias("missing"),
        F.count_if(F.col("state") == "ABSENT_SLOT").alias("absent"), percent_of(usable, n).alias("coverage_pct"),
        *[F.count_if(F.col("state") == t).alias(f"n_{t.lower()}") for t in types],
    )


def network_coverage(summary: DataFrame) -> DataFrame:
    """Coverage of all series together: slots by slots, never a mean of percentages."""
    return summary.agg(F.count_distinct("sensor").alias("sensors"), F.sum("expected").alias("expected"), F.sum("usable").alias("usable"), percent_of(F.sum("usable"), F.sum("expected")).alias("coverage_pct"))


def slot_runs(rows: DataFrame, cadence: int, max_gap_minutes: int, on_grid: bool = True) -> DataFrame:
    """Maximal runs of usable or missing slots of each window of captured rows (sensor, t, batch, usable): OBSERVED or MISSING, length, edges.

    Windows are those of capture_windows, run counts from 0 in each. Slots without a row are missing; those between two
    rows are one gap, so a long window is not made slot by slot. With on_grid=False, windows with a row off the cadence's
    grid, which have no slots, are found and left out; else rows are taken to lie on it.
    """
    step = cadence * MINUTE
    bounds = lambda a, b: a.isNotNull() & (b["new"] | (b["t"] - a["upto"] > max_gap_minutes * MINUTE))
    opens = lambda a, b: a.isNull() | bounds(a, b)
    found = blocks.runs(
        _captured(rows, cadence, ["usable"]), ["sensor"], F.col(blocks.BLOCK), ["t", "usable", "new"], lambda a, b: ~bounds(a, b) & (a["usable"] == b["usable"]),
        {"slots": ("sum", lambda s: s["slots"]), "off": ("max", lambda s: F.pmod(s["t"], F.lit(step)))}, {"run": lambda a, b: F.lit(True), "window": bounds},
        fill=(lambda a, b: ~bounds(a, b), step, {"usable": F.lit(False), "new": F.lit(False)}), since=("run", opens),
    )
    if not on_grid:
        found = found.withColumn("_off", F.max("off").over(Window.partitionBy("sensor", "window"))).where("_off = 0")
    return found.select(
        "sensor", "window", (F.col("run") - F.col("since")).alias("run"), F.when(F.col("first.usable"), "OBSERVED").otherwise("MISSING").alias("state"), F.col("first.t").alias("start_us"), F.col("last.upto").alias("end_us"), "slots",
        ((F.col("slots") - 1) * cadence).alias("first_to_last_minutes"), (F.col("slots") * cadence).alias("slot_minutes"),
        opens(F.col("before"), F.col("first")).alias("at_start"), (F.col("after").isNull() | bounds(F.col("last"), F.col("after"))).alias("at_end"),
    )


def longest_run(runs: DataFrame, by: list[str]) -> DataFrame:
    """The longest run of each key, the earliest at a tie."""
    best = runs.groupBy(*by).agg(F.max_by(F.struct("start_us", "end_us", "slots"), F.struct("slots", -F.col("start_us"))).alias("r"))
    return best.select(*by, "r.*")


def describe_runs(runs: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.5, 0.9), least_mean: int = 3, tail: int = 5) -> DataFrame:
    """Number, least and greatest length of runs; mean and quantiles only from samples large enough, see guarded."""
    n = F.count("*")
    need = {q: -(-tail // min(q, 1 - q)) if 0 < q < 1 else tail for q in quantiles}
    return runs.groupBy(*by).agg(
        n.alias("n_runs"), F.min("slots").alias("min_slots"), F.max("slots").alias("max_slots"), guarded(F.avg("slots"), n, least_mean).alias("mean_slots"),
        *[guarded(F.percentile("slots", F.lit(q)), n, int(need[q])).alias(f"p{round(q * 100)}_slots") for q in quantiles],
    )


def severity_states(rows: DataFrame, flag: str) -> DataFrame:
    """Rows that carry a source's severity flag, by state."""
    return rows.where(F.array_contains("quality_flags", flag)).groupBy("state").agg(F.count("*").alias("n"))


def full_days(slots: DataFrame, offset_minutes: int, per_day: int) -> DataFrame:
    """Local days all of whose slots lie in windows."""
    day = F.floor((F.col("t") + offset_minutes * MINUTE) / (1440 * MINUTE)).alias("day")
    return slots.groupBy("sensor", day).agg(F.count_distinct("t").alias("slots")).where(F.col("slots") >= per_day)


def shared_days(days: DataFrame) -> DataFrame:
    """(sensor_a, sensor_b, n_shared) of each two sensors that have covered days in common; the most shared are the first row's.

    days: (sensor, day). Sensors of a day are few; days are many and spread the join.
    """
    one = days.select("sensor", "day").distinct()
    return one.select(F.col("sensor").alias("sensor_a"), "day").join(one.select(F.col("sensor").alias("sensor_b"), "day"), "day").where("sensor_a < sensor_b").groupBy("sensor_a", "sensor_b").agg(F.count("*").alias("n_shared"))


def listing_availability(rows: DataFrame) -> DataFrame:
    """Point-in-time rows of listings, by sensor: number, usable ones, first and last instant, distinct batches."""
    return rows.groupBy("sensor").agg(F.count("*").alias("n_rows"), F.count_if("usable").alias("usable"), F.min("t").alias("first_us"), F.max("t").alias("last_us"), F.count_distinct("batch").alias("batches"))


def level_windows(rows: DataFrame) -> DataFrame:
    """Per (sensor, window): usable rows, extremes with their first instants, first and last value, and what the change between these is."""
    ok = rows.where("usable")
    g = ok.groupBy("sensor", "window").agg(
        F.count("*").alias("usable"), F.min("value").alias("lowest"), F.min_by("t", F.struct("value", "t")).alias("lowest_us"), F.max("value").alias("highest"),
        F.max_by("t", F.struct("value", -F.col("t"))).alias("highest_us"), F.min_by("value", "t").alias("first_value"), F.max_by("value", "t").alias("last_value"), F.min("t").alias("first_us"), F.max("t").alias("last_us"),
    )
    net = round6(F.col("last_value") - F.col("first_value"))
    status = first_of((F.col("usable") < 2, "INSUFFICIENT_SAMPLE"), (net > 0, "RISE"), (net < 0, "FALL"), (net == 0, "NO_CHANGE"))
    return g.select("*", F.when(F.col("usable") >= 2, net).alias("net_change"), status.alias("net_status"), minutes_between(F.col("last_us"), F.col("first_us")).alias("minutes"))
