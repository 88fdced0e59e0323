"""Whether data suffice: verdicts over stations, gates by horizon, splits and their reports, features that may be used."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE, round6


def sufficiency(facts: DataFrame, minima: dict[str, tuple[str, float]]) -> DataFrame:
    """(analysis, measured, required, verdict) of each analysis: the greatest value that any station has against a minimum.

    facts: a row for each station. minima: analysis to (column, least value). No station: measured 0.
    """
    best = facts.agg(*[F.coalesce(F.max(c), F.lit(0)).cast("double").alias(a) for a, (c, _) in minima.items()])
    rows = F.array(*[F.struct(F.lit(a).alias("analysis"), F.col(a).alias("measured"), F.lit(float(m)).alias("required")) for a, (_, m) in minima.items()])
    out = best.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("verdict", F.when(F.col("measured") >= F.col("required"), "SUFFICIENT").otherwise("INSUFFICIENT"))


def count_episodes(rows: DataFrame, by: list[str], time: str, gap_minutes: float = 7.5, block_minutes: int = 1440) -> DataFrame:
    """Episodes of each key: runs of instants no more than gap_minutes apart.

    Instants are compared inside blocks of time, and a block's first with the last of the block before.
    """
    gap = gap_minutes * MINUTE
    cut = rows.select(*by, F.col(time).alias("_t")).withColumn("_b", F.floor(F.col("_t") / (block_minutes * MINUTE)))
    inner = cut.withColumn("_p", F.lag("_t").over(Window.partitionBy(*by, "_b").orderBy("_t"))).groupBy(*by, "_b").agg(F.count_if(F.col("_t") - F.col("_p") > gap).alias("_n"), F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    edges = inner.withColumn("_before", F.lag("_last").over(Window.partitionBy(*by).orderBy("_b")))
    return edges.groupBy(*by).agg((F.sum("_n") + F.count_if(F.col("_before").isNull() | (F.col("_first") - F.col("_before") > gap))).alias("episodes"))


def feasibility(labels: DataFrame, horizons: tuple[int, ...], least_rows: int, least_positives: int, least_negatives: int, least_episodes: int) -> DataFrame:
    """One row for each horizon: evaluable rows, positives, negatives, episodes of positives, and FEASIBLE or the first minimum that is missed."""
    spark = labels.sparkSession
    asked = spark.createDataFrame([(h,) for h in horizons], "horizon int")
    known = labels.where("label is not null")
    counts = known.groupBy("horizon").agg(F.count("*").alias("n_rows"), F.count_if(F.col("label")).alias("positives"), F.count_if(~F.col("label")).alias("negatives"))
    times = known.where("label").select("horizon", "t").distinct()
    out = asked.join(counts, "horizon", "left").join(count_episodes(times, ["horizon"], "t"), "horizon", "left").na.fill(0)
    gates = (("n_rows", least_rows, "TOO_FEW_ROWS"), ("positives", least_positives, "TOO_FEW_POSITIVES"), ("negatives", least_negatives, "TOO_FEW_NEGATIVES"), ("episodes", least_episodes, "TOO_FEW_EPISODES"))
    return out.withColumn("verdict", F.coalesce(*[F.when(F.col(c) < m, name) for c, m, name in gates], F.lit("FEASIBLE")))


def boundaries(rows: DataFrame, time: str, shares: tuple[tuple[int, int], ...] = ((2, 3), (5, 6))) -> list[int]:
    """Instants at the places n * a // b of all instants in order, repeats counted: counts by instant, summed up by blocks of them.

    Only the counts of blocks of a day reach the driver, then those of the days that hold a place.
    """
    day = F.floor(F.col(time) / (1440 * MINUTE))
    days = [(r[0], r[1]) for r in rows.where(F.col(time).isNotNull()).groupBy(day.alias("d")).count().orderBy("d").collect()]
    n, found = sum(c for _, c in days), []
    for a, b in shares:
        place = n * a // b
        for d, c in days:
            if place < c:
                row = rows.where(day == d).groupBy(F.col(time).alias("t")).count().withColumn("upto", F.sum("count").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") > place).agg(F.min("t")).first()
                found.append(row[0])
                break
            place -= c
    return found


def split_report(split: DataFrame, part: str, time: str) -> DataFrame:
    """(part, n, first, last, in_order): in_order is false where a part begins before the one ahead of it ends."""
    g = split.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    rank = F.array_position(F.array(*map(F.lit, ("train", "validation", "test"))), F.col("part"))
    before = F.max(F.when(rank > 0, F.col("last"))).over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1))
    return g.withColumn("in_order", (rank == 0) | F.coalesce(F.col("first") > before, F.lit(True)))


def no_split(spark, reason: str) -> DataFrame:
    """The report of a split that can't be made."""
    return spark.createDataFrame([("infeasible", 0, None, None, reason)], "part string, n bigint, first bigint, last bigint, reason string")


TARGET = re.compile(r"^(target|label)_|_(exceeds|escalates|delta)(_|$)")


def is_target(name: str) -> bool:
    """The name of a label, which no model may read."""
    return bool(TARGET.search(name))


def eligible_features(columns: list[str], registry: dict[str, str], allowed: tuple[str, ...] = ("HISTORICAL", "STATIC", "AS_OF")) -> tuple[list[str], dict[str, str]]:
    """(columns that may be features, why the others may not): registered, of an allowed leakage class, and no target."""
    why = {c: "TARGET" if is_target(c) else "NOT_REGISTERED" if c not in registry else registry[c] for c in columns}
    return [c for c in columns if why[c] in allowed], {c: w for c, w in why.items() if w not in allowed}


def numeric_columns(rows: DataFrame, features: list[str]) -> list[Column]:
    """Features as doubles: booleans 1 and 0, texts that are no number null."""
    kinds = dict(rows.dtypes)
    return [(F.col(c).cast("int").cast("double") if kinds[c] == "boolean" else F.col(c).try_cast("double")).alias(c) for c in features]


def horizon_labels(labels: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """(evaluated labels of a horizon, the numbers of kept and missing ones)."""
    own = labels.where(F.col("horizon") == horizon)
    good = (F.col("status") == "TARGET_EVALUATED") & F.col("exceeds").isNotNull()
    return own.where(good), own.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("missing"))


def rule_label(triggers: list[tuple[Column, float]]) -> Column:
    """1 if any value reaches its trigger, 0 if none does, null if none is known."""
    known = F.coalesce(*[v for v, _ in triggers]).isNotNull()
    hit = reduce(lambda a, b: a | b, [F.coalesce(v >= at, F.lit(False)) for v, at in triggers])
    return F.when(known, hit.cast("int"))


def rule_score(triggers: list[tuple[Column, float]]) -> Column:
    """The rule's label as a score, 0.0 or 1.0; null if none of its values is known."""
    return rule_label(triggers).cast("double")


def frozen_threshold(rows: DataFrame, chosen: DataFrame, by: list[str], score: str) -> DataFrame:
    """rows with `predicted` by the threshold that was chosen on validation rows (by, threshold): 1 from it on, null without one or a score.

    chosen has one row for each key; nothing of rows changes it.
    """
    return rows.join(chosen.select(*by, F.col("threshold").alias("_cut")), by, "left").withColumn("predicted", (F.col(score) >= F.col("_cut")).cast("int")).drop("_cut")


def fit_scalers(train: DataFrame, station: str, value: str) -> DataFrame:
    """(station, mean, std) of the training rows; a constant series has the deviation 1."""
    g = train.where(F.col(value).isNotNull()).groupBy(station).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return g.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def scale(rows: DataFrame, scalers: DataFrame, station: str, value: str, inverse: bool = False, unseen: str = "null") -> DataFrame:
    """rows with `scaled` (or, inverse, with values in their unit again). A station that the training rows lack gives null, or with unseen="refuse" an error that names it."""
    if unseen == "refuse":
        named = F.concat(F.lit("no scaler for station "), F.coalesce(F.col(station).cast("string"), F.lit("null")))
        rows = rows.join(scalers.withColumn("_there", F.lit(True)), station, "left")
        x = F.col(value) * F.col("std") + F.col("mean") if inverse else (F.col(value) - F.col("mean")) / F.col("std")
        return rows.withColumn("scaled", F.when(F.col("_there"), round6(x)).otherwise(F.raise_error(named))).drop("mean", "std", "_there")
    x = F.col(value) * F.col("std") + F.col("mean") if inverse else (F.col(value) - F.col("mean")) / F.col("std")
    return rows.join(scalers, station, "left").withColumn("scaled", round6(x)).drop("mean", "std")


def impute_and_standardise(rows: DataFrame, fitted: DataFrame, features: list[str]) -> DataFrame:
    """rows with features imputed by the median and standardised, as fitted (feature, median, mean, std) says; constant features become 0."""
    wide = fitted.groupBy().pivot("feature", features).agg(F.first(F.struct("median", "mean", "std")))
    both = rows.crossJoin(F.broadcast(wide.select([F.col(f"`{f}`").alias(f"_fit_{f}") for f in features])))
    z = lambda f: F.when(F.col(f"_fit_{f}")["std"] > 0, (F.coalesce(F.col(f).cast("double"), F.col(f"_fit_{f}")["median"]) - F.col(f"_fit_{f}")["mean"]) / F.col(f"_fit_{f}")["std"]).otherwise(0.0)
    return both.select(*[c for c in rows.columns if c not in features], *[round6(z(f)).alias(f) for f in features])


def sequence_gate(facts: DataFrame, least_samples: int, least_stations: int) -> DataFrame:
    """Whether sequence models are justified: facts (train_samples, stations_covered), one row."""
    return facts.withColumn("verdict", F.when(F.col("train_samples") < least_samples, "TOO_FEW_SAMPLES").when(F.col("stations_covered") < least_stations, "TOO_FEW_STATIONS").otherwise("JUSTIFIED"))
