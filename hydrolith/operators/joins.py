"""As-of, paired and dimension joins, co-location, referential checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.operators import blocks


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, carry: list[str], block_minutes: int | None = None) -> DataFrame:
    """left with `carry` of the latest right row of the same key at or before left_time; null where there is none.

    Both sides are one stream ordered by key and time, so each row is shuffled once and nothing is paired off; of
    right rows at one instant the one with the largest carried values counts. With block_minutes, for times in
    microseconds, a key is cut into blocks of time, and each block starts from the last right row of those before.
    """
    r = right.select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*carry).alias("_r"))
    l = left.select(*on, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))  # noqa: E741
    both = r.unionByName(l, allowMissingColumns=True)
    best, order = F.when(F.col("_side") == 0, F.struct("_t", "_r")), [F.col("_t"), F.col("_side")]
    if block_minutes is None:
        both = both.withColumn("_best", F.max(best).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        both = blocks.running(both, on, order, blocks.by_time("_t", block_minutes), {"_best": best}, "max")
    return both.where("_side = 1").select("_l.*", *[F.col("_best")["_r"][c].alias(c) for c in carry])


def paired(left: DataFrame, right: DataFrame, on: list[str], shared: list[str], order: str | None = None) -> DataFrame:
    """Inner join in which right's `shared` columns win; keys are made unique first: the last row by `order` stays, or the largest."""
    last = lambda df: F.max_by(F.struct(*[c for c in df.columns if c not in on]), F.struct(*[c for c in (order,) if c], *[c for c in df.columns if c not in on and c != order]))
    a = left.groupBy(*on).agg(last(left).alias("a"))
    b = right.groupBy(*on).agg(last(right).alias("b"))
    left_only = [F.col("a")[c].alias(c) for c in left.columns if c not in on and c not in shared]
    return a.join(b, on).select(*on, *left_only, *[F.col("b")[c].alias(c) for c in right.columns if c not in on])


def with_dimension(facts: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """Left join to a dimension whose empty strings count as null. Spark broadcasts it where its size allows."""
    text = {c: F.nullif(F.col(c), F.lit("")) for c, t in dimension.dtypes if t == "string" and c not in on}
    return facts.join(dimension.withColumns(text) if text else dimension, on, "left")


def co_located(places: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Exact coordinates with at least two distinct keys."""
    return places.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count_distinct(key).alias("n_keys"), F.array_sort(F.collect_set(key)).alias("keys")).where("n_keys >= 2")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing."""
    return child.join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(child_key) == F.col("_p"), "left_anti")


def latest(rows: DataFrame, by: list[str], time: str, keep: list[str]) -> DataFrame:
    """The row of the greatest time for each key, by partial aggregates."""
    best = rows.groupBy(*by).agg(F.max(F.struct(time, *keep)).alias("_best"))
    return best.select(*by, *[F.col("_best")[c].alias(c) for c in (time, *keep)])


def upsert(old: DataFrame, new: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """(key, outcome) of loading new into old: INSERTED, UNCHANGED or CONFLICT by content signature."""
    sign = lambda df, name: df.select(*key, F.sha2(F.to_json(F.struct(*content)), 256).alias(name))
    both = sign(new, "_new").join(sign(old, "_old"), key, "left")
    return both.select(*key, F.when(F.col("_old").isNull(), "INSERTED").when(F.col("_old") == F.col("_new"), "UNCHANGED").otherwise("CONFLICT").alias("outcome"))


def complete_lags(series: DataFrame, lags: tuple[int, ...], minute: int = 60_000_000) -> DataFrame:
    """Usable origins with the usable values at t and each lag before, in an array; origins with a missing lag are dropped."""
    base = series.where("usable")
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m * minute).alias("d")) for k, m in enumerate(lags)]))
    asked = base.select("sensor", F.col("t").alias("origin_us"), steps.alias("s")).select("sensor", "origin_us", "s.k", (F.col("origin_us") - F.col("s.d")).alias("t"))
    got = asked.join(base.select("sensor", "t", "value"), ["sensor", "t"])
    rows = got.groupBy("sensor", "origin_us").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("inputs"))
    return rows.where(F.size("inputs") == len(lags)).select("sensor", "origin_us", F.col("inputs.value").alias("inputs"))


def in_box(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def lag_deltas(series: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """complete_lags with `deltas`: each value less the one a lag further back."""
    rows = complete_lags(series, lags)
    later = F.slice("inputs", 1, len(lags) - 1)
    return rows.withColumn("deltas", F.zip_with(later, F.slice("inputs", 2, len(lags) - 1), lambda a, b: a - b))
