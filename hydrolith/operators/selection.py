"""Exact ranks and quantiles by distributed selection: blocks of equal numbers of rows, whatever the values are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.operators import blocks

#: Rows of a block, about; and inputs of at most so many rows, whose values fit one buffer of an aggregate.
BLOCK_ROWS, BUFFER_ROWS = 1 << 20, 1 << 20


def by_rank(rows: DataFrame, order: list[Column], block_rows: int = 0) -> DataFrame:
    """rows with their block (see blocks.BLOCK): ranges of the order that hold about block_rows rows each, ascending.

    Spark samples the order's columns and cuts at sampled rows, so outliers, infinite values and NaN make no block larger;
    a frequent value is cut as well if the order goes on to something that tells its rows apart. Which rows are
    sampled changes the blocks, never what is computed over them. One number, that of the rows, reaches the driver.
    """
    n = rows.count()
    parts = max(1, -(-n // (block_rows or BLOCK_ROWS)))
    if parts == 1:
        return rows.withColumn(blocks.BLOCK, F.lit(0))
    return rows.repartitionByRange(parts, *order).withColumn(blocks.BLOCK, F.spark_partition_id())


def told_apart(rows: DataFrame) -> Column:
    """A number that tells most rows of one value apart, and stays when a task runs again."""
    plain = [c for c, t in rows.dtypes if not t.startswith("map")]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def ranked(rows: DataFrame, by: list[str], value: str, tie: Column | None = None, descending: bool = False, running: dict[str, Column] | None = None, block_rows: int = 0) -> DataFrame:
    """rows with `rank` from 1 by value (nulls last), `of`, the rows of their key that have a value, and further running sums in that order.

    Rows of equal values and ties are ordered somehow; `tie` makes their order definite.
    """
    rows = rows.withColumn("_tie", tie if tie is not None else told_apart(rows))
    first = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    cut = by_rank(rows, [first, F.col("_tie")], block_rows).withColumn("_unique", F.monotonically_increasing_id())
    sums = {"rank": F.lit(1).cast("bigint"), "_good": F.col(value).isNotNull().cast("bigint")} | (running or {})
    out = blocks.chained(cut, by, [first, F.col("_tie"), F.col("_unique")], F.col(blocks.BLOCK), running=sums, totals={"of": "_good"})
    return out.drop("_tie", "_unique", "_good", blocks.BLOCK)


def quantile_columns(value: str, quantiles: tuple[float, ...]) -> list[Column]:
    """Aggregates over ranked rows: interpolated quantiles, from the two rows next to each alone."""
    out = []
    for q in quantiles:
        place = F.lit(q) * (F.col("of") - 1)
        low = F.floor(place)
        at = lambda k, low=low: F.max(F.when(F.col("rank") - 1 == low + k, F.col(value).cast("double")))
        part = F.max(place - low)
        out.append(F.when(part > 0, at(0) * (1 - part) + at(1) * part).otherwise(at(0)))
    return out


def quantiles(rows: DataFrame, by: list[str], value: str, qs: tuple[float, ...], further: list[Column] | None = None, block_rows: int = 0, buffer_rows: int | None = None) -> DataFrame:
    """by, `further` aggregates, and `quantiles`, an array of the exact interpolated quantiles of the values that aren't null (null without any).

    Inputs of at most buffer_rows rows are aggregated with the values in a buffer; beyond, rows are ranked in blocks and
    a quantile is read off the rows of its rank, so that no task holds the values of a key. Both give the same.
    """
    if rows.count() <= (BUFFER_ROWS if buffer_rows is None else buffer_rows):
        found = F.percentile(F.col(value).cast("double"), F.array(*map(F.lit, qs)))
        return rows.groupBy(*by).agg(*(further or []), found.alias("quantiles"))
    found = F.array(*quantile_columns(value, qs))
    return ranked(rows, by, value, block_rows=block_rows).groupBy(*by).agg(*(further or []), F.when(F.count(value) > 0, found).alias("quantiles"))
