"""Unbounded windows and runs by blocks: each block of a key is ordered and summed up by itself, in one read of the input.

A key with very many rows, a sensor or a third of a table, is spread over as many tasks as it has blocks. What crosses from block to
block is a block's first and last row, or run: these *edges* alone are brought together for each key, in one window, where
neighbours are found and totals are carried on; then each block takes its carry from its first edge. Rows are read once
and joined with nothing: the plan is a line of three exchanges, of which only the first moves all rows of runs().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE

DAY = 1440
BLOCK = "_block"


def by_time(t: str = "t", minutes: int = DAY) -> Column:
    return F.floor(F.col(t) / (minutes * MINUTE))


def _cut(rows: DataFrame, block: Column) -> DataFrame:
    """rows with their block; a block that is there stays, so that steps on the same blocks need no exchange between them."""
    return rows if BLOCK in rows.columns else rows.withColumn(BLOCK, block)


def _edges(rows: DataFrame, edge: Column) -> DataFrame:
    """rows with the window keys that bring the edges of all blocks of a key together, and leave other rows in their blocks.

    They are columns, so that all windows over them share one exchange.
    """
    return rows.withColumns({"_edge": edge, "_inside": F.when(~edge, F.col(BLOCK))})


def chained(rows: DataFrame, by: list[str], order: list, block: Column, before: dict[str, str] | None = None, after: dict[str, str] | None = None, running: dict[str, Column] | None = None, kind: str = "sum", keep_block: bool = False, totals: dict[str, str] | None = None) -> DataFrame:
    """rows with columns of the row before and after them, and running sums (or kind "max") up to and with each row.

    before, after: new name to column; null at a key's ends. running: new name to value, which may use the names of
    `before`; null values add nothing. totals: new name to one of `running`, whose value at the key's last row all its rows get.
    Blocks ascend with the order, which is total. Keys may be null.
    """
    before, after, running, totals = before or {}, after or {}, running or {}, totals or {}
    fold = {"sum": F.sum, "max": F.max}[kind]
    inner = Window.partitionBy(*by, BLOCK).orderBy(*order)
    upto = (Window.unboundedPreceding, 0)
    pack = lambda names: F.struct(*[F.col(c).alias(n) for n, c in names.items()]) if names else F.lit(True)
    d = _cut(rows, block).withColumns({"_is_first": F.row_number().over(inner) == 1, "_is_last": F.lead(F.lit(True)).over(inner).isNull(), "_before": F.lag(pack(before)).over(inner), "_after": F.lead(pack(after)).over(inner)})
    first, last = F.col("_is_first"), F.col("_is_last")
    d = d.withColumns({n: F.col("_before")[n] for n in before})
    if running:
        d = d.withColumns({f"_v_{n}": F.when(~first, c) for n, c in running.items()})
        d = d.withColumns({f"_r_{n}": fold(f"_v_{n}").over(inner.rowsBetween(*upto)) for n in running})
    d, meet = _edges(d, first | last), Window.partitionBy(*by, "_edge", "_inside").orderBy(*order)
    d = d.withColumns({"_before": F.when(first, F.lag(pack(before)).over(meet)).otherwise(F.col("_before")), "_after": F.when(last, F.lead(pack(after)).over(meet)).otherwise(F.col("_after"))})
    d = d.withColumns({n: F.col("_before")[n] for n in before} | {n: F.col("_after")[n] for n in after})
    if running:
        d = d.withColumns({f"_v_{n}": F.when(first, c).when(last, F.col(f"_r_{n}")) for n, c in running.items()})
        d = d.withColumns({f"_i_{n}": fold(f"_v_{n}").over(meet.rowsBetween(*upto)) for n in running})
        everything = meet.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        d = d.withColumns({n: fold(f"_v_{c}").over(everything) for n, c in totals.items()})
        whole = Window.partitionBy(*by, BLOCK)
        d = d.withColumns({f"_i_{n}": F.max(F.when(first, F.col(f"_i_{n}"))).over(whole) for n in running} | {n: F.max(F.when(first, F.col(n))).over(whole) for n in totals})
        add = (lambda r, i: F.coalesce(r + F.coalesce(i, F.lit(0)), i)) if kind == "sum" else (lambda r, i: F.greatest(r, i))
        d = d.withColumns({n: F.when(first, F.col(f"_i_{n}")).otherwise(add(F.col(f"_r_{n}"), F.col(f"_i_{n}"))) for n in running})
    return d.select(*rows.columns, *[c for c in (BLOCK,) if keep_block and c not in rows.columns], *before, *after, *running, *totals)


def lagged(rows: DataFrame, by: list[str], order: list, block: Column, take: dict[str, str]) -> DataFrame:
    """rows with the columns `take` (new name to column) of the row before, in the order of `order`; null for a key's first."""
    return chained(rows, by, order, block, before=take)


def running(rows: DataFrame, by: list[str], order: list, block: Column, columns: dict[str, Column], kind: str = "sum") -> DataFrame:
    """rows with running sums (or kind "max") up to and with each row; `columns`: new name to value. Blocks ascend with the order."""
    return chained(rows, by, order, block, running=columns, kind=kind)


Relation = Callable[[Column, Column], Column]
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def runs(
    rows: DataFrame,
    by: list[str],
    block: Column,
    row: list[str],
    joined: Relation,
    measures: dict[str, tuple[str, Callable[[Column], Column]]] | None = None,
    counts: dict[str, Relation] | None = None,
    fill: tuple[Relation, int, dict[str, Column]] | None = None,
    extend: Callable[[DataFrame], DataFrame] | None = None,
    extra: list[str] | None = None,
    since: tuple[str, Relation] | None = None,
) -> DataFrame:
    """One row for each maximal run of rows: by, extra, first, last, before, after, the measures, the counts, and "since".

    rows: by, and the columns `row`, of which the first orders a key's rows and is unique in it. Relations are conditions on two
    rows, each a struct of `row`: the one before, null for a key's first, and the one at hand. `joined` tells whether
    the row goes on with the run of the one before. first and last are a run's ends, before and after the rows next to it,
    null at a key's ends. measures: name to (sum, min or max; value of a row). counts: running numbers of the runs
    that start with the relation; since: (count, relation), the count at the latest run that started with the relation.
    fill: (relation, step, values): between rows more than a step apart for which the relation holds, a gap row runs
    from a step after the one to a step before the other. All rows have two more fields: `slots`, 1 but for a gap, and
    `upto`, a gap's end. extend adds the key columns `extra` to a block's rows, a sensor's thresholds, say, once neighbours are known.
    """
    measures, counts, extra = measures or {}, counts or {}, extra or []
    keys, t = [*by, *extra], row[0]
    upto = (Window.unboundedPreceding, 0)
    inner = Window.partitionBy(*by, BLOCK).orderBy(t)
    d = _cut(rows, block).withColumn("_now", F.struct(*row, F.lit(1).cast("bigint").alias("slots"), F.col(t).alias("upto")))
    d = d.withColumn("_prev", F.lag("_now").over(inner)).drop(*[c for c in row if c not in by])
    types = [(f.name, f.dataType) for f in d.schema["_now"].dataType.fields]
    if extend:
        d = extend(d)

    def gap(prev: Column, now: Column) -> tuple[Column, Column]:
        """(whether there is a gap, its row)."""
        relation, step, values = fill
        slots = F.floor((now[t] - prev["upto"]) / step).cast("bigint") - 1
        made = {t: prev["upto"] + step, "slots": slots, "upto": now[t] - step} | values
        return F.coalesce(prev.isNotNull() & relation(prev, now) & (slots > 0), F.lit(False)), F.struct(*[made.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in types])

    if fill:
        there, made = gap(F.col("_prev"), F.col("_now"))
        pair = lambda prev, now: F.struct(prev.alias("_prev"), now.alias("_now"))
        both, alone = F.array(pair(F.col("_prev"), made), pair(made, F.col("_now"))), F.array(pair(F.col("_prev"), F.col("_now")))
        d = d.select(*keys, BLOCK, F.explode(F.when(there, both).otherwise(alone)).alias("_e")).select(*keys, BLOCK, "_e.*")
    goes_on = lambda prev, now: F.coalesce(prev.isNotNull() & joined(prev, now), F.lit(False))
    own = Window.partitionBy(*keys, BLOCK).orderBy(F.col("_now")[t])
    d = d.withColumn("_run", F.sum((~goes_on(F.col("_prev"), F.col("_now"))).cast("int")).over(own.rowsBetween(*upto)))
    p = d.groupBy(*keys, BLOCK, "_run").agg(F.min("_now").alias("first"), F.max("_now").alias("last"), *[_MERGE[k](v(F.col("_now"))).alias(n) for n, (k, v) in measures.items()])

    # runs of a block: neighbours and numbers inside it
    begins = lambda relation: F.coalesce(relation(F.col("before"), F.col("first")), F.lit(False))
    top = F.col("_top")
    w = Window.partitionBy(*keys, BLOCK).orderBy("_run")
    p = p.withColumns({"_top": F.col("_run") == 1, "_end": F.lead(F.lit(True)).over(w).isNull(), "before": F.lag("last").over(w), "after": F.lead("first").over(w), "_gap": F.lit(False)})
    p = p.withColumns({f"_l_{n}": F.sum((~top & begins(c)).cast("int")).over(w.rowsBetween(*upto)) for n, c in counts.items()})
    if since:
        p = p.withColumn("_l_since", F.max(F.when(~top & begins(since[1]), F.col(f"_l_{since[0]}"))).over(w.rowsBetween(*upto)))

    # edges of blocks: neighbours, gaps, runs that go on, numbers
    p, edge = _edges(p, top | F.col("_end")), F.col("_edge")
    meet = Window.partitionBy(*keys, "_edge", "_inside").orderBy(F.col("first")[t])
    p = p.withColumn("before", F.when(top, F.lag("last").over(meet)).otherwise(F.col("before")))
    if fill:
        there, made = gap(F.col("before"), F.col("first"))
        own_fields = ["first", "last", "before", "_gap", "_end", *measures]
        same = [c for c in p.columns if c not in own_fields]
        late = F.struct("first", "last", made.alias("before"), "_gap", "_end", *measures)
        new = F.struct(made.alias("first"), made.alias("last"), "before", F.lit(True).alias("_gap"), F.lit(False).alias("_end"), *[v(made).cast(p.schema[n].dataType).alias(n) for n, (_, v) in measures.items()])
        p = p.select(*same, F.explode(F.when(top & there, F.array(new, late)).otherwise(F.array(F.struct(*own_fields)))).alias("_e")).select(*same, "_e.*")
    p = p.withColumns({"after": F.when(F.col("_end") | F.col("_gap"), F.lead("first").over(meet)).otherwise(F.col("after")), "_starts": ~top | ~goes_on(F.col("before"), F.col("first"))})
    # an edge adds the runs that it starts: a block's first itself, its last those of the block but for the first
    heads, ahead = top & F.col("_starts"), meet.rowsBetween(*upto)
    p = p.withColumns({f"_c_{n}": F.when(top, (heads & begins(c)).cast("int")).otherwise(F.col(f"_l_{n}")) for n, c in counts.items()})
    p = p.withColumns({"_group": F.sum(F.col("_starts").cast("int")).over(ahead)} | {f"_n_{n}": F.sum(f"_c_{n}").over(ahead) for n in counts})
    if since:
        count = F.col(f"_n_{since[0]}")
        at = F.when(top, F.when(heads & begins(since[1]), count)).otherwise(count - F.col(f"_l_{since[0]}") + F.col("_l_since"))
        p = p.withColumn("_n_since", F.max(at).over(ahead))
    group = Window.partitionBy(*keys, "_edge", "_inside", "_group").orderBy(F.col("first")[t]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = p.withColumns({"last": F.max("last").over(group), "after": F.last("after").over(group)} | {n: _MERGE[k](n).over(group) for n, (k, _) in measures.items()})

    # each block takes its carry from its first run
    whole, numbers = Window.partitionBy(*keys, BLOCK), [*counts, *(["since"] if since else [])]
    p = p.withColumns({f"_b_{n}": F.max(F.when(top & ~F.col("_gap"), F.col(f"_n_{n}"))).over(whole) for n in numbers})
    inside = {n: F.col(f"_b_{n}") + F.col(f"_l_{n}") for n in counts}
    if since:
        inside["since"] = F.coalesce(F.col(f"_b_{since[0]}") + F.col("_l_since"), F.col("_b_since"))
    out = {n: F.when(edge | F.col("_gap"), F.col(f"_n_{n}")).otherwise(c).cast("bigint") for n, c in inside.items()}
    return p.where("_starts").withColumns(out).select(*keys, "first", "last", "before", "after", *measures, *out)
