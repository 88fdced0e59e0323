"""Features on two time axes: what is observed at an instant, and from when on which revision of it was known.

A revision (sensor, t, known, ...) stands from `known` until the next one of the same (sensor, t). An origin reads the instants of
its window as they stood when it asked, so rows that came late or were corrected later never change an earlier feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE
from hydrolith.operators import blocks

#: Pairs of an origin and a revision in its window that are handled at once.
PAIRS = 1 << 20
#: A block of origins is so many times the longest window, so that few revisions are needed in two of them.
SPAN = 8


def standing(revisions: DataFrame, key: list[str], known: str = "known", tie: str | None = None) -> DataFrame:
    """revisions with `until`: when the next revision of the key was known, null for the last; of several known at once the largest `tie` stands."""
    order = [F.col(known), *([F.col(tie)] if tie else [])]
    return revisions.withColumn("until", F.lead(known).over(Window.partitionBy(*key).orderBy(*order)))


def as_known(origins: DataFrame, revisions: DataFrame, windows: tuple[int, ...], lags: tuple[int, ...], cadence: int, wet: float = 0.0, least: float = 0.8, tie: str | None = None) -> DataFrame:
    """origins (sensor, t, asked) with the features of their windows and lags as they were known at `asked`.

    revisions: (sensor, t, known, value, usable). Columns: `known_value` (the usable value at t), `known_lag_<m>m` at exactly t - m,
    and for each window (t - m, t] `known_<m>m_sum`, `_max`, `_wet_count` (null where coverage is under `least`) and
    `_coverage`; `revised` counts the instants of the longest window whose standing revision is not their first. Rounded to six decimals.

    Origins are dealt by (sensor, block of t); a revision goes to its own block and to those that its windows reach, two
    at most. In a block, a sorted list of origins gives each revision the range of those whose window holds it, and those that asked
    while it stood count it. Nulls: a null value or `usable` is not usable; null instants match nothing.
    """
    reach = max(max(windows), *lags, 1)
    size = SPAN * reach * MINUTE
    block = lambda us: F.floor(us / size)
    first = (F.row_number().over(Window.partitionBy("sensor", "t").orderBy(*[F.col("known"), *([F.col(tie)] if tie else [])])) == 1).alias("first")
    stood = standing(revisions.where("t is not null and known is not null"), ["sensor", "t"], "known", tie).withColumn("first", first)
    goes = F.explode(F.sequence(block(F.col("t")), block(F.col("t") + reach * MINUTE)))
    right = stood.select("sensor", goes.alias("_block"), "t", "known", "until", F.when(F.col("usable"), F.col("value").cast("double")).alias("value"), "first")
    left = origins.withColumn("_block", block(F.col("t")))
    names = ["known_value", *[f"known_lag_{m}m" for m in lags], *[f"known_{m}m_{c}" for m in windows for c in ("sum", "max", "wet_count", "coverage")], "revised"]
    kinds = {c: "bigint" if c.endswith("wet_count") or c == "revised" else "double" for c in names}
    schema = left.drop("_block").withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()}).schema

    def run(asking: pa.Table, said: pa.Table) -> pa.Table:
        asking = asking.sort_by("t").drop_columns("_block")
        n = asking.num_rows
        at, asked = (asking[c].to_numpy().astype(np.float64 if asking[c].null_count else np.int64) for c in ("t", "asked"))
        t, known = said["t"].to_numpy(), said["known"].to_numpy()
        until = said["until"].fill_null(np.iinfo(np.int64).max).to_numpy()
        value = said["value"].to_numpy(zero_copy_only=False).astype(np.float64)
        first = said["first"].to_numpy(zero_copy_only=False)
        good = ~np.isnan(value)

        def pairs(of: np.ndarray, a: np.ndarray, b: np.ndarray):
            """(revision, origin) for origins a <= at < b of each revision `of` that asked while it stood, in turns."""
            lo, hi = np.searchsorted(at, a[of], "left"), np.searchsorted(at, b[of], "left")
            ends = np.cumsum(hi - lo)
            k = 0
            while k < len(of):
                done = ends[k - 1] if k else 0
                j = max(k + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                width = (hi - lo)[k:j]
                r = np.repeat(np.arange(k, j), width)
                o = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + lo[r]
                r = of[r]
                stands = (known[r] <= asked[o]) & (asked[o] < until[r])
                yield r[stands], o[stands]
                k = j

        out: dict[str, np.ndarray] = {}
        for m in (0, *lags):
            got = np.full(n, np.nan)
            when = t + m * MINUTE
            for r, o in pairs(np.flatnonzero(good), when, when + 1):
                got[o] = value[r]
            out[f"known_lag_{m}m" if m else "known_value"] = got
        if 0 in lags:
            out["known_lag_0m"] = out["known_value"]
        revised = np.zeros(n, np.int64)
        for r, o in pairs(np.flatnonzero(~first), t, t + max(windows) * MINUTE):
            np.add.at(revised, o, 1)
        for m in windows:
            total, count, wets, most = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -np.inf)
            for r, o in pairs(np.flatnonzero(good)[np.argsort(t[good], kind="stable")], t, t + m * MINUTE):
                np.add.at(total, o, value[r])
                np.add.at(count, o, 1)
                np.add.at(wets, o, value[r] > wet)
                np.maximum.at(most, o, value[r])
            cover = np.round(count / (m // cadence), 6)
            shut = (cover < least) | (count == 0)
            out |= {f"known_{m}m_sum": np.where(shut, np.nan, total), f"known_{m}m_max": np.where(shut, np.nan, most), f"known_{m}m_coverage": cover, f"known_{m}m_wet_count": np.where(shut, np.nan, wets)}
        out["revised"] = revised
        for c in names:
            column = np.asarray(out[c], np.float64)
            asking = asking.append_column(c, pa.array(column, pa.int64() if kinds[c] == "bigint" else pa.float64(), mask=np.isnan(column)) if kinds[c] == "double" else pa.array(np.nan_to_num(column).astype(np.int64), mask=np.isnan(column)))
        return asking

    found = left.groupBy("sensor", "_block").cogroup(right.groupBy("sensor", "_block")).applyInArrow(run, schema)
    exact = [c for c, k in kinds.items() if k == "double" and not c.endswith("coverage")]
    return found.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in exact})


def latest_known(origins: DataFrame, revisions: DataFrame, on: list[str], carry: list[str], asked: str = "asked", block_minutes: int | None = None) -> DataFrame:
    """origins with `carry` of the latest instant that was known when they asked, in the revision that stood then; null where there is none.

    Both sides are one stream of each key, ordered by when something was known or asked; the greatest (t, known, carry) so far
    is what an origin reads. A correction of an older instant doesn't displace a newer one. With block_minutes, for times in
    microseconds, a key is cut into blocks of time.
    """
    r = revisions.select(*on, F.col("known").alias("_t"), F.lit(0).alias("_side"), F.struct("t", "known", *carry).alias("_r"))
    l = origins.select(*on, F.col(asked).alias("_t"), F.lit(1).alias("_side"), F.struct(*origins.columns).alias("_l"))  # noqa: E741
    both = r.unionByName(l, allowMissingColumns=True).where("_side = 1 or (_r.t is not null and _t is not null)")
    block = F.lit(0) if block_minutes is None else blocks.by_time("_t", block_minutes)
    # origins ask after what was known at their very instant; rows alike in time and side are told apart by their content
    best = blocks.running(both, on, [F.col("_t"), F.col("_side"), F.xxhash64("_r", "_l")], block, {"_best": F.col("_r")}, "max")
    return best.where("_side = 1").select("_l.*", *[F.col("_best")[c].alias(c) for c in carry])
