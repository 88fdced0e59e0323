"""Exact ranks and quantiles by blocks of equal numbers of rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolith.operators import blocks, selection, statistics


def values(kind, n=4000):
    rng = np.random.default_rng(5)
    x = rng.exponential(size=n)
    if kind == "one huge":
        x[7] = 1e6 * x.max()
    elif kind == "frequent":
        x[: n // 2] = 1.5
    elif kind == "infinite":
        x[3], x[4] = float("inf"), float("-inf")
    return x.tolist()


def table(spark, kind):
    return spark.createDataFrame([(k, "ab"[k % 3 == 0], v) for k, v in enumerate(values(kind))], "id int, g string, value double")


@pytest.mark.parametrize("kind", ["one huge", "frequent", "infinite"])
def test_blocks_hold_equal_numbers_of_rows(spark, kind):
    rows = table(spark, kind)
    cut = selection.by_rank(rows.withColumn("_tie", selection.told_apart(rows)), [F.desc("value"), F.col("_tie")], block_rows=250)
    sizes = [r["count"] for r in cut.groupBy(blocks.BLOCK).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) == 16 and max(sizes) <= 2 * 250 and min(sizes) >= 125


@pytest.mark.parametrize("kind", ["one huge", "frequent"])
def test_quantiles_by_selection_equal_buffered_ones(spark, kind):
    rows = table(spark, kind).unionByName(spark.createDataFrame([(9000, "a", None), (9001, "none", None), (9002, None, 3.0), (9003, "one", 4.0)], "id int, g string, value double"))
    qs = (0.0, 0.1, 0.5, 0.75, 0.999, 1.0)
    further = [F.count("*").alias("n"), F.max("id").alias("most")]
    got = {r["g"]: r for r in selection.quantiles(rows, ["g"], "value", qs, further, block_rows=300, buffer_rows=0).collect()}
    want = {r["g"]: r for r in selection.quantiles(rows, ["g"], "value", qs, further).collect()}
    assert set(got) == set(want) == {"a", "b", "none", None, "one"} and got["none"]["quantiles"] is want["none"]["quantiles"] is None
    for g in got:
        assert (got[g]["n"], got[g]["most"]) == (want[g]["n"], want[g]["most"])
        assert got[g]["quantiles"] is None or np.allclose(got[g]["quantiles"], want[g]["quantiles"], rtol=1e-12)


def test_ranks(spark):
    rows = table(spark, "frequent").withColumn("value", F.when(F.col("id") % 50 != 0, F.col("value")))
    got = selection.ranked(rows, ["g"], "value", tie=F.col("id"), block_rows=300).toPandas()
    for _, g in got.groupby("g"):
        want = g.sort_values(["value", "id"], na_position="last")
        assert want["rank"].tolist() == list(range(1, len(g) + 1)) and set(g["of"]) == {int(g["value"].notna().sum())}


@pytest.mark.parametrize("block_rows", [1 << 20, 300])
def test_concentration_and_average_precision(spark, monkeypatch, block_rows):
    monkeypatch.setattr(selection, "BLOCK_ROWS", block_rows)
    rows = table(spark, "one huge")
    data = values("one huge")
    got = {r["g"]: r["intervals"] for r in statistics.concentration(rows, ["g"], share=0.9).collect()}
    for g in "ab":
        own = sorted((v for k, v in enumerate(data) if "ab"[k % 3 == 0] == g), reverse=True)
        assert got[g] == next(k for k in range(1, len(own) + 1) if math.fsum(own[:k]) >= 0.9 * math.fsum(own))
    scored = rows.select("g", "id", (F.round(F.col("value") % 1, 2)).alias("score"), (F.col("id") % 7 == 0).cast("int").alias("truth"))
    found = {r["g"]: r["average_precision"] for r in statistics.average_precision(scored, ["g"], "score", "truth", "id").collect()}
    for g, own in scored.toPandas().groupby("g"):
        own = own.sort_values(["score", "id"], ascending=[False, True])
        hits = own["truth"].cumsum() / np.arange(1, len(own) + 1)
        assert found[g] == pytest.approx(hits[own["truth"] == 1].mean(), abs=1e-6)
