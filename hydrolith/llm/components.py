"""Connected components of a link table, by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import Scratch


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links (a, b): each node but its component's smallest, and that smallest node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the links (a, b) that join what all join, without cycles; links of small nodes come first.

    Boruvka rounds: each component takes its first link that leaves it.
    """
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    nodes, flat = np.unique(np.concatenate([low, high]), return_inverse=True)
    x, y = flat[: len(low)], flat[len(low) :]
    label, taken = np.arange(len(nodes)), np.zeros(len(low), bool)
    while True:
        live = np.flatnonzero(label[x] != label[y])
        if not len(live):
            return low[taken], high[taken]
        first = np.full(len(nodes), len(low))
        np.minimum.at(first, label[x[live]], live)
        np.minimum.at(first, label[y[live]], live)
        picked = np.unique(first[first < len(low)])
        taken[picked] = True
        child, parent = spanning_links(label[x[picked]], label[y[picked]])
        to = np.arange(len(nodes))
        to[child] = parent
        label = to[label]


def _contract(batches):
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        x, y = spanning_links(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node that has a link; component is the smallest node reachable.

    links: two bigint columns, any order, repeats and self-links allowed, nulls ignored, other columns not read; no links give no rows. Every round is a join and an
    aggregation that cuts links to stars; nothing is gathered to the driver but two numbers a round.
    """
    spark = links.sparkSession
    pairs = links.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a <> b")
    held = Scratch(spark)
    edges = held.write(pairs.mapInArrow(_contract, "a bigint, b bigint").distinct(), "links")
    before = None
    while True:
        turn, superseded = Scratch(spark), held
        # large-star: every larger neighbour of u links to the smallest of u and its neighbours
        both = edges.union(edges.select("b", "a"))
        least = turn.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "large-star")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = turn.write(large.distinct(), "large-links")
        # small-star: u and its smaller neighbours link to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = turn.write(down.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        held = Scratch(spark)
        edges = held.write(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        turn.drop()
        superseded.drop()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before = state
