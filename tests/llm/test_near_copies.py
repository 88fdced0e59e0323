"""Large groups of near copies: the rows that they take, and that no link is lost in blocks and rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolith.llm import simhash
from test_llm import similar_by_force


def near_copies(n, most_edits, length=400, seed=21):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(3000)])
    base, texts = words[rng.integers(0, len(words), length)], []
    for k in range(n):
        text = base.copy()
        text[rng.choice(length, 1 + k % most_edits, replace=False)] = [f"x{k}y{i}" for i in range(1 + k % most_edits)]
        texts.append(" ".join(text))
    return texts


def rows_joined_on_slices(spark, run):
    """Rows that joins on a slice make while `run` does its work."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = 0
    for k in range(before, store.executionsCount()):
        execution = store.executionsList(k, 1).apply(0).executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and "[fp#" in node.desc():
                for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        found += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return found


def test_near_copies_take_few_rows_a_slice(spark):
    n = 300
    table = spark.createDataFrame(list(enumerate(near_copies(n, 4))), "doc_id long, text string")
    kept = []
    rows = rows_joined_on_slices(spark, lambda: kept.append(simhash.drop_near_duplicates(table).count()))
    assert kept == [1]
    assert 0 < rows < 1.5 * simhash.SLICES * n


@pytest.mark.parametrize("group_rows,sketch_rows", [(2048, 65536), (96, 65536), (96, 96)])
def test_large_groups_of_near_copies_against_brute_force(spark, monkeypatch, group_rows, sketch_rows):
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(simhash, "SKETCH_ROWS", sketch_rows)
    texts = near_copies(260, 14) + near_copies(40, 3, seed=22)
    got = dict(simhash.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    want = similar_by_force(texts)
    assert len(set(want)) > 10 and all(want[got[i]] == want[i] for i in got)  # nothing is joined that is not alike
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(texts)


@pytest.mark.parametrize("others,most", [(0, 64), (20, 64), (300, 64), (20, 5000)])
def test_blocks_let_all_of_other_labels_meet(spark, others, most):
    n = 800
    label = [0 if k >= others else k + 1 for k in range(n)]
    members = spark.createDataFrame([(7, k, label[k]) for k in range(n)] + [(8, k, 3) for k in range(50)], "g long, rep long, label long")
    groups = [r["reps"] for r in simhash.in_blocks(members, most).groupBy("g").agg(F.collect_list("rep").alias("reps")).collect()]
    met = {(min(a, b), max(a, b)) for reps in groups for a in reps for b in reps}
    assert all((b, a) in met for a in range(n) for b in range(a) if label[a] != label[b])
    rows = sum(map(len, groups))
    assert rows <= (0 if not others else n if most > n else n + others * (2 * n // most + 1) if others == 20 else n * (2 * n // most + 1))


def test_pivots_meet_in_each_block(spark):
    n, most = 4000, 1024
    members = spark.createDataFrame([(7, k, k) for k in range(n)], "g long, rep long, label long")
    groups = [set(r["reps"]) for r in simhash.around_pivots(members, most).groupBy("g").agg(F.collect_list("rep").alias("reps")).collect()]
    assert len(groups) == 2 * n // most + 1 and set().union(*groups) == set(range(n))
    pivots = set.intersection(*groups)
    assert simhash.PIVOTS / 3 < len(pivots) < simhash.PIVOTS * 3 and sum(map(len, groups)) == n + len(pivots) * (len(groups) - 1)
