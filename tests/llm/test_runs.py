"""Every registered query of this part on the smallest tables, and the pipeline on odd ones, stage by stage against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hydrolith.llm import ann, packing, queries, quality, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def jaccard(a, b):
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs_over_its_whole_table(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name.startswith("op12_"):  # its rows are words: see test_words_and_clusters
        assert got["word"].is_unique and (got["n"] >= 5).all() and (got["word"].str.len() >= 6).all()
        return
    table = "embeddings" if name.startswith(("op1_", "op6_")) else "documents"
    key = "vec_id" if table == "embeddings" else "doc_id"
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    if name.startswith("op1_"):
        assert sorted(set(got["query_id"])) == [i for i in ids if i % 100 == 0] and (got.groupby("query_id")["rank"].max() == 10).all()
    elif name.startswith("op2_"):
        assert sorted(set(got["doc_id"])) == ids and got.groupby("sequence_id")["length"].sum().max() <= 2048
        least = packing.bin_lower_bound(got["length"].to_numpy(), 2048)
        assert least <= got["sequence_id"].nunique() <= 1.02 * least + 2
    else:
        assert sorted(got[key]) == ids and not got.isna().any().any()
    if "score" in got and "predicted" in got:
        assert got["score"].between(0, 1).all() and set(got["predicted"]) <= {0, 1}


def test_search_finds_the_nearest(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.collect()
    x, ids = np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows])
    hit = total = 0
    for q, found in ann.nearest(table, table.where("vec_id % 10 = 0"), 10).toPandas().groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [int(i) for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hit, total = hit + len(set(order) & set(found["vec_id"])), total + 10
    assert hit >= 0.9 * total


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(600)]
    text = lambda n: " ".join(words[i] for i in rng.integers(0, 600, n))
    rows = []
    for k in range(60):
        body = text(120)
        rows += [(3 * k, body, "en", f"s{k % 3}"), (3 * k + 1, body.upper(), "en", None)]
        changed = body.split()
        changed[50] = "new"
        rows.append((3 * k + 2, " ".join(changed), "de", "s0"))
    rows += [(900, None, None, None), (901, "", "en", "s1"), (None, text(90), "en", "s1"), (902, "two words", "en", "s2"), (5, text(80), "en", "s2"), (903, "x " * 5000, "en", "s2")]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(i, t, g, s, None) for i, t, g, s in rows], DOCS).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(None, 1, 1), (41, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def test_pipeline_stages_against_brute_force(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    labels = spark.read.parquet(f"{odd_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    kept = stages["quality classifier"](spark, docs, odd_dir).cache()
    model = quality.fit_quality(docs, labels)
    assert rows(kept) == rows(quality.score_quality(docs, model).where("score >= 0.3"))
    clean = stages["toxicity"](spark, kept, odd_dir).cache()
    assert rows(clean) == rows(toxicity.score_toxicity(kept, toxicity.fit_toxicity(kept, labels)).where("score < 0.5"))
    assert rows(clean) == rows(docs)  # all labels say good

    single = stages["simhash near-dedup"](spark, clean, odd_dir).cache()
    left = [(r["doc_id"], r["text"] or "") for r in single.collect()]
    assert all(jaccard(a, b) < 0.8 for i, (_, a) in enumerate(left) for _, b in left[:i] if a.split() and b.split())
    gone = rows(clean) - rows(single)
    assert all(max(jaccard(t or "", u) for _, u in left if u.split() or not (t or "").split()) >= 0.8 for _, t in gone if (t or "").split())
    assert {i for i, _ in left if i is not None and i < 180} == {*range(0, 180, 3), 5} and 900 in {i for i, _ in left} and 901 not in {i for i, _ in left}

    mixed = stages["source mixing"](spark, single, odd_dir).cache()
    times = rows(mixed)
    assert set(times.values()) <= {1, 2} and all(t and t.split() for _, t in times) and set(times) <= set(rows(single))
    words = sum(len(t.split()) for _, t in left)
    assert abs(sum(n * len(t.split()) for (_, t), n in times.items()) - 1.5 * words) <= 5200

    packed = stages["best-fit packing"](spark, mixed, odd_dir).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert (packed[packed["piece"] == 0].groupby("doc_id", dropna=False).size().sort_index()).tolist() == [n for _, n in sorted(Counter({i: sum(n for (j, _), n in times.items() if j == i) for i, _ in times}).items(), key=lambda x: (x[0] is None, x[0] or 0))]
    assert mixed.columns == docs.columns


def test_pipeline_of_nothing(spark, odd_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_no_shared_folder_off_a_local_master(spark, monkeypatch):
    from hydrolith.llm import common

    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session())
