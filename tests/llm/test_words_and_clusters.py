"""Adaptive rules, spelling variants and centroid clusters against brute force, with odd, empty and clashing tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hydrolith.llm import adaptive_rules, centroids, spelling

DOCS = "doc_id bigint, text string, lang string, source string, n_words string, value int, share int, f int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, "x", 1, 2, 3) for i, t, g, s in rows], DOCS)


ODD = [(1, "A b\nA b\nA b \n\n x", "en", "a"), (2, None, None, None), (3, "", "en", None), (4, "one two three four five six seven eight nine ten é日本#", None, "a"), (None, "w " * 40, "en", "a"), (4, "a b c d e f g h i j k a b c d e f", "en", "a"), (5, "\x1c|<>\x85 　 x\x00y", "de", "b"), (6, "long words " * 200_000, "de", "b")]


def counts_by_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    joined = "".join(words)
    return (len(words), len(joined), sum(c in "#*$%&|<>" for c in joined), len(lines) - len(set(lines)), len(covered), len(lines), sum("A" <= c <= "Z" for c in joined))


def test_counts_and_fixed_rules(spark):
    rows = adaptive_rules.rule_report(docs(spark, ODD)).collect()
    got = Counter((r["doc_id"], *(r[c] for c in adaptive_rules.COUNTS), r["base_failed"]) for r in rows)
    want = Counter()
    for i, t, _, _ in ODD:
        c = counts_by_force(t)
        want[(i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert got == want and not any(r["kept"] and r["base_failed"] for r in rows)
    assert adaptive_rules.rule_report(docs(spark, [])).count() == 0


@pytest.mark.parametrize("width", [3, 5, 6])
def test_repeated_words_of_many_documents(width):
    rng = np.random.default_rng(width)
    texts = [rng.integers(0, 3, n) for n in (0, 2, 5, 40, 7, 200, 6)]
    got = adaptive_rules.repeated_words(np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts]), len(texts), width)
    for t, n in zip(texts, got, strict=True):
        grams = [tuple(t[i : i + width]) for i in range(len(t) - width + 1)]
        assert n == len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(width)})


def corpus(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(400)]
    text = lambda: " ".join(rng.sample(words, 60))
    rows = [(k, text(), "en", f"s{k % 2}") for k in range(400)] + [(1000 + k, text().upper(), "xx", "s0") for k in range(150)]
    bad = [(2000, text().upper(), "en", "s0"), (2001, " ".join(w + "##" for w in text().split()), "en", "s1"), (2002, text(), "de", None), (2003, " ".join(w * 6 for w in text().split()), "en", "s0")]
    return docs(spark, rows + bad)


def test_fences_follow_language_and_source(spark):
    got = {r["doc_id"]: r for r in adaptive_rules.rule_report(corpus(spark)).collect()}
    assert all(r["kept"] for i, r in got.items() if i < 2000)  # capitals are usual in "xx", not in "en"
    assert [got[i]["broken"] for i in (2000, 2001, 2003)] == ["upper_high", "symbols_high", "word_length_high"]
    assert got[2002]["kept"]  # a group of one takes the fences of the whole corpus


def test_sketches_merge_and_joins_agree(spark, monkeypatch):
    c = corpus(spark)
    counts = adaptive_rules.document_counts(c.drop("n_words"), "text", ["doc_id", "lang", "source"]).cache()
    whole = adaptive_rules.sketch(counts)
    parts = adaptive_rules.merge(adaptive_rules.sketch(counts.where("doc_id % 3 = 0")), adaptive_rules.sketch(counts.where("doc_id % 3 <> 0")))
    key = lambda df: sorted(map(str, (tuple(r[x] for x in ("lang", "source", "statistic", "bucket", "n")) for r in df.collect())))
    assert key(whole) == key(parts)
    limits = adaptive_rules.fences(whole).cache()
    said = lambda: sorted((r["doc_id"], r["broken"]) for r in adaptive_rules.with_verdict(counts, limits).collect())
    first = said()
    monkeypatch.setattr(adaptive_rules, "BROADCAST_GROUPS", 0)
    assert said() == first
    kept = adaptive_rules.keep_good(c, limits)
    assert kept.columns == c.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, b in first if not b]


def words_by_force(rows, least_n=5):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    n = {w: k for w, k in total.items() if len(w) >= 6 and k >= least_n}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    by = {w: [v for v in n if near(v, w)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in by.items()}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None))
    return out


def word_rows():
    rng = random.Random(3)
    pool = ["chained"] * 2000 + ["chaineda"] * 300 + ["chainedab"] * 50 + ["chainedabc"] * 9
    for _ in range(80):
        w = "".join(rng.choices("abcdeé", k=rng.randint(5, 9)))
        pool += [w] * rng.choice([30, 30, 200])
        for _ in range(6):
            k = rng.randrange(len(w))
            pool += [rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcdeéÿ×") + w[k:], w[:k] + rng.choice("abcdfé") + w[k + 1 :]])] * rng.randint(4, 9)
    for _ in range(120):  # words of the same letters
        pool += ["".join(rng.sample("aabbccd", 7))] * 6 + ["".join(rng.sample("aabbcce", 7))] * 6 + ["".join(rng.sample("aabbccde", 8))] * 6
    rng.shuffle(pool)
    rows = [(k, (" ,1" if k % 2 else "\n").join(pool[i : i + 250]).upper().replace("É", "é")) for k, i in enumerate(range(0, len(pool), 250))]
    return [*rows, (None, "Nothing nothing NOTHING nothing nothing"), (77, None), (78, ""), (79, "a1b2 " + "x" * 70_000 + " y" * 10), rows[0]]


@pytest.mark.parametrize("parts", [8192, 40])
def test_spelling_groups(spark, monkeypatch, parts):
    from pyspark import cloudpickle

    monkeypatch.setattr(spelling, "PART_WORDS", parts)
    if parts < 8192:  # the module goes to the workers by value, with these limits
        cloudpickle.register_pickle_by_value(spelling)
        for name, x in (("DIRECT_PAIRS", 1), ("LEAF_POINTS", 4), ("SAMPLE_WORDS", 300), ("QUERY_ROWS", 50), ("PAIR_ROWS", 10), ("COUNTED_WORDS", 100)):
            monkeypatch.setattr(spelling, name, x)
    rows = word_rows()
    table = docs(spark, [(i, t, "en", "a") for i, t in rows])
    got = [tuple(r) for r in spelling.spelling_groups(table).collect()]
    cloudpickle.unregister_pickle_by_value(spelling) if parts < 8192 else None
    assert len(got) == len(set(got)) and set(got) == words_by_force(rows)
    assert ("chainedabc", "chainedab", "chained") in {r[:3] for r in got}
    if parts == 8192:
        assert spelling.spelling_groups(docs(spark, [])).count() == 0 and spelling.spelling_groups(docs(spark, [(1, "no", None, None)])).count() == 0


def test_texts_in_segments_count_alike(spark, monkeypatch):
    from pyspark import cloudpickle

    table = docs(spark, [(1, "Word wording wordy " * 3000, "en", "a")])
    whole = spelling.word_counts(table, "doc_id", "text", 4, 199).collect()
    cloudpickle.register_pickle_by_value(spelling)
    monkeypatch.setattr(spelling, "BLOCK_BYTES", 100)
    assert sorted(spelling.word_counts(table, "doc_id", "text", 4, 199).collect()) == sorted(whole)
    cloudpickle.unregister_pickle_by_value(spelling)


def clusters_by_force(rows, dims, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[0], r[1]))[:k]
    centres = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        centres = [[sum(v[i] for (_, v), a in zip(kept, at, strict=True) if a == j) // at.count(j) for i in range(dims)] if j in at else c for j, c in enumerate(centres)]
    last = [near(v) for _, v in kept]
    total = Counter()
    for d, j in last:
        total[j] += d
    long = lambda x: x if x < 1 << 63 else None
    return [(i, j, long(d), long(total[j]), long(sum(total.values())), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)]


@pytest.mark.parametrize("size", [1.0, 2.5e5, 1e9])
def test_clusters(spark, size):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) * size for x in rng.normal(size=5)]) for k in range(150)]
    rows += [(200, None), (201, [1.0] * 4), (202, [1.0, 2.0, None, 3.0, 4.0]), (203, [float("nan")] + [0.0] * 4), (204, [float("inf")] + [0.0] * 4), (None, [0.0] * 5), (205, []), (7, rows[7][1]), (206, [0.0] * 5)]
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, id int, v int")
    for k, rounds in ((8, 10), (3, 1), (400, 2)):
        got = [tuple(r) for r in centroids.cluster_vectors(table, k, rounds, components=5).collect()]
        assert sorted(map(str, got)) == sorted(map(str, clusters_by_force(rows, 5, k, rounds)))
    assert centroids.cluster_vectors(table.limit(0)).count() == 0


def test_components_too_wide_take_no_part(spark):
    table = spark.createDataFrame([(1, [1e300, 1.0]), (2, [5.0, 5.0])], "vec_id bigint, embedding array<double>")
    assert [r["vec_id"] for r in centroids.cluster_vectors(table, components=2).collect()] == [2]


def test_queries_agree_with_sql(spark):
    import duckdb

    from hydrolith.llm import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for name, table in (("op11_adaptive_rules", "documents"), ("op13_centroid_clusters", "embeddings")):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
        df = queries.QUERIES[name](spark, sf)
        found = con.execute(queries.ORACLE_SQL[name])
        at = [[d[0] for d in found.description].index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall())


def test_spelling_query_by_force(spark):
    from hydrolith.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.op12_spelling_variants(spark, sf).collect()} == words_by_force(rows)


@pytest.mark.parametrize("dims", [3, 4, 8, 64])
def test_no_embedding_link_is_lost(spark, dims):
    from hydrolith.llm import embed_dedup

    rng = np.random.default_rng(dims)
    spread = np.linspace(1, 0.2, 64) if dims == 64 else np.ones(64)  # all components, some wider; or near a subspace
    x = rng.normal(size=(1500, dims)) @ rng.normal(size=(dims, 64)) * spread + 0.01 * rng.normal(size=(1500, 64))
    x = np.concatenate([x, x[:200] + 0.1 * rng.normal(size=(200, 64)) * np.linalg.norm(x[:200], axis=1, keepdims=True) / 8])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    table = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.embedding_components(table, cell_rows=57).collect()}
    assert near.sum() > len(x) and [got[k] for k in range(len(x))] == (near.sum(axis=1) - 1).tolist()
