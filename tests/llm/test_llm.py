"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from hydrolith.llm import ann, chat, components, embed_dedup, lm, mixing, packing, quality, queries, simhash, tokens, toxicity
from hydrolith.llm.common import Words
from hydrolith.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, g int, length int, score int, stats string, fp string, item int, row int"
LONG = "lorem ipsum dolor <|endoftext|>  sit\n\n amet's 12 " * 9000
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 1, 2, 3, "x", "y", 4, 5) for i, t, s in rows], DOCS)


ROWS = [(1, "The quick brown fox. " * 30, "a"), (2, "The quick brown fox. " * 30, "a"), (3, "", "b"), (4, None, None), (5, " \t\n", "b"), (6, LONG, "c"), (6, LONG, "c"), (None, "no id here", "a"), (7, "word", None), (8, "ein völlig anderer Text mit Wörtern 日本語", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_words_are_split_and_cased():
    text = "Ab\tab  AB\x0bé  ".encode() + b"\x00x"
    w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert w.counts.tolist() == [5] and len(set(w.hashes[:3].tolist())) == 1 and len(set(w.hashes.tolist())) == 3


def test_long_texts_give_the_same_words(monkeypatch):
    text = np.frombuffer((b"alpha beta gamma " * 5000)[:-1], np.uint8)
    whole = Words(text, np.array([0, len(text)]))
    monkeypatch.setattr("hydrolith.llm.common.BLOCK_BYTES", 1000)
    cut = Words(text, np.array([0, len(text)]))
    assert np.array_equal(whole.hashes, cut.hashes) and np.array_equal(whole.tails, cut.tails) and whole.counts == cut.counts


def test_token_counts(spark, odd, none):
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(odd, path).collect())
    assert got == sorted((i or 0, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, _ in ROWS)
    assert tokens.token_counts(none, path).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_piece_counter_is_exact(seed):
    import random

    import sentencepiece

    rng = random.Random(seed)
    parts = ["a", "the", " ", "  ", "▁", "\n", "\t", "é", "日本", "<s>", "</s>", "'s", "9", " ", "　", "x y"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(500)]
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert tokens.PieceCounter(path).counts(texts) == [len(x) for x in sp.encode(texts)]


@pytest.mark.parametrize("seed", range(3))
def test_piece_encoder_is_exact(seed):
    import random

    rng = random.Random(seed)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "'s", "'", "!!", "...", " ", "　", "\x1c", "<|endoftext|>", "the", "|", "日本", "́", "😀", "_", " the", "​"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(700)] + ["", " ", "'sthe a", "a  b", "a   b"]
    texts += ["".join(chr(c) for c in rng.choices([*range(32, 127), *range(161, 0xD800), *range(0xE000, 0x11000)], k=20)) for _ in range(300)]
    encoder = packing.PieceEncoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    whole = [x.ids for x in encoder.whole.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == whole


def test_piece_encoder_on_every_character():
    encoder = packing.PieceEncoder(str(public_tokenizers.path("byte_bpe_50k.json")), remembered=3000)
    points = [c for c in range(1, 0x10800) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4096):
        texts = [f"ab{c}1 x {c}'s9{c}! {c} a{c}b, {c}a. \n{c} z.\nb{c}" for c in map(chr, points[k : k + 4096])]
        whole = encoder.whole.encode_batch(texts, add_special_tokens=False)
        assert all(np.frombuffer(encoder.encode(t), "<u4").tolist() == w.ids for t, w in zip(texts, whole, strict=True))


def test_caches_are_bounded_on_text_without_spaces():
    text = "".join(chr(0x4E00 + k % 3000) for k in range(20000))
    encoder = packing.PieceEncoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    counter = tokens.PieceCounter(str(public_tokenizers.path("piece_bpe_32k.model")))
    for cut in range(50):
        assert encoder.encode("a " + text[cut:]) and counter.counts([text[cut:], "a " + text[cut:]])
    assert max(map(len, encoder.parts), default=0) <= packing.REMEMBERED_CHARS and max(map(len, counter.known), default=0) <= tokens.CACHED_CHARS


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tk = Tokenizer.from_file(path)
    got = packing.pack_documents(odd, path, 64).toPandas()
    ids = {i: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, _ in ROWS}
    assert got["length"].sum() == sum(len(ids[i]) for i, _, _ in ROWS)
    for r in got.dropna(subset="doc_id").itertuples():
        assert zlib.crc32(ids[int(r.doc_id)][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 64 and (s["offset"] == s["length"].cumsum() - s["length"]).all()
    assert packing.pack_documents(none, path, 64).count() == 0


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(1, 100, rng.integers(1, 60))
        bins, offsets, gaps = packing.best_fit_decreasing(sizes, 100)
        assert np.array_equal(100 - np.bincount(bins, sizes), gaps) and gaps.min() >= 0
        assert packing.bin_lower_bound(sizes, 100) <= len(gaps)
    assert packing.bin_lower_bound(np.array([51, 51, 51]), 100) == 3
    assert packing.bin_lower_bound(np.array([34] * 6), 100) == 3


def test_fingerprint_by_definition():
    for text in (b"", b"one", b"one two", b"A b c d e f g a b c d e f g " * 5):
        w = text.lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert int.from_bytes(simhash.fingerprint(text), "big") == want


def components_by_force(keys, budget):
    label = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if bin(keys[i] ^ keys[j]).count("1") <= budget:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("rows", [3, 16, 256])
def test_trie_join_loses_no_link(spark, rows):
    rng = np.random.default_rng(rows)
    keys = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    centre = keys[0]
    keys += [centre ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(150)] + [0, 1, (1 << 64) - 1]
    keys = sorted(set(keys))
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    classes = spark.createDataFrame(list(zip(signed, range(len(keys)), strict=True)), "fp bigint, rep bigint")
    links = simhash.near_links(classes, 2, subtrie_rows=rows)
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert [found.get(k, k) for k in range(len(keys))] == components_by_force(keys, 2)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (500, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(40)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_components(spark, odd, none):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(odd).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6)} <= got and simhash.simhash_components(odd).count() == len(ROWS)
    kept = sorted(r["doc_id"] or 0 for r in simhash.drop_near_duplicates(odd).collect())
    assert kept == [0, 1, 3, 6, 7, 8]
    assert simhash.simhash_components(none).count() == simhash.drop_near_duplicates(none).count() == 0


def test_mixing(spark, odd, none):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}" if i % 9 else None) for i in range(600)]
    got = mixing.mix_sources(docs(spark, rows)).toPandas()
    by = got.assign(source=got["source"].fillna("")).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert (abs(by.target - by.taken) <= 14).all() and (by.target <= 2 * by["size"]).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6
    assert (got["taken"] <= 2 * got["size"]).all()
    again = mixing.mix_sources(docs(spark, rows[::-1]).repartition(3)).toPandas()
    key = ["doc_id", "size", "target", "taken"]
    assert got[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()
    assert mixing.mix_sources(odd).count() == len(ROWS) and mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(docs(spark, [(1, "", "a"), (2, None, "b")])).agg(F.sum("taken")).first()[0] == 0
    assert mixing.apply_mix(docs(spark, rows)).count() == (got["taken"] // got["size"]).sum()


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifiers_on_odd_rows(spark, odd, none, scores):
    some = labels(spark, [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (6, 0, 1), (8, 1, 0)])
    for table in (some, some.limit(0)):
        got = scores(odd, table).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] == 3} == {zlib.crc32(b"3") % 5 == 0}
    assert scores(none, some).count() == 0


def test_classifiers_learn(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows, marks = [], []
    for i in range(900):
        bad, toxic = int(rng.random() < 0.3), int(rng.random() < 0.3)
        text = " ".join(rng.choice(words, 30)) + (" idiot clown" if toxic else "")
        rows.append((i, text.upper() if bad else text, "a"))
        marks.append((i, 1 - bad, toxic))
    table, marked = docs(spark, rows), labels(spark, marks)
    for scores, column in ((quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")):
        held = scores(table, marked).where("held_out").join(marked, "doc_id")
        assert held.agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0] > 0.97


def test_rules_without_a_split_are_an_intercept():
    for n in (2, 6, 9, 12):
        labels_ = np.arange(n) % 2
        for values in (np.zeros(n), np.arange(n, dtype=float)):
            model = quality.fit_rules({"x": values, "y": np.ones(n)}, labels_.astype(float))
            assert np.isfinite(model.intercept)
    assert quality.fit_rules({"x": np.empty(0)}, np.empty(0)).intercept == 0


def test_compiled_rules_are_the_rules(spark):
    rng = np.random.default_rng(5)
    values = {n: rng.integers(0, 20, 400) / 4 for n in "abc"}
    labels_ = ((values["a"] > 2) & (values["b"] <= 3) | (values["c"] > 4.5)).astype(float)
    model = quality.fit_rules(values, labels_)
    margin = model.intercept + sum(w * r.holds(values) for r, w in zip(model.rules, model.weights, strict=True))
    assert ((margin > 0) == labels_).mean() > 0.97 and len(model.rules) > 2
    table = spark.createDataFrame([tuple(float(values[n][k]) for n in "abc") for k in range(400)], "a double, b double, c double")
    got = table.select(quality.once(F.struct("a", "b", "c"), model.margin))
    assert np.allclose([r[0] for r in got.collect()], margin)


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(6)
    x = rng.random((500, 8)) < 0.4
    y = (rng.random(500) < 1 / (1 + np.exp(-(2.0 * x[:, 0] - 1.5 * x[:, 1])))).astype(float)
    w, b = quality.lasso_logistic(x, y, penalty=0.01, steps=4000)
    slope = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / 500
    assert np.all(np.abs(slope) <= 0.01 + 1e-3) and np.allclose(slope[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-3)


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(7)
    rows = [np.unique(rng.integers(0, 30, rng.integers(1, 8))) for _ in range(80)]
    y = np.array([float(3 in r) for r in rows])
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    got = toxicity.fit_ftrl(rows, y, alpha, beta, l1, l2, epochs=2)
    z, n = Counter(), Counter()
    seen = Counter(int(i) for r in rows for i in r)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias, bias_n = np.log(share / (1 - share)), 1.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(80):
            used = [int(i) for i in rows[k] if seen[int(i)] >= toxicity.MIN_DOCS]
            w = {i: weight(i) for i in used}
            g = 1 / (1 + np.exp(-(bias + sum(w.values())))) - y[k]
            for i in used:
                step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
                z[i] += g - step * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= alpha * g / np.sqrt(bias_n)
    want = {i: weight(i) for i in seen if weight(i)}
    assert dict(zip(got.buckets.tolist(), got.weights.tolist(), strict=True)) == pytest.approx(want, abs=1e-5) and got.intercept == pytest.approx(bias)


def test_clashing_names_and_repeated_training_rows(spark):
    rows = [(1, "alpha beta", 9, "s"), (1, "alpha", 9, "s"), (2, None, 9, "s"), (None, "x", 9, "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, Score int, _stats string").withColumn("predicted", F.lit("p")).withColumn("_times", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("source", F.lit("a"))
    marks = labels(spark, [(1, 1, 1), (2, 0, 0)])
    for model, score in ((quality.fit_quality(table, marks), quality.score_quality), (toxicity.fit_toxicity(table, marks), toxicity.score_toxicity)):
        got = score(table, model)
        assert got.columns == ["doc_id", "text", "_stats", "_times", "_row", "source", "score", "predicted"] and got.where("_stats = 's' and score between 0 and 1").count() == 4
    assert mixing.apply_mix(table).columns == table.columns
    few = toxicity.fit_toxicity(table, labels(spark, [(i, 1, i % 2) for i in range(9)]), max_train_chars=6)
    assert len(few.buckets) == 0


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "[~INST] ~ [~~SYS]", "", None, "plain\n[", "<s", "a</s>b😀", "[SAYS][ROLE]"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["system", "user", "assistant", "tool[SAYS]", None, "user", "assistant", "assistant"], said, strict=True))]
    rows += [(None, 1, "user", "x"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (3, None, "assistant", "z")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    chats = chat.format_chats(chat.conversation_messages(table))
    got = {r["tree"]: r for r in chats.select("tree", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r or "", t or "") for _, _, r, t in rows[:8]]
    assert [t["text"] for t in got[2]["turns"]] == ["a", "a", "b"]
    spans = [got[1]["formatted"][s["start"] - 1 : s["start"] - 1 + s["length"]] for s in got[1]["loss_spans"]]
    assert len(spans) == 3 and spans[0] == "" and spans[1] == "a<~/s>b😀"
    digest = {r["conv_id"]: r for r in chat.chat_digest(chats).collect()}
    assert digest[1]["loss_chars"] == len("a</s>b😀") + len("[SAYS][ROLE]") and None in digest and digest[3]["n_turns"] == 1
    assert chat.format_chats(chat.conversation_messages(table.limit(0))).count() == 0


def test_reply_tree_picks_the_best_branch(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "a"), (1, 3, 1, 5.0, "assistant", "b"), (1, 4, 2, 9.0, "user", "c"), (1, 5, 3, 1.0, "user", "d"), (2, 1, 77, 0.0, "user", "orphan"), (3, 1, 2, 0.0, "user", "x"), (3, 2, 1, 0.0, "user", "y")]
    table = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, score double, role string, text string")
    got = {(r["tree"], r["branch"]): r["formatted"] for r in chat.format_chats(table, branches=2).collect()}
    assert got == {(1, 1): "[INST]q</s>[ANS]a</s>[INST]c</s>", (1, 2): "[INST]q</s>[ANS]b</s>[INST]d</s>", (2, 1): "[INST]orphan</s>"}


VECTORS = "vec_id bigint, embedding array<float>, label int, shard int, block int, home int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4) for i, v in rows], VECTORS)


def odd_vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:160] = x[0] + rng.normal(size=(60, 16)).astype(np.float32) * 0.15
    x[160:170] = x[1]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    bad = [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [float("inf")] * 16), (504, [None] + [1.0] * 15), (600, []), (601, [1.0, 2.0]), (None, rows[0][1])]
    return x.astype(np.float64), rows, bad


def test_nearest_recall(spark):
    x, rows, bad = odd_vectors()
    table = vectors(spark, rows + bad + rows[:3])
    got = ann.nearest(table, table.where("vec_id % 20 = 0"), 10).collect()
    hits = total = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [k for k in np.lexsort((np.arange(400), d)) if k != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in mine)
        hits, total = hits + len({v for _, v, _ in mine} & set(want)), total + 10
    assert hits / total >= 0.9
    few = vectors(spark, rows[:4])
    assert ann.nearest(few, few, 10).count() == 12
    assert ann.nearest(table.limit(0), table, 10).count() == ann.nearest(table, table.limit(0), 10).count() == 0


@pytest.mark.parametrize("cell_rows,block", [(2048, 2048), (40, 16)])
def test_embedding_components(spark, cell_rows, block):
    x, rows, bad = odd_vectors()
    got = {r["vec_id"]: r for r in embed_dedup.embedding_components(vectors(spark, rows + bad), cell_rows=cell_rows, block=block, deviations=float("inf")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    label = np.arange(400)
    for _ in range(400):
        new = np.array([label[close[k]].min() for k in range(400)])
        if np.array_equal(new, label):
            break
        label = new
    assert [got[k]["n_links"] for k in range(400)] == (close.sum(axis=1) - 1).tolist()
    assert [got[k]["component_id"] for k in range(400)] == label.tolist()
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (500, 501, 502, 503, 504, 600, 601)) and not got[None]["kept"]
    assert embed_dedup.embedding_components(vectors(spark, [])).count() == 0
    assert embed_dedup.drop_near_vectors(vectors(spark, rows)).count() == len(set(label.tolist()))


def test_embedding_links_found_by_default(spark):
    x, rows, _ = odd_vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    found = embed_dedup.embedding_components(vectors(spark, rows), cell_rows=20, block=64).collect()
    n = {r["vec_id"]: r["n_links"] for r in found}
    assert all(n[k] <= want[k] for k in n) and sum(n.values()) >= 0.95 * want.sum()


def test_forest_compares_fewer_than_all():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 48))
    x[::3] = x[1::3] + rng.normal(size=(1000, 48)) * 0.3
    planes = np.random.default_rng(1).normal(size=(ann.TREES, 48, ann.BITS)).astype(np.float32)
    forest = ann.PrefixForest(x, planes, x.mean(axis=0))
    asked = np.arange(0, 3000, 60)
    got = forest.search(x[asked], asked, 10, 0.93)
    near = [set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11].tolist()) for q in asked]
    best = [set(ids[np.argsort(dist)[:10]].tolist()) for ids, dist in got]
    assert sum(len(a & b) for a, b in zip(near, best, strict=True)) >= 0.9 * 10 * len(asked)
    assert forest.compared.sum() < 0.6 * 3000 * len(asked)
    # prefixes of many lengths carry the candidates, none of them short
    assert forest.compared[4:].sum() == forest.compared.sum() and np.count_nonzero(forest.compared) >= 8
    # the search goes through the trees: the nearest copy shares a prefix with its query
    assert all(q + 1 in b for q, b in zip(asked, best, strict=True))


def test_lm_scores(spark, odd, none, monkeypatch):
    texts = {i: (t or "").encode().lower().split() for i, t, _ in ROWS}
    got = lm.lm_scores(odd).collect()
    rows = [(i, (t or "").encode().lower().split()) for i, t, _ in ROWS]
    train = [(i, w) for i, w in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2]
    c = Counter(x for _, w in train for x in [*w, None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(ROWS) and {r["train_tokens"] for r in got} == {n}
    for r in got:
        w = [*texts[r["doc_id"]], None]
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(x in c for x in w)
        assert abs(r["base_score"] - sum(np.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        assert r["score"] < 0
    assert lm.lm_scores(none).count() == 0
    # with few head words the counts of the others come by the join, and nothing changes
    monkeypatch.setattr(lm, "HEAD_WORDS", 8)
    rare = lm.lm_scores(odd).collect()
    assert sorted((r["doc_id"] or 0, r["n_known"], round(r["base_score"], 6)) for r in rare) == sorted((r["doc_id"] or 0, r["n_known"], round(r["base_score"], 6)) for r in got)


def lm_vocabulary(spark, texts, monkeypatch, classes=None):
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    return lm.build_vocabulary(lm.word_counts(table))


def test_lm_is_normalised(spark, monkeypatch):
    """The probabilities of all words of the model and of the units that are no class add up to 1."""
    monkeypatch.setattr(lm, "MIN_COUNT", 2)
    texts = [" ".join(f"w{i}x{k % 7}" for i in range(300)) for k in range(14)]
    vocabulary, total, _ = lm_vocabulary(spark, texts, monkeypatch)
    assert vocabulary.n_words == 2100 and total == 14 * 301
    model = lm.LogBilinear.fresh(vocabulary)
    words = np.arange(vocabulary.n_words)
    units = np.append(vocabulary.units(words, np.zeros(2100, np.int64)), [0, *range(1 + lm.TOP_WORDS + lm.CLASSES, lm.UNITS)])
    own = np.append(words, np.full(1 + lm.TAILS, -1))
    context = np.tile(np.array([[3], [2100 + lm.TAILS], [70]]), (1, len(own)))
    got = 10 ** model.log10_probs(lm.Tokens(units, own, context, own * 0), vocabulary)
    assert abs(got.sum() - 1) < 1e-3
    # against an explicit softmax over units and over a class
    h = sum(model.into[c] * model.scale[k] for k, c in enumerate((3, 2100 + lm.TAILS, 70)))
    soft = lambda z: np.exp(z) / np.exp(z).sum()
    first = soft(model.unit_out @ h + model.unit_bias)
    word = 900
    c = vocabulary.class_of[word]
    a, b = vocabulary.class_starts[c : c + 2]
    second = soft(model.word_out[a:b] @ h + model.word_bias[a:b])
    assert abs(got[word] - first[1 + lm.TOP_WORDS + c] * second[word - a]) < 1e-6


def test_lm_words_are_found(spark, monkeypatch):
    rng = np.random.default_rng(2)
    hashes = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    hashes[:900] = np.unique(hashes[0] + np.arange(900, dtype=np.uint64))  # many in one place
    hashes = rng.permutation(np.unique(hashes))
    table = lm.WordTable(hashes)
    assert np.array_equal(table.look_up(hashes), np.arange(len(hashes))) and (table.look_up(hashes + np.uint64(1 << 40)) == -1).mean() > 0.9


def test_lm_learns_what_follows(spark, monkeypatch):
    """Held-out text of a chain: far better than the counts alone, and near the chain's own entropy."""
    rng = np.random.default_rng(4)
    follow = {i: rng.integers(0, 400, 3) for i in range(400)}
    rows = []
    for k in range(900):
        word, text = int(rng.integers(400)), []
        for _ in range(80):
            text.append(f"w{word}{'abcdefgh'[word % 8]}")
            word = int(rng.choice(follow[word]))
        rows.append((k, " ".join(text), "a"))
    got = lm.lm_scores(docs(spark, rows)).where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert got[2] / got[0] > got[1] / got[0] + 0.25


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in got.description].index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in got.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet")
    frame = base
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == base.columns, name
    out = corpus_pipeline.run(spark, SF).toPandas()
    ids = {r[0] for r in base.select("doc_id").collect()}
    assert 0 < len(set(out["doc_id"])) <= len(ids) and set(out["doc_id"]) <= ids
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048


def test_spanning_forest_keeps_what_is_joined():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 30, (2, int(rng.integers(0, 60))))
        x, y = components.spanning_forest(a[a != b], b[a != b])
        given = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert all(frozenset(p) in given for p in zip(x.tolist(), y.tolist(), strict=True))
        roots = lambda p, q: dict(zip(*(v.tolist() for v in components.spanning_links(p, q)), strict=True))
        assert roots(a, b) == roots(x, y) and len(x) == len(roots(a, b))


def test_near_copies_of_long_texts(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(5000)]
    rows, alike = [], []
    for k in range(60):
        text = [words[i] for i in rng.integers(0, len(words), 300)]
        copy = list(text)
        for at in rng.choice(300, 4, replace=False):
            copy[at] = "other"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    rows += [(900, None), (901, ""), (None, "no id"), (902, "two words"), (903, "Two  words"), (904, "three short words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = dict(simhash.similar_components(docs).collect())
    assert all(found[2 * k] == found[2 * k + 1] == 2 * k for k in range(60))
    assert found[901] == 900 and found[903] == 902 and found[904] == 904 and found[None] is None and len(found) == 126
    assert simhash.drop_near_duplicates(docs).count() == 64
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def similar_by_force(texts, similarity=0.8):
    """Smallest position that links of five-word shingle sets lead to, for each text."""
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or len(x & sets[j]) >= similarity * len(x | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if k == b else k for k in label]
    return label


@pytest.mark.parametrize("group_rows,sketch_rows,slice_rows", [(2048, 65536, 4096), (6, 16, 4)])
def test_no_true_link_is_given_up_for_a_false_one(spark, monkeypatch, group_rows, sketch_rows, slice_rows):
    # hubs of small ids share a long passage with both copies of each pair, not enough to be copies of them
    rng = np.random.default_rng(12)
    words = np.array([f"w{k}" for k in range(4000)])
    draw = lambda n: words[rng.integers(0, len(words), n)].tolist()
    passage, hubs, lefts, rights = draw(250), [], [], []
    for k in range(30):
        hubs.append([*passage, *draw(90)])
        left = [*passage, *draw(80 + k)]
        lefts.append(left)
        rights.append([*left[:100], "new", *left[101:300], "other", *left[301:]] if k % 3 else [*left[:-20], *draw(20)])
    texts = [" ".join(t) for t in (*hubs, *lefts, *rights)] + ["", "  ", "one two", "One  two", "one two three"]
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(simhash, "SKETCH_ROWS", sketch_rows)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(simhash.similar_components(table, subtrie_rows=slice_rows).collect())
    want = similar_by_force(texts)
    assert all(want[got[i]] == want[i] for i in got)  # nothing is joined that is not alike
    pairs = [(30 + k, 60 + k) for k in range(30) if want[60 + k] == want[30 + k]]
    assert len(pairs) >= 25 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert got[91] == 90 and got[93] == 92 and got[94] == 94


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    x, y = "alpha beta gamma delta " * 30, "one two three four five six " * 20
    rows = [(1, x, "k", 1), (1, y, "k", 2), (2, x, "k", 3), (None, y, "k", 4), (None, "left alone here", "k", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _row string, _kept int")
    got = sorted((r["doc_id"] or 0, r["text"], r["_row"]) for r in simhash.drop_near_duplicates(table).collect())
    assert got == sorted([(0, "left alone here", "k"), (1, x, "k"), (1, y, "k")])
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.similar_components(table).select("doc_id", "component_id").collect() if r["component_id"])
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1)]


@pytest.mark.parametrize("width", [1, 3, 5])
def test_shingles_of_small_batches(width):
    import itertools

    for counts in itertools.product(range(3), repeat=3):
        for extra in range(4):
            texts = [" ".join(f"w{i}" for i in range(n)) for n in (*counts, extra)]
            data = "".join(texts).encode()
            words = Words(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]), stems=True)
            doc, shingle = simhash.shingle_sets(words, width)
            assert np.bincount(doc, minlength=4).tolist() == [len({tuple(t.split()[i : i + width]) for i in range(max(1, len(t.split()) - width + 1))}) if t else 0 for t in texts]
            features, _ = toxicity.hashed_features(words)
            assert np.bincount(features, minlength=4).tolist() == [2 * n + max(n - 1, 0) + max(n - 2, 0) for n in words.counts]
            none = lm.Vocabulary(np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0), 0, np.empty(0), np.ones(lm.UNITS), np.zeros(lm.UNITS))
            found = lm.sequences(words, none, none.look_up(words)[0])
            assert len(found.unit) == len(found.doc) == len(words.hashes) + 4 and found.context.shape == (lm.CONTEXT, len(found.unit))


def test_verified_links_of_large_classes():
    rng = np.random.default_rng(13)
    for spread in (30, 70, 110):  # bits from a centre: near copies, a chain of them, strangers
        centres = rng.integers(0, 1 << 63, (3, 12), dtype=np.int64)
        sketches = np.repeat(centres, 60, axis=0)
        for row in sketches:
            for b in rng.choice(np.arange(64, 768), spread, replace=False):
                row[b // 64] ^= np.int64(1) << np.int64(b % 64) if b % 64 < 63 else np.int64(-(1 << 63))
        sketches[:, 0] = 5
        n = len(sketches)
        rep = rng.permutation(n)
        for fp in (np.zeros(n, np.int64), np.arange(n) % 2):
            a, b = simhash.verified_links(np.zeros(n, np.int64), fp, rep, sketches, 2, 128)
            apart = np.bitwise_count((sketches[:, None] ^ sketches[None]).view(np.uint64)).sum(axis=2)
            allowed = (apart <= 128) & ((fp[:, None] != fp[None]) | (fp.max() == 0))
            x, y = np.nonzero(allowed)
            roots = lambda p, q: dict(zip(*(v.tolist() for v in components.spanning_links(p, q)), strict=True))
            assert roots(a, b) == roots(rep[x], rep[y]) and len(a) <= n


def test_packing_reports_its_bounds(spark):
    rng = np.random.default_rng(14)
    lengths = np.concatenate([rng.integers(1, 200, 3000), rng.integers(1100, 1400, 600), np.full(50, 2048)]).tolist()
    pieces = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(lengths)], packing.PIECE)
    report = []
    got = packing.pack(pieces, group_items=200, report=report).toPandas()
    *rounds, last = report
    assert last == {"sequences": got["sequence_id"].nunique(), "least": -(-sum(lengths) // 2048)}
    assert sum(r["closed"] for r in rounds) + 50 == last["sequences"]
    assert all(r["bound"] <= r["bins"] and 0 <= r["certified"] <= r["groups"] and r["closed"] <= r["bins"] for r in rounds)
    least = 50 + packing.bin_lower_bound(np.array(lengths[:-50]), 2048)
    assert least <= last["sequences"] <= 1.02 * least + 1
    report = []
    assert packing.pack(pieces.limit(0), report=report).count() == 0 and report == [{"sequences": 0, "least": 0}]
