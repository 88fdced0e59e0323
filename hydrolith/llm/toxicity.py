"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import Words, labelled_sample, labelled_texts, materialize, mix, remainder, word_blocks

#: log2 of the number of hash buckets.
HASH_BITS = 22
#: Most labelled documents that the model is fitted on, picked by hash of the id.
MAX_TRAIN_DOCS = 6000
#: Most characters that these documents have together.
MAX_TRAIN_CHARS = 32_000_000
#: A feature must stand in so many of them.
MIN_DOCS = 3


def hashed_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word, word stem, word pair and pair with one word between, within each document."""
    h, n = words.hashes, len(words.hashes)
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    docs, keys = [doc, doc], [h, words.stems]
    for gap, a in ((1, 0x9FB21C651E98DF25), (2, 0xD6E8FEB86659FD93)):
        same = doc[gap:] == doc[: max(n - gap, 0)]
        docs.append(doc[gap:][same])
        keys.append(mix(h[: max(n - gap, 0)][same] * np.uint64(a) + h[gap:][same] * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.concatenate(docs), (np.concatenate(keys) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


@dataclass
class SparseLogistic:
    """Weights of the buckets that are not zero, ascending, and the intercept: a few thousand numbers at most."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << HASH_BITS, np.float32)
        dense[self.buckets] = self.weights
        return dense

    def margins(self, words: Words, table: np.ndarray) -> np.ndarray:
        """Intercept plus the weights of each document's distinct buckets."""
        doc, bucket = hashed_features(words)
        weight = table[bucket]
        hit = np.flatnonzero(weight)
        pair = np.unique((doc[hit] << HASH_BITS) | bucket[hit])
        sums = np.bincount(pair >> HASH_BITS, table[pair & ((1 << HASH_BITS) - 1)].astype(np.float64), len(words.counts))
        return sums + self.intercept


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1, epochs: int = 6, seed: int = 7) -> SparseLogistic:
    """FTRL-proximal (McMahan et al. 2013) over documents as sets of buckets; each coordinate has a rate of its own."""
    if not len(rows):
        return SparseLogistic(np.empty(0, np.int64), np.empty(0, np.float32), 0.0)
    df = np.zeros(1 << HASH_BITS, np.int32)
    for r in rows:
        df[r] += 1
    buckets = np.flatnonzero(df >= MIN_DOCS)
    place = np.zeros(1 << HASH_BITS, np.int32)
    place[buckets] = np.arange(len(buckets))
    docs = [place[r[df[r] >= MIN_DOCS]] for r in rows]
    z, n = np.zeros(len(buckets)), np.zeros(len(buckets))
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias, bias_n = float(np.log(share / (1 - share))), 1.0
    rng = np.random.default_rng(seed)

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            i = docs[k]
            zi, ni = z[i], n[i]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - labels[k]
            grown = ni + g * g
            z[i] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[i] = grown
            bias_n += g * g
            bias -= alpha * g / np.sqrt(bias_n)
    w = weight(z, n)
    keep = np.flatnonzero(w)
    return SparseLogistic(buckets[keep], w[keep].astype(np.float32), bias)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    label_id_col: str = "doc_id",
    max_train_docs: int = MAX_TRAIN_DOCS,
    max_train_chars: int = MAX_TRAIN_CHARS,
) -> SparseLogistic:
    """Fit on a sample of at most max_train_docs labelled documents of max_train_chars characters together.

    No label of the held-out fifth is read. Rows that share an id count once, by their smallest text; null ids and labels
    are left out. In the order of the ids' hashes a document is left out if it would take the total over
    max_train_chars, so what reaches the driver is bounded in bytes too. No documents: weightless, every score is 0.5.
    """
    sample = labelled_sample(labels, label_col, label_id_col, max_train_docs)
    rows = labelled_texts(docs, sample, id_col, text_col)

    def run(batches):
        for batch in batches:
            sets: list[np.ndarray] = []
            for _, _, words in word_blocks(batch.column(1), stems=True):
                doc, bucket = hashed_features(words)
                pair = np.unique((doc << HASH_BITS) | bucket)
                sets += np.split((pair & ((1 << HASH_BITS) - 1)).astype(np.int32), np.searchsorted(pair >> HASH_BITS, np.arange(1, len(words.counts))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["label", "buckets"])

    rows = materialize(rows.select("doc_id", "label", "text", F.length("text").alias("chars")), "labelled-texts")
    total, over = 0, []
    for doc_id, chars in rows.select("doc_id", "chars").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + chars > max_train_chars:
            over.append(doc_id)
        else:
            total += chars
    if over:
        rows = rows.where(~F.col("doc_id").isin(over))
    got = rows.orderBy("doc_id").select("label", "text").mapInArrow(run, "label int, buckets array<int>").toArrow()
    sets = [x.values.to_numpy() for x in got["buckets"]]
    return fit_ftrl(sets, got["label"].to_numpy().astype(np.float64))


def score_toxicity(docs: DataFrame, model: SparseLogistic, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with (score, predicted).

    Whole texts are scored, however long; null and empty texts get the intercept's score. All rows stay, and all columns
    but those of docs that are named score or predicted, which the new ones replace.
    """
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in names) + ", score double"
    at = names.index(text_col)

    def run(batches):
        table = model.table()
        for batch in batches:
            parts = [model.margins(words, table) for _, _, words in word_blocks(batch.column(at), stems=True)]
            margin = np.concatenate(parts) if parts else np.empty(0)
            score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*names, "score"])

    kept = docs.select([F.col(f"`{c}`") for c in names])
    return kept.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs; other columns are not read.

    Repeated rows are scored each, whole texts however long; null texts count as empty, and empty ones have the score of no features; a null id is
    held out. An empty docs or labels table is no
    error: without labels every score is 0.5.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = fit_toxicity(narrow, labels)
    scored = score_toxicity(narrow, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
