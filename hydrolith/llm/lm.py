"""Language-model scoring: a log-bilinear model over words, trained by noise-contrastive estimation, normalised by class and word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import Words, materialize, remainder, word_blocks

#: First level of the output: the end token, the most frequent words, classes of the other words of the model, and
#: buckets of all remaining words by their last letters.
TOP_WORDS, CLASSES, TAILS = 31, 96, 16
UNITS = 1 + TOP_WORDS + CLASSES + TAILS
#: A word has vectors of its own if it occurs so often, and most words that do, since the model is sent to every task.
MIN_COUNT, MAX_WORDS = 8, TOP_WORDS + CLASSES * 256
CONTEXT, DIM = 3, 16
#: Most words whose counts are broadcast; the counts of all other words reach the texts by a join.
HEAD_WORDS = 1 << 18
#: Documents, about, that the common starting point is trained on before the pass over all of them, and by how many tasks.
WARM_DOCS, WARM_TASKS = 4000, 4
#: Characters that one task trains a model on, about.
TASK_CHARS = 32_000_000
NOISE, BATCH, RATE = 24, 4096, 0.07
#: Hash that stands for the end token, and its tail.
END = np.uint64(0x0E0D_70CE_0000_0001)
END_TAIL = -1


def tail_bucket(tails: np.ndarray | Column) -> np.ndarray | Column:
    """Bucket of a word's last letters."""
    if isinstance(tails, Column):
        return F.shiftright((tails.cast("bigint") * 2654435761).bitwiseAND(0xFFFFFFFF), 16).bitwiseAND(TAILS - 1)
    return ((tails * 2654435761) & 0xFFFFFFFF) >> 16 & (TAILS - 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (h, t, c): word hash, tail and count over all texts, and the end token's, once a document. Counts are added up per task before they are shuffled."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def total():
            h, t, c = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, t[first], np.bincount(inverse, c, len(u)).astype(np.int64)

        def batch_of(h, t, c):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.astype(np.int32)), pa.array(c)], ["h", "t", "c"])

        for batch in batches:
            for i, j, words in word_blocks(batch.column(0)):
                h = np.append(words.hashes, END)
                held.append((h, np.append(words.tails, END_TAIL), np.append(np.ones(len(h) - 1), j - i)))
                size += len(h)
                if size > 2_000_000:
                    held = [total()]
                    size = len(held[0][0])
                    if size > 500_000:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*total())

    return docs.mapInArrow(run, "h bigint, t int, c bigint").groupBy("h", "t").agg(F.sum("c").alias("c"))


class WordTable:
    """Positions of 64-bit hashes by open addressing: most look-ups take one or two steps."""

    def __init__(self, hashes: np.ndarray):
        bits = max(4, int(2 * len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.at = np.zeros((1 << bits) + 4096, np.uint64), np.full((1 << bits) + 4096, -1, np.int32)
        left = np.arange(len(hashes))
        slot = (hashes >> self.shift).astype(np.int64)
        while len(left):
            free = self.at[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.at[slot[first]] = hashes[left[first]], left[first]
            stay = np.ones(len(left), bool)
            stay[first] = False
            left, slot = left[stay], slot[stay] + 1

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each hash, or -1."""
        slot = (hashes >> self.shift).astype(np.int64)
        found = self.at[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[slot] != hashes))
        while len(wrong):
            slot[wrong] += 1
            found[wrong] = self.at[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[slot[wrong]] != hashes[wrong])]
        return found


@dataclass
class Vocabulary:
    """The head words, at most HEAD_WORDS, with count and number in the model (-1: none), and what each unit holds in all.

    Words of the model are numbered by class: the first TOP_WORDS are units of their own, then come CLASSES classes.
    """

    hashes: np.ndarray
    word: np.ndarray
    log_count: np.ndarray
    n_words: int
    word_share: np.ndarray
    unit_share: np.ndarray
    unit_log10: np.ndarray

    def __post_init__(self):
        self.table = WordTable(self.hashes)
        rest = self.n_words - TOP_WORDS
        self.class_starts = TOP_WORDS + np.arange(CLASSES + 1) * max(rest, 0) // CLASSES
        self.class_of = np.searchsorted(self.class_starts, np.arange(self.n_words), side="right") - 1

    def look_up(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number in the model or -1, log10(count + 1), is a head word) of each word."""
        if not len(self.hashes):
            return np.full(len(words.hashes), -1), np.zeros(len(words.hashes)), np.zeros(len(words.hashes), bool)
        at = self.table.look_up(words.hashes)
        known = at >= 0
        return np.where(known, self.word[at], -1), np.where(known, self.log_count[at], 0.0), known

    def units(self, word: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """First-level unit of each word, by its number in the model or else its tail."""
        in_class = 1 + TOP_WORDS + (self.class_of[word] if self.n_words else 0)
        return np.where(word < 0, 1 + TOP_WORDS + CLASSES + tail_bucket(tails), np.where(word < TOP_WORDS, 1 + word, in_class))


@dataclass
class Tokens:
    """Tokens of some documents, the end token last in each: unit, word of the model (-1: none), context, document."""

    unit: np.ndarray
    word: np.ndarray
    context: np.ndarray
    doc: np.ndarray


def sequences(words: Words, vocabulary: Vocabulary, word: np.ndarray) -> Tokens:
    """Each token with the CONTEXT words before it: numbers in the model, then tail buckets, then one for "none"."""
    n_docs = len(words.counts)
    lens = words.counts + 1
    ends = np.cumsum(lens) - 1
    n = len(word) + n_docs
    inner = np.ones(n, bool)
    inner[ends] = False
    unit, own, shown = np.zeros(n, np.int16), np.full(n, -1, np.int32), np.zeros(n, np.int32)
    unit[inner], own[inner] = vocabulary.units(word, words.tails), word
    shown[inner] = np.where(word < 0, vocabulary.n_words + tail_bucket(words.tails), word)
    at = np.arange(n) - np.repeat(ends - lens + 1, lens)
    context = np.full((CONTEXT, n), vocabulary.n_words + TAILS, np.uint16)
    for k in range(1, min(CONTEXT, n - 1) + 1):
        context[k - 1, k:] = np.where(at[k:] >= k, shown[:-k], vocabulary.n_words + TAILS)
    return Tokens(unit, own, context, np.repeat(np.arange(n_docs), lens))


class LogBilinear:
    """score(x | context) = bias[x] + out[x] . sum of the context words' vectors, each scaled by its distance.

    x is a unit of the first level or a word. The probability of a word is that of its unit among all units times, in a
    class, that of the word among the words of the class: both are normalised.
    """

    def __init__(self, parts: list[np.ndarray]):
        self.into, self.scale, self.unit_out, self.unit_bias, self.word_out, self.word_bias = parts

    @staticmethod
    def shapes(n_words: int) -> list[tuple[int, ...]]:
        return [(n_words + TAILS + 1, DIM), (CONTEXT, DIM), (UNITS, DIM), (UNITS,), (n_words, DIM), (n_words,)]

    @classmethod
    def fresh(cls, vocabulary: Vocabulary, seed: int = 5) -> LogBilinear:
        rng = np.random.default_rng(seed)
        parts = [rng.normal(0, 0.1, s).astype(np.float32) for s in cls.shapes(vocabulary.n_words)]
        parts[1] = (np.ones((CONTEXT, DIM)) / np.arange(1, CONTEXT + 1)[:, None]).astype(np.float32)
        parts[3] = np.log(vocabulary.unit_share).astype(np.float32)
        parts[5] = np.log(vocabulary.word_share).astype(np.float32)
        return cls(parts)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.into, self.scale, self.unit_out, self.unit_bias, self.word_out, self.word_bias)])

    @classmethod
    def of(cls, flat: np.ndarray, n_words: int) -> LogBilinear:
        shapes = cls.shapes(n_words)
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return cls([x.astype(np.float32).reshape(s) for x, s in zip(np.split(flat, cuts), shapes, strict=True)])

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.into[context[0]] * self.scale[0]
        for k in range(1, CONTEXT):
            h += self.into[context[k]] * self.scale[k]
        return h

    @staticmethod
    def _picked(h: np.ndarray, out: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each row's target among all rows of `out`, whose last column is the bias, as the last of h is one."""
        logits = h @ out.T
        if logits.size and logits.max() > 80:
            logits -= logits.max(axis=1, keepdims=True)
        got = logits[np.arange(len(h)), target].astype(np.float64)
        np.exp(logits, out=logits)
        return got - np.log(logits @ np.ones(len(out), np.float32))

    def log10_probs(self, tokens: Tokens, vocabulary: Vocabulary, step: int = 1 << 16, part: int = 2048) -> np.ndarray:
        """Normalised log10 probability of each token, where no word of the model, of its unit: matrix products and sums."""
        out = np.empty(len(tokens.unit))
        units, words = np.column_stack([self.unit_out, self.unit_bias]), np.column_stack([self.word_out, self.word_bias])
        for i in range(0, len(out), step):
            t, w = tokens.unit[i : i + step], tokens.word[i : i + step]
            h = np.ones((len(t), DIM + 1), np.float32)
            for j in range(0, len(t), part):
                h[j : j + part, :DIM] = self.hidden(tokens.context[:, i + j : i + min(j + part, len(t))])
            got = np.concatenate([self._picked(h[j : j + part], units, t[j : j + part]) for j in range(0, len(t), part)])
            rows = np.flatnonzero(w >= TOP_WORDS)
            group = (t[rows] - 1 - TOP_WORDS).astype(np.uint8)
            rows = rows[np.argsort(group, kind="stable")]
            ends = np.cumsum(np.bincount(group, minlength=CLASSES))
            for c in np.flatnonzero(np.diff(np.append(0, ends))):
                own = rows[ends[c - 1] if c else 0 : ends[c]]
                a, b = vocabulary.class_starts[c : c + 2]
                got[own] += self._picked(h[own], words[a:b], w[own] - a)
            out[i : i + step] = got / np.log(10)
        return out


class NceTrainer:
    """Noise-contrastive estimation (Mnih and Teh 2012) with AdaGrad, of units and of words; the noise of a batch is shared by its tokens."""

    def __init__(self, model: LogBilinear, vocabulary: Vocabulary, seed: int):
        self.m, self.rng, self.seen = model, np.random.default_rng(seed), 0
        self.levels = []
        for out, bias, share in ((model.unit_out, model.unit_bias, vocabulary.unit_share), (model.word_out, model.word_bias, vocabulary.word_share)):
            weighed = np.where(np.arange(len(share)) >= TOP_WORDS, share, 0) if out is model.word_out else share
            total = weighed.sum()
            if total > 0:
                weighed = weighed / total
                self.levels.append((out, bias, np.log(NOISE * np.maximum(weighed, 1e-12)).astype(np.float32), np.cumsum(weighed), np.ones(out.shape, np.float32), np.ones(bias.shape, np.float32)))
        self.g_into, self.g_scale = np.ones(model.into.shape, np.float32), np.ones(model.scale.shape, np.float32)

    @staticmethod
    def _sums(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct indexes and the sum of each one's rows."""
        order = np.argsort(index.astype(np.uint16), kind="stable")
        index = index[order]
        first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
        return index[first], np.add.reduceat(values[order], first, axis=0)

    @staticmethod
    def _step(p: np.ndarray, held: np.ndarray, at, g: np.ndarray) -> None:
        grown = held[at] + g * g
        held[at] = grown
        p[at] -= RATE * g / np.sqrt(grown)

    def _level(self, level: tuple, t: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Learn targets t of hidden vectors h; the gradient of h."""
        out, bias, log_noise, cumulative, g_out, g_bias = level
        noise = np.minimum(np.searchsorted(cumulative, self.rng.random(NOISE)), len(bias) - 1)
        own, other = out[t], out[noise]
        d_true = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", h, own) + bias[t] - log_noise[t], -15, 15))) - 1
        d_fake = 1 / (1 + np.exp(-np.clip(h @ other.T + bias[noise] - log_noise[noise], -15, 15)))
        g_h = d_true[:, None] * own + d_fake @ other
        rows = np.empty((len(t) + NOISE, DIM + 1), np.float32)
        rows[: len(t), :DIM], rows[: len(t), DIM] = d_true[:, None] * h, d_true
        rows[len(t) :, :DIM], rows[len(t) :, DIM] = d_fake.T @ h, d_fake.sum(axis=0)
        at, g = self._sums(np.concatenate([t, noise]), rows)
        self._step(out, g_out, at, g[:, :DIM])
        self._step(bias, g_bias, at, g[:, DIM])
        return g_h

    def learn(self, tokens: Tokens) -> None:
        m = self.m
        for i in range(0, len(tokens.unit), BATCH):
            t, w, c = tokens.unit[i : i + BATCH].astype(np.int64), tokens.word[i : i + BATCH], tokens.context[:, i : i + BATCH]
            n, h = len(t), m.hidden(c)
            g_h = self._level(self.levels[0], t, h)
            rows = np.flatnonzero(w >= TOP_WORDS)
            if len(rows) and len(self.levels) > 1:
                g_h[rows] += self._level(self.levels[1], w[rows].astype(np.int64), h[rows])
            at, g = self._sums(c.ravel(), np.concatenate([g_h * m.scale[k] for k in range(CONTEXT)]))
            g_scale = np.stack([np.einsum("ij,ij->j", g_h, m.into[c[k]]) for k in range(CONTEXT)])
            self._step(m.into, self.g_into, at, g)
            self._step(m.scale, self.g_scale, slice(None), g_scale)
            self.seen += n


def _mean_model(rows: DataFrame) -> np.ndarray | None:
    """Token-weighted mean of the models that the tasks trained, in two levels: at most 8 rows reach the driver."""

    def add(batches):
        total, n = None, 0
        for batch in batches:
            for k in range(len(batch)):
                count, part = batch.column(0)[k].as_py(), np.frombuffer(batch.column(1)[k].as_buffer(), np.float32) * np.float64(batch.column(0)[k].as_py())
                total, n = (part if total is None else total + part), n + count
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["n", "params"])

    got = rows.repartition(8).mapInArrow(add, "n bigint, params binary").toArrow().to_batches()
    final = list(add(got))
    return np.frombuffer(final[0].column(1)[0].as_py(), np.float32) if final else None


def train_log_bilinear(texts: DataFrame, vocabulary: Vocabulary) -> LogBilinear:
    """Some WARM_DOCS documents, picked by hash, give one common start; each task then trains it on all its texts, and the models are averaged.

    Input splits are put together until a task has about TASK_CHARS characters, so the models sent stay small beside the texts.
    """
    start = LogBilinear.fresh(vocabulary).flat()

    def trainer(flat):
        def run(batches):
            state = NceTrainer(LogBilinear.of(flat, vocabulary.n_words), vocabulary, 3)
            for batch in batches:
                for _, _, words in word_blocks(batch.column(0)):
                    state.learn(sequences(words, vocabulary, vocabulary.look_up(words)[0]))
            if state.seen:
                yield pa.RecordBatch.from_arrays([pa.array([state.seen], pa.int64()), pa.array([state.m.flat().tobytes()], pa.binary())], ["n", "params"])

        return run

    schema = "n bigint, params binary"
    n, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    some = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, WARM_DOCS / max(n, 1)) * (1 << 20))
    warm = texts.where(some).select("text").repartition(WARM_TASKS)
    first = _mean_model(warm.mapInArrow(trainer(start), schema))
    tasks = max(2 * texts.sparkSession.sparkContext.defaultParallelism, int(chars // TASK_CHARS))
    flat = _mean_model(texts.select("text").coalesce(tasks).mapInArrow(trainer(start if first is None else first), schema))
    return LogBilinear.of(start if flat is None else flat, vocabulary.n_words)


def build_vocabulary(counts: DataFrame) -> tuple[Vocabulary, int, int]:
    """(vocabulary, total tokens, distinct tokens) of a table of word counts. At most HEAD_WORDS rows reach the driver."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("c") * 8).alias("k")).count().collect()), reverse=True)
    least, held = 1 << 30, 0
    for k, n in steps:
        if held + n > HEAD_WORDS:
            break
        held, least = held + n, k
    head = counts.where(F.floor(F.log2("c") * 8) >= least).toArrow()
    h, t, c = head["h"].to_numpy().view(np.uint64), head["t"].to_numpy().astype(np.int64), head["c"].to_numpy()
    plain = np.flatnonzero(t != END_TAIL)
    often = plain[np.lexsort((h[plain], -c[plain]))]
    often = often[: max(TOP_WORDS, int((c[often] >= MIN_COUNT).sum()))][:MAX_WORDS]
    rest = often[TOP_WORDS:]
    often = np.append(often[:TOP_WORDS], rest[np.lexsort((h[rest], t[rest]))])  # words of a class have like endings
    word = np.full(len(h), -1, np.int32)
    word[often] = np.arange(len(often))
    mass = np.ones(UNITS)
    tails = 1 + TOP_WORDS + CLASSES
    for bucket, sum_ in counts.where(F.col("t") != END_TAIL).groupBy(tail_bucket(F.col("t")).alias("b")).agg(F.sum(F.col("c") + 1)).collect():
        mass[tails + bucket] += sum_
    np.subtract.at(mass, tails + tail_bucket(t[often]), c[often] + 1)
    word_mass = c[often] + 1.0
    end = c[t == END_TAIL]
    mass[0] = (end[0] if len(end) else 0) + 1
    found = Vocabulary(h, word, np.log10(c + 1.0), len(often), word_mass / max(word_mass.sum(), 1.0), mass, np.zeros(UNITS))
    np.add.at(mass, found.units(np.arange(len(often)), t[often]), word_mass)
    found.unit_share, found.unit_log10 = mass / mass.sum(), np.log10(mass)
    return found, int(total), int(distinct)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs; other columns are not read.

    Learnt from the documents whose crc32(id) mod 7 is not 2. Tokens are words and one end. base_score is the add-one
    unigram log10 probability; score is that of the log-bilinear model. Words that occur MIN_COUNT times, at most
    MAX_WORDS, have vectors of their own; any other word has the probability of its tail bucket times its add-one share
    of it. Counts cover all training words: those of head words are broadcast, the others are joined. Null and empty
    texts are their end token alone, whole texts are scored however long. Null ids and repeated rows stay; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held_out = remainder(F.col("doc_id"), 7) == 2
    train = rows.where(~held_out)
    counts = materialize(word_counts(train.select("text")), "word-counts")
    vocabulary, total, distinct = build_vocabulary(counts)
    model = train_log_bilinear(train, vocabulary)
    end_log = float(vocabulary.unit_log10[0]) if total else 0.0

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for _, _, words in word_blocks(batch.column(1)):
                word, log_count, known = vocabulary.look_up(words)
                tokens = sequences(words, vocabulary, word)
                n = len(words.counts)
                doc = np.repeat(np.arange(n), words.counts)
                tail = word < 0
                share = np.where(tail, log_count - vocabulary.unit_log10[vocabulary.units(word, words.tails)], 0.0)
                cols[0].append(words.counts + 1)
                cols[1].append(np.bincount(doc, known, n).astype(np.int64) + bool(total))
                cols[2].append(np.bincount(doc, log_count, n) + end_log)
                cols[3].append(np.bincount(tokens.doc, model.log10_probs(tokens, vocabulary), n) + np.bincount(doc, share, n))
                rest = np.flatnonzero(~known)
                order = rest[np.lexsort((words.hashes[rest], doc[rest]))]
                d, h = doc[order], words.hashes[order]
                first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(order) else np.empty(0, np.int64)
                times = np.diff(np.append(first, len(order)))
                ends = np.append(0, np.searchsorted(d[first], np.arange(n), side="right"))
                for k, values, kind in ((4, h[first].view(np.int64), pa.int64()), (5, times.astype(np.int32), pa.int32())):
                    cols[k].append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind)))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            flat = [pa.array(np.concatenate(c), k) for c, k in zip(cols[:4], kinds, strict=True)] if cols[0] else [pa.array([], k) for k in kinds]
            lists = [pa.chunked_array(c, pa.list_(k)).combine_chunks() for c, k in zip(cols[4:], (pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *flat, *lists], ["doc_id", "n_tokens", "n_known", "log_counts", "neural", "rare", "times"])

    scored = rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, log_counts double, neural double, rare array<bigint>, times array<int>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), "w.times")
    found = rare.join(counts.select("h", "c"), "h").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_log"))
    out = scored.drop("rare", "times").join(found, "row", "left")
    logs = F.col("log_counts") + F.coalesce("more_log", F.lit(0.0))
    return out.select(
        "doc_id",
        (remainder(F.col("doc_id"), 7) == 2).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (F.col("neural") + F.coalesce("more_log", F.lit(0.0))).alias("score"),
    )
