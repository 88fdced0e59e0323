"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import BLOCK_BYTES, LOWER, Scratch, _segments, doc_blocks, text_buffers

#: Letters are a to z and U+00C0 to U+00FF, one byte each in Latin-1.
LETTERS = 26 + 64
_PLACE = np.zeros(256, np.int64)
_LETTER = np.concatenate([np.arange(97, 123), np.arange(192, 256)])
_PLACE[_LETTER] = np.arange(LETTERS)
#: Distinct words that a task counts before it sends them on.
COUNTED_WORDS = 300_000
#: Words of a length that are searched in one task, about; words sampled to cut a longer length into such parts; most parts.
PART_WORDS, SAMPLE_WORDS, MOST_PARTS = 8192, 16384, 1024
#: Points of a leaf of a tree, queries handled at once, word pairs verified at once.
LEAF_POINTS, QUERY_ROWS, PAIR_ROWS = 48, 32768, 1 << 19
#: Two groups of words with the same letters are compared pair by pair up to so many pairs, by sorted rests beyond.
DIRECT_PAIRS = 4096


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_length: int, spoil: int) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts, A-Z lower-cased, of least_length letters or more, and how often they occur.

    Where `spoil` divides the crc32 of "<id>:<run>", the run loses its letter at crc32 % length first. Whitespace ends a run, so very
    long texts are read in segments.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    run = re.compile("[a-zÀ-ÿ]{%d,}" % max(least_length, 1))

    def batch_of(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = text_buffers(batch.column(1))
            for i, j in doc_blocks(offsets):
                low = LOWER[data[offsets[i] : offsets[j]]]
                for d in range(i, j):
                    doc, seed = low[offsets[d] - offsets[i] : offsets[d + 1] - offsets[i]], zlib.crc32(f"{ids[d]}:".encode())
                    for a, b in _segments(doc) if len(doc) > 8 * BLOCK_BYTES else ((0, len(doc)),):
                        for word, n in Counter(run.findall(doc[a:b].tobytes().decode())).items():
                            h = zlib.crc32(word.encode(), seed)
                            if h % spoil == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_length:
                                    continue
                            total[word] += n
                    if len(total) > COUNTED_WORDS:
                        yield batch_of(total)
                        total.clear()
        yield batch_of(total)

    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of Latin-1 bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    n = len(letters)
    flat = np.arange(n)[:, None] * LETTERS + _PLACE[letters]
    return np.bincount(flat.ravel(), minlength=n * LETTERS).reshape(n, LETTERS).astype(np.int32)


class LetterTree:
    """K-d tree over letter-count vectors. A node splits its points at one letter's count; leaves keep their points' numbers.

    Boxes are those of the cells, for a tree that is fitted on a sample and has to place other points, or tight around the points.
    """

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        self.letter, self.cut, self.child, self.leaf_of = [], [], [], []
        self.low, self.high, self.leaves = [], [], []
        cell = (np.zeros(LETTERS, np.int32), np.full(LETTERS, np.iinfo(np.int32).max, np.int32))
        todo = [(np.arange(len(points)), *cell, -1, 0)]
        while todo:
            at, low, high, parent, side = todo.pop()
            node, mine = len(self.letter), points[at]
            if parent >= 0:
                self.child[parent][side] = node
            if tight and len(at):
                low, high = mine.min(axis=0), mine.max(axis=0)
            self.low.append(low), self.high.append(high), self.child.append([-1, -1])
            letter = cut = -1
            if len(at) > leaf:
                cuts = mine.mean(axis=0).astype(np.int32)  # rounded down
                share = (mine > cuts).mean(axis=0)
                letter = int(np.abs(share - 0.5).argmin())
                letter = -1 if share[letter] == 0 else letter
            if letter < 0:
                self.leaf_of.append(len(self.leaves))
                self.leaves.append(at)
            else:
                cut = int(cuts[letter])
                over = mine[:, letter] > cut
                left_high, right_low = high.copy(), low.copy()
                left_high[letter], right_low[letter] = cut, cut + 1
                self.leaf_of.append(-1)
                todo += [(at[~over], low, left_high, node, 0), (at[over], right_low, high, node, 1)]
            self.letter.append(letter), self.cut.append(cut)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(points), np.int64)
        letter, cut, child = np.array(self.letter), np.array(self.cut), np.array(self.child)
        while True:
            on = np.flatnonzero(letter[node] >= 0)
            if not len(on):
                return np.array(self.leaf_of)[node]
            here = node[on]
            node[on] = child[here, (points[on, letter[here]] > cut[here]).astype(np.int64)]

    def reach(self, points: np.ndarray, more: int, fewer: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, numbers of the points that may have a neighbour there): up to `more` letters added and `fewer` taken away lead into its box."""
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            mine = points[at]
            at = at[(np.maximum(self.low[node] - mine, 0).sum(axis=1) <= more) & (np.maximum(mine - self.high[node], 0).sum(axis=1) <= fewer)]
            if len(at) and self.letter[node] < 0:
                yield self.leaf_of[node], at
            elif len(at):
                todo += [(child, at) for child in self.child[node]]


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter (equal lengths) or by one letter that only `long` has."""
    n = short.shape[1]
    if n == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    first, last = short != long[:, :-1], (short != long[:, 1:])[:, ::-1]
    ahead = np.where(first.any(axis=1), first.argmax(axis=1), n)
    behind = np.where(last.any(axis=1), last.argmax(axis=1), n)
    return ahead + behind >= n


def _rests(letters: np.ndarray, letter: int) -> dict[tuple[int, bytes], list[int]]:
    """Rows by (place, the row without its letter there), for the places that hold `letter`."""
    found: dict[tuple[int, bytes], list[int]] = {}
    for r, p in zip(*np.nonzero(letters == letter), strict=True):
        row = letters[r].tobytes()
        found.setdefault((int(p), row[:p] + row[p + 1 :]), []).append(int(r))
    return found


def edits_between(a: np.ndarray, b: np.ndarray, taken: int, added: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and b one edit apart, where b has letter `added` more than a and `taken` less (-1: none, b is longer), in linear time."""
    x, y = [], []
    if taken < 0:
        rows = {row.tobytes(): k for k, row in enumerate(a)}
        for (_, rest), found in _rests(b, added).items():
            if rest in rows:
                x += [rows[rest]] * len(found)
                y += found
        pairs = np.unique(np.array([x, y], np.int64).reshape(2, -1), axis=1)  # a letter out of a run of it gives one rest
        return pairs[0], pairs[1]
    other = _rests(b, added)
    for key, found in _rests(a, taken).items():
        for r in other.get(key, ()):
            x += found
            y += [r] * len(found)
    return np.array(x, np.int64), np.array(y, np.int64)


def _classes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct vectors, order of the rows by vector, where each vector's rows start in it)."""
    flat = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, which = np.unique(flat, return_index=True, return_inverse=True)
    return vectors[first], np.argsort(which, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(first)))])


def near_pairs(members: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of members, of queries) of all pairs one edit apart; queries are as long as members or one letter shorter.

    The tree holds the distinct letter counts of the members. A query's counts visit the boxes that one letter more, and for equal
    lengths one less, can reach; there, squared distance 1 (2 for equal lengths) is one edit's, and only such pairs have their letters compared.
    Words with the same letters are never one edit apart.
    """
    shorter = members.shape[1] > queries.shape[1]
    points, order, start = _classes(letter_counts(members))
    tree = LetterTree(points, LEAF_POINTS, tight=True)
    wide = points.astype(np.float64)
    norms = (wide * wide).sum(axis=1)
    for q0 in range(0, len(queries), QUERY_ROWS):
        block = queries[q0 : q0 + QUERY_ROWS]
        asked, q_order, q_start = _classes(letter_counts(block))
        asked_wide = asked.astype(np.float64)
        asked_norms = (asked_wide * asked_wide).sum(axis=1)
        for leaf, at in tree.reach(asked, 1, 0 if shorter else 1):
            there = tree.leaves[leaf]
            squares = asked_norms[at][:, None] + norms[there] - 2 * asked_wide[at] @ wide[there].T
            i, j = np.nonzero(squares == (1 if shorter else 2))
            if not len(i):
                continue
            qc, mc = at[i], there[j]
            q_n, m_n = q_start[qc + 1] - q_start[qc], start[mc + 1] - start[mc]
            for k in np.flatnonzero(q_n * m_n > DIRECT_PAIRS):
                step = points[mc[k]] - asked[qc[k]]
                letter = lambda sign: int(_LETTER[np.flatnonzero(step == sign)[0]]) if (step == sign).any() else -1  # noqa: B023, E731
                mine, theirs = q_order[q_start[qc[k]] : q_start[qc[k] + 1]], order[start[mc[k]] : start[mc[k] + 1]]
                x, y = edits_between(block[mine], members[theirs], letter(-1), letter(1))
                if len(x):
                    yield theirs[y], q0 + mine[x]
            few = np.flatnonzero(q_n * m_n <= DIRECT_PAIRS)
            sizes = (q_n * m_n)[few]
            ends = np.cumsum(sizes)
            for k0 in _cuts(ends, PAIR_ROWS):
                some = few[k0]
                size = sizes[k0]
                pair = np.repeat(np.arange(len(some)), size)
                turn = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                q = q_order[q_start[qc[some]][pair] + turn // m_n[some][pair]]
                m = order[start[mc[some]][pair] + turn % m_n[some][pair]]
                good = one_edit(block[q], members[m])
                if good.any():
                    yield m[good], q0 + q[good]


def _cuts(ends: np.ndarray, limit: int) -> Iterator[slice]:
    """Ranges of items of about `limit` together; ends are running totals."""
    a = 0
    while a < len(ends):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield slice(a, b)
        a = b


#: Roles of a row in a part: stored in the tree, asking with the same length, asking with one letter less.
MEMBER, EQUAL, SHORTER = 0, 1, 2
NEAR = "word string, n_near bigint, best struct<away:bigint,word:string>"


def _search(part: pa.Table) -> pa.Table:
    """For each word of a part, the near words found there: how many, and the most frequent one, by (minus its n, word)."""
    role, n = part["role"].to_numpy(), part["n"].to_numpy()
    word = np.array(part["word"].to_pylist(), object)
    length = int(part["size"][0].as_py())
    stored = np.flatnonzero(role == MEMBER)
    # words in the order in which they are taken as forms: more frequent ones first, then by code points (Latin-1 keeps their order)
    rank = np.empty(len(word), np.int64)
    rank[np.lexsort((word, -n))] = np.arange(len(word))
    back = np.argsort(rank)
    count, best = np.zeros(len(word), np.int64), np.full(len(word), len(word), np.int64)
    members = letters_of(list(word[stored]), length)
    for kind, size in ((EQUAL, length), (SHORTER, length - 1)):
        asking = np.flatnonzero(role == kind)
        if not len(stored) or not len(asking) or size < 1:
            continue
        for m, q in near_pairs(members, letters_of(list(word[asking]), size)):
            m, q = stored[m], asking[q]
            # equal lengths: each pair is met from both its words; else the longer one, a member here, hears of it as well
            for to, other in ((q, m), (m, q)) if kind == SHORTER else ((q, m),):
                np.add.at(count, to, 1)
                np.minimum.at(best, to, rank[other])
    hit = np.flatnonzero(count)
    top = back[best[hit]]
    form = pa.StructArray.from_arrays([pa.array(-n[top], pa.int64()), pa.array(list(word[top]), pa.string())], ["away", "word"])
    return pa.table({"word": pa.array(list(word[hit]), pa.string()), "n_near": pa.array(count[hit], pa.int64()), "best": form})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best (away, word)) of words (word, n) of Latin letters that have a word one edit apart; best is the most frequent, away is -n.

    Words of one length are a part; lengths of more than PART_WORDS words are cut into parts by the upper levels of a k-d tree,
    which is fitted on a sample of about SAMPLE_WORDS of them and has MOST_PARTS leaves at most (beyond 8 million words of a
    length, parts grow). A word is stored in the one part that its letters fall into, and asks the parts of its own and of the next
    length that one edit can reach, so every pair is met, and met once from each side. Parts answer with one row a word.
    """
    size = F.length("word")
    long = words.groupBy(size.alias("size")).agg(F.count("*").alias("k")).where(F.col("k") > PART_WORDS).collect()
    trees = {}
    for r in long:
        sampled = words.where((size == r["size"]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, SAMPLE_WORDS / r["k"]))))
        some = letter_counts(letters_of([w["word"] for w in sampled.select("word").collect()], r["size"]))
        trees[r["size"]] = LetterTree(some, max(len(some) // min(-(-r["k"] // PART_WORDS), MOST_PARTS), 16), tight=False)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            sizes = np.array([len(w) for w in word], np.int64)
            for s in np.unique(sizes):
                mine = np.flatnonzero(sizes == s)
                counts = letter_counts(letters_of(list(word[mine]), int(s))) if s in trees or s + 1 in trees else np.zeros((len(mine), 1))
                for tree, target, role in ((trees.get(s), s, MEMBER), (trees.get(s), s, EQUAL), (trees.get(s + 1), s + 1, SHORTER)):
                    if tree is None:
                        parts = [(0, np.arange(len(mine)))]
                    elif role == MEMBER:
                        leaf = tree.place(counts)
                        parts = [(int(x), np.flatnonzero(leaf == x)) for x in np.unique(leaf)]
                    else:
                        parts = tree.reach(counts, 1, 1 if role == EQUAL else 0)
                    for leaf, at in parts:
                        k = len(at)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, target), pa.int32()), pa.array(np.full(k, leaf), pa.int32()), pa.array(np.full(k, role), pa.int8()), pa.array(list(word[mine[at]]), pa.string()), pa.array(n[mine[at]], pa.int64())], ["size", "part", "role", "word", "n"])

    dealt = words.select("word", "n").mapInArrow(deal, "size int, part int, role tinyint, word string, n bigint")
    found = dealt.groupBy("size", "part").applyInArrow(_search, NEAR)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5, factor: int = 5, spoil: int = 199) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n): the words of a corpus, their near words, and the frequent form that each stands for.

    Words are those of word_counts with at least least_n occurrences. Two are near if one inserted, deleted or replaced
    letter makes one the other. A word's form is its most frequent near word, the first in code-point order at a tie, if that
    occurs at least `factor` times as often, else null; its root is where forms lead to, or itself. form_n is the form's n,
    n_near the number of near words.

    Null texts have no words, a null id counts as empty text in crc32; rows that repeat count each. Texts are read whole, very
    long ones in segments. A corpus without words gives an empty result. Other columns are not read. Forms lead to words `factor`
    times as frequent, so their chains are short: rounds of doubling follow from the largest n.
    """
    spark = docs.sparkSession
    held = Scratch(spark)
    words = held.write(word_counts(docs, id_col, text_col, least_length, spoil).where(F.col("n") >= least_n), "words")
    near = held.write(near_words(words), "near-words")
    both = words.join(near, "word", "left")
    chosen = F.when(-F.col("best.away") >= factor * F.col("n"), F.col("best"))
    known = held.write(both.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), chosen["word"].alias("form"), (-chosen["away"]).alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, int(math.log(max(most / least_n, 1), factor)) + 1) if factor > 1 else 64
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = held.write(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots-{k}")
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
