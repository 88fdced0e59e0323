"""SimHash near-duplicates: a binary trie joined with itself under a Hamming error budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import NO_ID, Scratch, fresh, give_back, materialize, mix, text_buffers, word_blocks
from hydrolith.llm.components import connected_components, spanning_links

BITS = 64
#: Fingerprints of a subtrie that one task joins; a larger subtrie is split on further bits first.
SUBTRIE_ROWS = 256
SEED = 42
#: The long fingerprint of the similarity search: so many slices, each with a trie of its own, of so many bits.
SLICES, SLICE_BITS = 24, 32
#: Rows of a slice that one task joins at once: most slices of 32 bits need no second split at this size.
SLICE_ROWS = 4096
#: Members of a group of equal or near slices whose sketches meet in one task, at most.
SKETCH_ROWS = 65536
#: Texts of a group of candidates that meet in one task, and their characters, at most.
GROUP_ROWS, GROUP_CHARS = 2048, 48_000_000
#: Members of a group over these bounds, about, that meet in each of its blocks, so that the blocks' components grow together.
PIVOTS = 32
#: Pairs of sketches that are compared at once.
PAIRS_AT_ONCE = 1 << 16
#: Buckets that shingles are summed up in before the projection, and how many of them a shingle stands in.
BUCKETS, SPREAD = 1024, 4


def fingerprint(text: bytes, width: int = 3) -> bytes:
    """Eight bytes: bit set where more than half of the shingles' XXH64 have it; no words: zero."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= width:
        digests = xxhash.xxh64_digest(joined, SEED)
        return digests
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - width + 1].tolist()
    digest, seed = xxhash.xxh64_digest, SEED
    total, n, step = np.zeros(BITS, np.int64), len(starts), 1 << 15
    ends = ends[width - 1 :].tolist()
    for i in range(0, n, step):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[i : i + step], ends[i : i + step], strict=True)])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (doc_id, fp), one for each row of docs: fp is the fingerprint of the whole text, however long, as a signed 64-bit number.

    Null text counts as empty: fingerprint 0. Null ids and repeated rows stay, an empty table gives an empty result, other columns are not read.
    """

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            view = memoryview(data)
            fps = b"".join(fingerprint(bytes(view[a:b]), width) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def trie_links(keys: np.ndarray, group_starts: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of keys of the same group that differ in at most `budget` bits.

    keys: distinct uint64 within a group, sorted within each group; a group is the root of its own trie. A trie node is
    a range of the sorted keys. Pairs of nodes go down together one bit at a time; a pair that takes different
    branches spends one error and is dropped once it has spent more than the budget.
    """
    ends = np.append(group_starts[1:], len(keys))
    keep = ends - group_starts > 1
    a0, a1 = group_starts[keep], ends[keep]
    b0, b1, err = a0, a1, np.zeros(len(a0), np.int64)
    found: list[np.ndarray] = []
    for bit in range(BITS - 1, -1, -1):
        if not len(a0):
            break
        one = np.append(0, np.cumsum((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64))
        am, bm = a1 - (one[a1] - one[a0]), b1 - (one[b1] - one[b0])
        same = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), *([(am[~same], a1[~same], b0[~same], bm[~same], err[~same] + 1)] if not same.all() else [])]
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        alone = (a0 == b0) & (a1 == b1) & (a1 - a0 < 2)
        live = (a1 > a0) & (b1 > b0) & (err <= budget) & ~alone
        a0, a1, b0, b1, err = a0[live], a1[live], b0[live], b1[live], err[live]
        # a pair of single keys needs no further descent
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            close = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            found.append(np.stack([i[close], j[close]]))
            a0, a1, b0, b1, err = a0[~leaf], a1[~leaf], b0[~leaf], b1[~leaf], err[~leaf]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.sort(np.concatenate(found, axis=1), axis=0)
    return pairs[0], pairs[1]


def _groups(batches):
    """Record batches (group, fp, ...) of numbers, sorted by group, as arrays that hold whole groups."""
    rest = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))[-1]
        rest = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols]
    if rest is not None:
        yield rest


def _masks(free: tuple[int, ...], parts: int) -> list[tuple[int, ...]]:
    """Cut the free bits into `parts` blocks; each entry is what stays free if that block's bits agree."""
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [free[: cuts[k]] + free[cuts[k + 1] :] for k in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _join_subtries(classes: DataFrame, task, schema: str, budget: int, subtrie_rows: int, free_bits: tuple[int, ...], worth: Column | None = None) -> DataFrame:
    """Rows that `task` makes of the Arrow batches (group, fp, further columns) of all subtries, sorted by group; see near_links.

    Subtries where the aggregate `worth` is false are left out.
    """
    parts, columns = budget + 1, ["fp", *(c for c in classes.columns if c != "fp")]
    out, level = None, 0
    pending = [(classes.select(columns), free_bits)]
    while pending:
        rows, free = pending.pop()
        options = _masks(free, parts)
        fixed = [_signed(((1 << BITS) - 1) ^ sum(1 << (BITS - 1 - k) for k in rest)) for rest in options]
        keyed = rows.select(*columns, F.explode(F.array(*[F.struct(F.lit(k).alias("top"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(fixed)])).alias("at")).select(*columns, "at.top", "at.value")
        sizes = keyed.groupBy("top", "value").agg(F.count("*").alias("n"), (F.lit(True) if worth is None else worth).alias("worth"))
        sizes = materialize(sizes.where("n > 1 and worth").select("top", "value", "n"), "subtries")
        keyed = keyed.join(sizes, ["top", "value"])
        small = F.col("n") <= subtrie_rows if len(options[0]) > 8 else F.lit(True)
        ready = keyed.where(small).select(F.xxhash64(F.lit(level), "top", "value").alias("g"), *columns)
        ready = ready.repartition("g").sortWithinPartitions("g")
        made = ready.mapInArrow(task, schema)
        out = made if out is None else out.union(made)
        if len(options[0]) > 8:
            for (k,) in sizes.where(F.col("n") > subtrie_rows).select("top").distinct().collect():
                pending.append((materialize(keyed.where((F.col("top") == k) & (F.col("n") > subtrie_rows)).select(columns), "hot-subtrie"), options[k]))
        level += 1
    return out


def near_links(classes: DataFrame, budget: int = 2, subtrie_rows: int = SUBTRIE_ROWS, free_bits: tuple[int, ...] = tuple(range(BITS))) -> DataFrame:
    """Links (a, b) between the representatives of distinct fingerprints that differ in at most `budget` bits.

    classes: (fp bigint, rep bigint), fp distinct. Two fingerprints within the budget agree on one of budget + 1 blocks
    of bits at least, so each block is taken in turn as the top of the trie, where no error is allowed; every
    fingerprint goes to the subtrie below its block's value. A subtrie with more rows than `subtrie_rows` is split the
    same way on its remaining bits, until so few bits are free that it is small by itself. Links of one subtrie are
    returned as stars, so a group of near copies returns no more links than it has members. Bits other than `free_bits`
    must agree.
    """

    def join(batches):
        for group, fp, rep in _groups(batches):
            keys = fp.astype(np.int64).view(np.uint64)
            order = np.lexsort((keys, group))
            starts = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
            i, j = trie_links(keys[order], starts, budget)
            a, b = spanning_links(rep[order][i], rep[order][j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _join_subtries(classes.select("fp", "rep"), join, "a bigint, b bigint", budget, subtrie_rows, free_bits)


def near_groups(classes: DataFrame, budget: int, subtrie_rows: int, free_bits: tuple[int, ...]) -> DataFrame:
    """Rows (g, fp): the fingerprints of each subtrie g that have another one of it within the budget, of another label; as near_links.

    classes: (fp, low, high), the smallest and the largest label of what has the fingerprint. Two fingerprints whose
    labels are all the same are no pair. A subtrie's pairs that do not hang together are groups by themselves.
    """

    def join(batches):
        for group, fp, low, high in _groups(batches):
            keys = fp.astype(np.int64).view(np.uint64)
            order = np.lexsort((keys, group))
            group, keys, low, high = group[order], keys[order], low[order], high[order]
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            i, j = trie_links(keys, starts, budget)
            apart = np.minimum(low[i], low[j]) != np.maximum(high[i], high[j])
            child, parent = spanning_links(i[apart], j[apart])
            roots = np.unique(parent)
            at, root = np.append(child, roots), np.append(parent, roots)
            g = mix(group[at].astype(np.int64).view(np.uint64) ^ mix(keys[root])).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(keys[at].view(np.int64), pa.int64())], ["g", "fp"])

    return _join_subtries(classes.select("fp", "low", "high"), join, "g bigint, fp bigint", budget, subtrie_rows, free_bits, F.min("low") < F.max("high"))


def _first_of(known: np.ndarray) -> np.ndarray:
    """For each entry the position of the first one that equals it."""
    _, first, inverse = np.unique(known, return_index=True, return_inverse=True)
    return first[inverse]


class _Verified:
    """Components of nodes whose sketches differ in at most `limit` bits; only pairs that it is given are compared."""

    def __init__(self, sketches: np.ndarray, limit: int, label: np.ndarray):
        """label: a node of its component for each node, as known before."""
        self.sketches, self.limit, self.label = sketches, limit, label

    def try_pairs(self, x: np.ndarray, y: np.ndarray) -> None:
        apart = self.label[x] != self.label[y]
        x, y = x[apart], y[apart]
        close = np.bitwise_count(self.sketches[x] ^ self.sketches[y]).sum(axis=1, dtype=np.int64) <= self.limit
        if close.any():
            child, parent = spanning_links(self.label[x[close]], self.label[y[close]])
            to = np.arange(len(self.label))
            to[child] = parent
            self.label = to[self.label]

    def try_all(self, xs: np.ndarray, ys: np.ndarray) -> None:
        """All pairs of xs with ys but those already joined. One node's component grows first, so that a group of
        near copies takes few comparisons a member."""
        self.try_pairs(np.full(len(ys), xs[0]), ys)
        self.try_pairs(np.full(len(xs), ys[0]), xs)
        both = np.concatenate([xs, ys])
        labels, n = np.unique(self.label[both], return_counts=True)
        most = labels[np.argmax(n)]  # a label is a node of its component
        for own, other in ((xs, ys), (ys, xs)):
            rest = own
            while len(rest := rest[self.label[rest] != self.label[most]]):
                x, rest = rest[0], rest[1:]
                for lo in range(0, len(other), PAIRS_AT_ONCE):
                    part = other[lo : lo + PAIRS_AT_ONCE]
                    self.try_pairs(np.full(len(part), x), part)


def verified_links(group: np.ndarray, fp: np.ndarray, rep: np.ndarray, sketches: np.ndarray, budget: int, limit: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join what these pairs join: of one group, fp within the budget, sketches within `limit` bits.

    Rows of an equal fp are compared with each other only in a group that has no other fp. No pair is left out but
    those that compared pairs, or the components `known` before, have joined already; these are among the links.
    """
    keys = fp.astype(np.int64).view(np.uint64)
    order = np.lexsort((keys, group))
    group, keys, rep = group[order], keys[order], rep[order]
    nodes, first, node = np.unique(rep, return_index=True, return_inverse=True)
    found = _Verified(sketches[order][first].view(np.uint64), limit, np.arange(len(nodes)) if known is None else _first_of(known[order][first]))
    at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (keys[1:] != keys[:-1])))
    size = np.diff(np.append(at, len(keys)))
    starts = np.flatnonzero(np.append(True, group[at][1:] != group[at][:-1]))
    alone = starts[np.diff(np.append(starts, len(at))) == 1]
    i, j = trie_links(keys[at], starts, budget)
    i, j = np.append(i, alone), np.append(j, alone)
    n = size[i] * size[j]
    few = np.flatnonzero(n <= 256)
    ends = np.cumsum(n[few])
    lo = 0
    while lo < len(few):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
        part = few[lo:hi]
        pair = np.repeat(part, n[part])
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        found.try_pairs(node[at[i[pair]] + k // size[j[pair]]], node[at[j[pair]] + k % size[j[pair]]])
        lo = hi
    for k in np.flatnonzero(n > 256):
        found.try_all(node[at[i[k]] : at[i[k]] + size[i[k]]], node[at[j[k]] : at[j[k]] + size[j[k]]])
    child = np.flatnonzero(found.label != np.arange(len(nodes)))
    return nodes[child], nodes[found.label[child]]


def _sketch_groups(batches):
    """Record batches (group, fp, rep, label, sketch), sorted by group, as arrays that hold whole groups."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        cols.append(batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if held and (last or held[-1][0][-1] != cols[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:last] for c in cols], strict=True)]
            held = []
        elif last:
            yield [c[:last] for c in cols]
        held.append([c[last:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2, subtrie_rows: int = SUBTRIE_ROWS) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of docs.

    Equal fingerprints form a class; classes at `budget` or fewer differing bits are linked; component_id is the
    smallest doc_id reachable. Null or empty text has fingerprint 0 and is linked like any other. Rows with a null
    doc_id take part and stay in the result; a component of only such rows has a null component_id. Repeated rows are
    kept, very long texts read whole. An empty table gives an empty result. Other columns of docs are not read.
    """
    table = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = materialize(table.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("rep")), "classes")
    found = connected_components(near_links(classes, budget, subtrie_rows))
    known = materialize(classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "class-components")
    return table.join(known, "fp").select("doc_id", "fp", F.nullif(F.col("component_id"), F.lit(NO_ID)).alias("component_id"))


def shingle_sets(words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document; fewer words than `width` are one shingle, none is none."""
    counts, h = words.counts, words.hashes
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    total = np.zeros(len(h), np.uint64)
    for k in range(width):
        # words that stand k places on in the same document
        ahead = np.zeros(len(h), np.uint64)
        ahead[: max(len(h) - k, 0)] = h[k:]
        ahead[at + k >= counts[doc]] = 0
        total += ahead * np.uint64(2 * k + 0x9E3779B97F4A7C15)
    starts = (at == 0) | (at + width <= counts[doc])
    doc, total = doc[starts], mix(total[starts])
    order = np.lexsort((total, doc))
    doc, total = doc[order], total[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])) if len(doc) else np.empty(0, bool)
    return doc[new], total[new]


def long_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """Rows (doc_id, sketch): SLICES * SLICE_BITS SimHash bits of the set of shingles, as bigints.

    Each distinct shingle stands in SPREAD of BUCKETS sums, with a sign; each bit is the side of a random hyperplane
    that the sums lie on. So the share of differing bits follows the angle between two sets: a similarity of 0.8 is
    about 0.15. No words give zero. Null texts count as empty, null ids and repeated rows stay, texts are read whole, other
    columns are not read; an empty table gives an empty result.
    """

    def run(batches):
        planes = np.random.default_rng(SEED).normal(size=(BUCKETS, SLICES * SLICE_BITS)).astype(np.float32)
        part = BUCKETS // SPREAD
        for batch in batches:
            found = []
            for _, _, words in word_blocks(batch.column(1)):
                doc, h = shingle_sets(words, width)
                n = len(words.counts)
                for lo in range(0, n, 512):  # so many documents' sums at once
                    first, last = np.searchsorted(doc, (lo, min(lo + 512, n)))
                    rows = min(lo + 512, n) - lo
                    d, x = doc[first:last] - lo, h[first:last]
                    sums = np.zeros(rows * BUCKETS)
                    for k in range(SPREAD):
                        y = (x >> np.uint64(16 * k)).astype(np.int64) & 0xFFFF
                        sums += np.bincount(d * BUCKETS + k * part + (y >> 1) % part, 1.0 - 2.0 * (y & 1), rows * BUCKETS)
                    bits = sums.reshape(rows, BUCKETS).astype(np.float32) @ planes > 0
                    found.append(np.packbits(bits, axis=1).view(">i8").astype(np.int64))
            flat = np.concatenate(found) if found else np.empty((0, SLICES * SLICE_BITS // 64), np.int64)
            ends = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))], ["doc_id", "sketch"])
        give_back()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, sketch array<bigint>")


def _weighed(members: DataFrame, weight: Column | int) -> DataFrame:
    return members.withColumn("weight", F.lit(weight).cast("double") if isinstance(weight, int) else weight)


def around_pivots(members: DataFrame, most: float, weight: Column | int = 1) -> DataFrame:
    """members with the groups g of a weight over `most` cut into blocks by hash of rep, for a first round; g is anew.

    Each member is in one block, and some PIVOTS light ones, by hash, in all. So the rows grow with the members, and the
    components of near copies that each block finds hang together by the pivots. Pairs that meet in no block are left to in_blocks.
    """
    weighed = _weighed(members, weight)
    sizes = weighed.groupBy("g").agg(F.ceil(F.sum("weight") * 2 / most).cast("int").alias("blocks"), F.count("*").alias("n"))
    pivot = (F.pmod(F.xxhash64("rep", F.lit("pivot")), F.col("n")) < PIVOTS) & (F.col("weight") <= most / (2 * PIVOTS))
    places = F.when(F.col("blocks") <= 2, F.array(F.lit(-1))).when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1))
    places = places.otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    dealt = weighed.join(sizes, "g").withColumn("block", F.explode(places))
    return dealt.withColumn("g", F.when(F.col("block") < 0, F.col("g")).otherwise(F.xxhash64("g", "block"))).select(members.columns)


def in_blocks(members: DataFrame, most: float, weight: Column | int = 1) -> DataFrame:
    """members with the groups g of a weight over `most` cut into blocks, so that each two members of other labels still meet.

    Groups of one label are left out. If all but the heaviest label weigh half of `most` at the most, they go to
    each block of that label. Else all members are dealt to blocks by hash of rep and go to the groups of each two blocks. g is anew.
    """
    weighed = _weighed(members, weight)
    labels = weighed.groupBy("g", "label").agg(F.sum("weight").alias("weight"))
    sizes = labels.groupBy("g").agg(F.count("*").alias("labels"), F.sum("weight").alias("all"), F.max(F.struct("weight", "label")).alias("main")).where("labels > 1")
    sizes = sizes.select("g", F.col("main.label").alias("main"), (F.col("all") <= most).alias("whole"), (F.col("all") - F.col("main.weight") <= most / 2).alias("few"), F.col("all"), F.col("main.weight").alias("of_main"))
    sizes = sizes.withColumn("blocks", F.ceil(F.when(F.col("few"), F.col("of_main")).otherwise(F.col("all")) * 2 / most).cast("int")).drop("all", "of_main")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    other = F.when(F.col("whole"), F.array(F.lit(-1))).when(~F.col("few"), F.filter(every, lambda x: x != own))
    other = other.when(F.col("label") == F.col("main"), F.array(own)).otherwise(every)
    dealt = weighed.join(sizes, "g").withColumn("other", F.explode(other))
    g = F.when(F.col("whole"), F.col("g")).when(F.col("few"), F.xxhash64("g", "other")).otherwise(F.xxhash64("g", F.least(own, "other"), F.greatest(own, "other")))
    return dealt.withColumn("g", g).select(members.columns)


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with their component in `found` (node, component) as `label`, rep where there is none."""
    return rows.join(found, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep")).drop("node", "component")


def similar_sets(doc: np.ndarray, shingle: np.ndarray, n: int, sketches: np.ndarray, limit: int, similarity: float, known: np.ndarray | None = None) -> np.ndarray:
    """Label of each of n documents: joined are those with a shingle similarity (Jaccard) of at least `similarity`.

    doc, shingle: the distinct shingles of each document, ascending. Only pairs whose sketches differ in `limit` bits or
    fewer are compared, and no two that compared pairs, or the components `known` before, have joined already. A label
    is a document of its component.
    """
    ends = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(ends)
    label = np.arange(n) if known is None else _first_of(known)
    sketches = sketches.view(np.uint64)
    for i in range(n - 1):
        later = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        later = later[np.bitwise_count(sketches[later] ^ sketches[i]).sum(axis=1, dtype=np.int64) <= limit]
        own = shingle[ends[i] : ends[i + 1]]
        later = later[(size[later] > 0) & (np.minimum(size[later], len(own)) >= similarity * np.maximum(size[later], len(own)))]
        if not len(later) or not len(own):
            continue
        at = np.concatenate([np.arange(ends[j], ends[j + 1]) for j in later])
        theirs = shingle[at]
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[later]) - size[later])
        for j in later[both >= similarity * (len(own) + size[later] - both) - 1e-9]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
    return label


def similar_rows(numbered: DataFrame, row: str, text_col: str, width: int = 5, similarity: float = 0.8, differing: float = 0.181, budget: int = 2, subtrie_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows (row, component): the rows of `numbered`, a written table whose bigint column `row` is unique, with the smallest row that near copies lead to.

    A similarity of 0.8 moves a seventh of the bits of a SimHash, far beyond what one 64-bit trie can be searched for,
    so the fingerprint is long and each slice of it has a trie of its own: a pair is a candidate if some slice of
    SLICE_BITS differs in `budget` bits or fewer and the whole in a share `differing` or less, which 95 of 100 pairs at
    0.8 meet. Rows of equal slices are compared first; near slices are then taken only where these left components apart,
    so that a large group of near copies has no row for each slice and subtrie. Candidates form components; the texts of
    a component then meet in one task, where pairs within `differing` are linked if their sets of shingles are as similar
    as asked. Components over GROUP_ROWS rows or GROUP_CHARS characters are compared in blocks first, then by the groups
    of slices whose members are still apart, and these in blocks, so no group is gathered whole and no candidate pair
    lost. Rows of equal fingerprints are copies: they are compared by one of them.
    """
    limit = int(differing * SLICES * SLICE_BITS)
    held = Scratch(numbered.sparkSession)
    table = held.write(long_fingerprints(numbered, row, text_col, width), "long-fingerprints")
    classes = held.write(table.groupBy("sketch").agg(F.min("doc_id").alias("rep")), "sketches")
    halves = F.flatten(F.transform("sketch", lambda x: F.array(F.shiftrightunsigned(x, SLICE_BITS), x.bitwiseAND(F.lit((1 << SLICE_BITS) - 1)))))

    def slices(labelled: DataFrame) -> DataFrame:
        at = labelled.select("rep", "label", F.posexplode(halves).alias("slice", "bits"))
        return at.select("rep", "label", F.shiftleft(F.col("slice").cast("bigint"), SLICE_BITS).bitwiseOR(F.col("bits")).alias("fp"))

    def equal_slices(labelled: DataFrame) -> DataFrame:
        found = slices(labelled).groupBy("fp").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        return found.where("low < high").select(F.xxhash64(F.lit("equal"), "fp").alias("g"), "fp")

    def near_slices(labelled: DataFrame) -> DataFrame:
        found = held.write(slices(labelled).groupBy("fp").agg(F.min("label").alias("low"), F.max("label").alias("high")), "slices")
        return near_groups(found, budget, subtrie_rows, tuple(range(BITS - SLICE_BITS, BITS)))

    def members(groups: DataFrame, labelled: DataFrame, name: str) -> DataFrame:
        return held.write(held.write(groups, f"{name}-slices").join(slices(labelled), "fp").select("g", "fp", "rep", "label"), f"{name}-members")

    def join(batches):
        for group, fp, rep, label, sketches in _sketch_groups(batches):
            a, b = verified_links(group, fp, rep, sketches, budget, limit, label)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        give_back()

    def by_sketch(dealt: DataFrame) -> DataFrame:
        dealt = dealt.join(classes, "rep").select("g", "fp", "rep", "label", "sketch")
        return held.write(dealt.repartition("g").sortWithinPartitions("g").mapInArrow(join, "a bigint, b bigint"), "sketch-links")

    def alike(met: DataFrame) -> DataFrame:
        """Links of the groups of met; those too large for one task in two rounds."""
        large = held.write(met.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > SKETCH_ROWS).select("g"), "large-groups")
        if large.isEmpty():
            return by_sketch(met)
        links = by_sketch(around_pivots(met, SKETCH_ROWS))
        apart = _labelled(met.join(large, "g", "left_semi").drop("label"), connected_components(links.union(met.select("rep", "label"))))
        return links.union(by_sketch(in_blocks(held.write(apart, "apart"), SKETCH_ROWS)))

    apart = classes.withColumn("label", F.col("rep"))
    links = alike(members(equal_slices(apart), apart, "equal"))
    apart = held.write(_labelled(classes, connected_components(links)), "equal-labels")
    links = links.union(alike(members(near_slices(apart), apart, "near")))

    chars = numbered.select(F.col(row).alias("rep"), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"))
    nodes = held.write(connected_components(links).select(F.col("node").alias("rep"), "component").join(chars, "rep"), "alike")
    sizes = nodes.groupBy("component").agg(F.count("*").alias("n"), F.sum("chars").alias("all_chars"))
    sized = held.write(nodes.join(sizes, "component").withColumn("large", (F.col("n") > GROUP_ROWS) | (F.col("all_chars") > GROUP_CHARS)), "alike-sized")
    share = F.lit(1.0 / GROUP_ROWS) + F.col("chars") / F.lit(float(GROUP_CHARS))
    grouped = sized.select(F.xxhash64(F.lit("component"), "component").alias("g"), "rep", F.col("rep").alias("label"), "chars", "large")
    large = grouped.where("large").drop("large")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        text, rep = group["text"].combine_chunks(), group["rep"].to_numpy()
        sketches = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group["sketch"].chunks]).reshape(len(rep), -1)
        docs, shingles = [], []
        for first, _, words in word_blocks(text):
            d, h = shingle_sets(words, width)
            docs.append(d + first)
            shingles.append(h)
        label = similar_sets(np.concatenate(docs), np.concatenate(shingles), len(rep), sketches, limit, similarity, group["label"].to_numpy())
        child = np.flatnonzero(label != np.arange(len(rep)))
        return pa.table({"a": pa.array(rep[child], pa.int64()), "b": pa.array(rep[label[child]], pa.int64())})

    def by_text(tasks: DataFrame) -> DataFrame:
        wanted = tasks.join(classes, "rep").join(numbered.select(F.col(row).alias("rep"), F.col(text_col).cast("string").alias("text")), "rep")
        return held.write(wanted.select("g", "rep", "label", "sketch", "text").groupBy("g").applyInArrow(compare, "a bigint, b bigint"), "links")

    if large.isEmpty():
        links = by_text(grouped.select("g", "rep", "label"))
    else:
        first = around_pivots(large, 1, share).select("g", "rep", "label")
        links = by_text(grouped.where("not large").select("g", "rep", "label").union(first))
        apart = held.write(_labelled(large.drop("g", "label"), connected_components(links)).join(classes, "rep"), "large-labels")
        met = members(equal_slices(apart).union(near_slices(apart)), apart, "large").select("g", "rep", "label").distinct()
        links = links.union(by_text(in_blocks(met.join(apart.select("rep", "chars"), "rep"), 1, share).select("g", "rep", "label")))
    known = _labelled(classes, connected_components(links)).select("sketch", F.col("label").alias("component"))
    out = materialize(table.join(known, "sketch").select(F.col("doc_id").alias("row"), "component"), "similar-rows")
    held.drop()
    return out


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    row = fresh("_row", docs)
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, subtrie_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows (doc_id, component_id), one for each row of docs: near copies at a shingle similarity of 0.8 or more, see similar_rows.

    component_id is the smallest doc_id that links lead to. Rows are compared each by itself, also where ids repeat; rows
    with a null id take part, and a component of only such rows has a null component_id. Null and empty texts, and texts
    without words, are copies of each other; a text of fewer words than `width` is one shingle. An empty table gives an
    empty result. Other columns are not read.
    """
    numbered, row = _numbered(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")))
    found = similar_rows(numbered, row, "text", width, similarity, subtrie_rows=subtrie_rows)
    named = materialize(numbered.select(row, "doc_id").join(found, F.col(row) == F.col("row")).select("doc_id", "component"), "named")
    return named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component of similar_rows, all columns kept, whatever their names.

    The row with the smallest doc_id stays, null ids last; among rows that share it, the one whose text has the smallest
    hash. Rows that share an id but no text are different documents. Nulls, empty texts and tables as in similar_components.
    """
    numbered, row = _numbered(docs)
    ids = numbered.select(F.col(row).alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("hash"))
    found = similar_rows(numbered.select(F.col(row).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")), "row", "text", width, similarity)
    best = ids.join(found, "row").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "hash", "row")).alias("best"))
    kept = fresh("_kept", numbered)
    return numbered.join(best.select(F.col("best.row").alias(kept)), F.col(row) == F.col(kept), "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
