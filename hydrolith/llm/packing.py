"""Best-fit packing of documents into token sequences, certified by dual-feasible lower bounds."""

from __future__ import annotations

import logging
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import doc_blocks, materialize, text_buffers

#: Documents that one task packs at once, about.
GROUP_ITEMS = 4096
LOG = logging.getLogger(__name__)
#: Fewest groups of the first round, so that small inputs use the cluster too.
LEAST_GROUPS = 16
#: Most texts between spaces that a worker remembers the ids of, and the longest of them, in characters: some 250 bytes
#: each, 400 at most. A worker outlives its stage, and so does what it remembers.
REMEMBERED, REMEMBERED_CHARS = 700_000, 48


class PieceEncoder:
    """Token ids of whole texts as little-endian uint32 bytes, as the tokenizers library gives them.

    Byte-level BPE with the usual word pattern never joins bytes across a space that stands between two other visible
    characters, so texts are cut there and equal parts are encoded once. A part that is a space and letters is one match
    of the pattern, one of .,;:!? behind it another, and so are one line break and letters behind that: these go straight
    to the library's BPE model. Which characters are letters is asked of the library itself. All other parts are left to the library as they are.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import re

        from tokenizers import Tokenizer

        self.remembered = remembered
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # white space by any definition: texts that hold a cut beside it are split by the slower pattern
        blank = r"\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff"
        self.cut = re.compile(f"(?<=[^{blank}]) (?=[^{blank}])")
        self.uneven = re.compile(f"^ |[{blank}] | [{blank}]| $")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        simple = self.whole.normalizer is None and all(t.content == "<|endoftext|>" for t in self.whole.get_added_tokens_decoder().values())
        letters = self._letters() if simple else ""
        self.plain = re.compile(f"([{letters}]+)([.,;:!?]?)(?:(\n[{letters}]+)([.,;:!?]?))?" if letters else "(?!)()()()")
        # ids of parts by the text after their space, or with the line break before them: those met lately, and before
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = {m: self._ids(m) for m in ".,;:!?"} if letters else {}

    def _letters(self) -> str:
        """A character class of all characters below U+10000 that the library's pattern joins with letters on both sides."""
        import re

        found: list[list[int]] = []
        points = [c for c in range(65, 0x10000) if not 0xD800 <= c < 0xE000]
        for k in range(0, len(points), 8192):
            some = points[k : k + 8192]
            text = "".join(f" a{chr(c)}a" for c in some)
            pieces = {piece[1] for piece in self.whole.pre_tokenizer.pre_tokenize_str(text)}
            for i, c in enumerate(some):
                if (4 * i, 4 * i + 4) in pieces:
                    if found and found[-1][1] == c - 1:
                        found[-1][1] = c
                    else:
                        found.append([c, c])
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in found)

    def _ids(self, match: str) -> bytes:
        shown = match.encode().decode("latin1").translate(self.byte_chars)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _whole(self, part: str) -> bytes:
        return array("I", self.whole.encode(part, add_special_tokens=False).ids).tobytes()

    def _letters_ids(self, word: str) -> bytes:
        """Ids of letters after a space, or after a line break that stands before them."""
        ids = self.parts.get(word) or self.older.get(word)
        if ids is None:
            ids = self._ids("\n") + self._ids(word[1:]) if word[0] == "\n" else self._ids(" " + word)
            if len(word) <= REMEMBERED_CHARS:
                self.parts[word] = ids
        return ids

    def _part(self, rest: str) -> bytes:
        """Ids of a space and `rest`, which is not remembered."""
        if self.marks and rest.isascii() and rest.isalpha():
            return array("I", [t.id for t in self.model.tokenize("\u0120" + rest)]).tobytes()
        plain = self.plain.fullmatch(rest)
        if plain is None:
            return self._whole(" " + rest)
        word, mark, second, end = plain.groups()
        ids = self._letters_ids(word)
        if mark:
            ids += self.marks[mark]
        if second:
            ids += self._letters_ids(second)
            if end:
                ids += self.marks[end]
        return ids

    def encode(self, text: str) -> bytes:
        if 2 * len(self.parts) > self.remembered:
            self.parts, self.older = {}, self.parts
        first, *rest = self.cut.split(text) if self.uneven.search(text) else text.split(" ")
        parts, older = self.parts, self.older
        known = list(map(parts.get, rest))
        if None in known:
            for k, ids in enumerate(known):
                if ids is None:
                    part = rest[k]
                    ids = known[k] = older.get(part) or parts.get(part) or self._part(part)
                    if len(part) <= REMEMBERED_CHARS:
                        parts[part] = ids
        return self._whole(first) + b"".join(known)


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def _encoder(path: str, remembered: int) -> PieceEncoder:
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = PieceEncoder(path, remembered)
    return _encoders[path, remembered]


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and then end_id, cut if over the capacity.

    A longer document is cut into pieces of exactly `capacity` ids, but for the first, which takes what is left over.
    Null text counts as empty: one piece that holds end_id alone. Null ids and repeated rows stay documents each, other columns
    are not read; an empty table gives an empty result.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = _encoder(tokenizer_path, remembered)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            view, names = memoryview(data), batch.column(0).to_pylist()
            for i, j in doc_blocks(offsets):
                out: list[tuple] = []
                for k in range(i, j):
                    ids = memoryview(encoder.encode(str(view[offsets[k] : offsets[k + 1]], "utf-8", "replace")) + end)
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    out += [(names[k], p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECE)


def bin_lower_bound(sizes: np.ndarray, capacity: int, steps: int = 24) -> int:
    """Fewest bins that `sizes` can need, by two families of dual feasible functions (Fekete and Schepers 2001).

    A dual feasible function maps sizes so that whatever fits one bin still does, hence the mapped total over the
    capacity, rounded up, bounds the number of bins from below. The first family rounds (k + 1) x / capacity down and
    divides by k, except where it is whole; the second, for a threshold t, fills up sizes over capacity - t and drops
    those below t.
    """
    if not len(sizes):
        return 0
    x, n = np.unique(np.asarray(sizes, np.int64), return_counts=True)
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, steps + 1):
        whole = (k + 1) * x % capacity == 0
        total = int((np.where(whole, k * x, (k + 1) * x // capacity * capacity) * n).sum())
        best = max(best, -(-total // (capacity * k)))
    for t in x[x <= capacity // 2]:
        total = int((np.where(x > capacity - t, capacity, np.where(x < t, 0, x)) * n).sum())
        best = max(best, -(-total // capacity))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each size and the gap of each bin: each size, largest first, goes to the fullest bin it fits."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    open_gaps = 0  # bit g: some bin has the gap g
    for k in order.tolist():
        size = int(sizes[k])
        fits = open_gaps >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps ^= 1 << gap
        else:
            b, gap = len(gaps), capacity
            gaps.append(capacity)
        bins[k], offsets[k] = b, capacity - gap
        gaps[b] = gap - size
        if gap > size:
            by_gap[gap - size].append(b)
            open_gaps |= 1 << (gap - size)
    return bins, offsets, np.array(gaps, np.int64)


def _pack_group(capacity: int, round_no: int, slack: int):
    """Pack one group. Rows of bins that are closed get a sequence_id; those that go to the exchange get none.

    A group whose bin count equals its lower bound is certified: no other packing of the same documents is better, so
    only its bins with a gap over `slack` can gain, by documents of other groups. In other groups all bins with any gap
    go to the exchange.
    """

    def run(table: pa.Table) -> pa.Table:
        sizes = table["length"].to_numpy()
        group = int(table["g"][0].as_py())
        bins, offsets, gaps = best_fit_decreasing(sizes, capacity)
        bound = bin_lower_bound(sizes, capacity)
        swap = gaps > (slack if len(gaps) == bound else 0) if round_no >= 0 else np.zeros(len(gaps), bool)
        sequence = (np.int64(abs(round_no + 1) + 1) << np.int64(56)) + (np.int64(group) << np.int64(24)) + bins
        moves = swap[bins]
        lead = np.zeros(len(sizes), np.int64)
        if len(sizes):
            lead[0] = bound
        bin_count = np.zeros(len(sizes), np.int64)
        if len(sizes):
            bin_count[0] = len(gaps)
        for name, values, mask in (("sequence_id", sequence, moves), ("offset", offsets, moves), ("bound", lead, None), ("bins", bin_count, None)):
            table = table.append_column(name, pa.array(values, pa.int64(), mask=mask))
        return table.drop_columns(["g"])

    return run


def pack(pieces: DataFrame, capacity: int = 2048, rounds: int = 3, group_items: int = GROUP_ITEMS, slack: int | None = None, report: list[dict[str, int]] | None = None) -> DataFrame:
    """pieces with (sequence_id, offset): each piece's sequence of at most `capacity` tokens and its place there.

    pieces: (doc_id, piece, start, length, ids_crc32), length from 1 to capacity. Full pieces are sequences of their
    own. The others are dealt by hash to groups of about `group_items`; each group is packed by best-fit decreasing and
    its bin count held against its dual-feasible lower bound. What lies in bins with gaps is exchanged: dealt anew to
    groups of the same size and packed again, for at most `rounds` rounds, the last of which closes all bins. An empty
    table gives an empty result; equal rows are packed one by one.

    Each round's sums over its groups are logged and appended to `report`: groups, certified (bins equal to the bound),
    bins, bound, and closed (bins that are final). A last entry has all sequences and the least that the total length needs.
    """
    report = [] if report is None else report
    slack = capacity // 64 if slack is None else slack
    keyed = materialize(pieces.select("*", F.monotonically_increasing_id().alias("item")), "pieces")
    done = [keyed.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("item") + (1 << 61)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    rest = keyed.where(F.col("length") < capacity)
    total, sequences = keyed.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count_if(F.col("length") == capacity)).first()
    for k in range(rounds):
        n = rest.count()
        if not n:
            break
        groups = max(-(-n // group_items), LEAST_GROUPS if k == 0 else 1)
        last = k == rounds - 1 or groups == 1
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("item", F.lit(k)), F.lit(groups)))
        schema = ", ".join(f"{c} {t}" for c, t in rest.dtypes) + ", sequence_id bigint, offset bigint, bound bigint, bins bigint"
        packed = dealt.groupBy("g").applyInArrow(_pack_group(capacity, -k - 2 if last else k, slack), schema)
        packed = materialize(packed, f"packed-{k}")
        sums = packed.where("bins > 0 or offset = 0").agg(F.count_if(F.expr("bins > 0")).alias("groups"), F.count_if(F.expr("bins > 0 and bins = bound")).alias("certified"), F.sum("bins").alias("bins"), F.sum("bound").alias("bound"), F.count_if(F.expr("offset = 0")).alias("closed")).first().asDict()
        LOG.info("packing round %d: %s", k, sums)
        report.append(sums)
        sequences += sums["closed"]
        done.append(packed.where("sequence_id is not null").select(done[0].columns))
        if last:
            break
        rest = packed.where("sequence_id is null").select(keyed.columns)
    report.append({"sequences": sequences, "least": -(-total // capacity)})
    LOG.info("packing: %s", report[-1])
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """All documents, tokenised, cut and packed: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null text counts as empty and gives a piece of one token. Null ids and repeated rows are packed like others. Very
    long texts give many full pieces. An empty table gives an empty result. Other columns of docs are not read.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, remembered), capacity)
