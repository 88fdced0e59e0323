"""Token counts with public tokenizers: Arrow batches in, lengths only out."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import doc_blocks, text_buffers

#: Most distinct words whose counts a worker remembers, and the longest that it remembers, in characters: some 60 MB at most.
CACHE_WORDS, CACHED_CHARS = 400_000, 32


class PieceCounter:
    """Number of tokens of whole texts under a sentencepiece model, or a tokenizers file.

    A sentencepiece model whose pieces never hold the word mark after another character can't join characters across
    a single space between two other characters, so a text is cut there, equal words are encoded once, and the counts
    are added. Other models, and texts that hold the mark itself, are encoded whole.
    """

    MARK = "\u2581"

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
            self.cut = re.compile("(?<=[^ ]) (?=[^ ])") if self._additive(pieces) else None
        else:
            from tokenizers import Tokenizer

            self.model, self.cut = Tokenizer.from_file(path), None

    def _additive(self, pieces: list[str]) -> bool:
        inside = any(self.MARK in p.lstrip(self.MARK) for p in pieces)
        same = lambda t: len(self.model.encode(t)) == sum(len(self.model.encode(w)) for w in t.split(" "))
        return not inside and same("a b") and len(self.model.encode("a  b")) != len(self.model.encode("a b"))

    def encode_lengths(self, texts: list[str]) -> list[int]:
        if hasattr(self.model, "encode_batch"):
            return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        if self.cut is None:
            return self.encode_lengths(texts)
        known, split = self.known, self.cut.split
        if len(known) > CACHE_WORDS:
            known.clear()
        cut = [[t] if self.MARK in t or not t else split(t) for t in texts]
        new = list({w for words in cut for w in words if w not in known})
        lengths = dict(zip(new, self.encode_lengths(new), strict=True))
        known.update((w, n) for w, n in lengths.items() if len(w) <= CACHED_CHARS)
        long = {w: n for w, n in lengths.items() if len(w) > CACHED_CHARS}
        if not long:
            return [sum(map(known.__getitem__, words)) for words in cut]
        return [sum(known[w] if w in known else long[w] for w in words) for words in cut]


_counters: dict[str, PieceCounter] = {}


def _counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of docs.

    n_tokens is what the tokenizer's own library gives for the whole text without added tokens. Null and empty texts
    have no bytes and no tokens; null ids and repeated rows stay, an empty table gives an empty result, other columns are not
    read. tokenizer_path must exist on every executor. Texts
    are encoded in groups of about 1 MB whatever their number, so a batch of long texts needs no more memory.
    """

    def run(batches):
        counter = _counter(tokenizer_path)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            view, lengths = memoryview(data), []
            for i, j in doc_blocks(offsets):
                lengths += counter.counts([str(view[a:b], "utf-8", "replace") for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(lengths, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
