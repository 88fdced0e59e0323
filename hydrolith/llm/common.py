"""Helpers that the operators of this subpackage share: shared-folder tables, Arrow text buffers, hashed words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest id, stands for "no id" inside minimum computations.
NO_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="hydrolith-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Tables written to the shared folder. Those still there go when the JVM ends; drop() deletes them sooner."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Cut the lineage: write df as Parquet and read it again."""
        path = f"{shared_dir(self.spark)}/hydrolith/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        place, system = _place(self.spark, path)
        system.deleteOnExit(place)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the tables, which nothing may read any more."""
        for path in self.paths:
            place, system = _place(self.spark, path)
            system.delete(place, True)
        self.paths = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again. The files go when the JVM ends."""
    return Scratch(df.sparkSession).write(df, name)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has: `name`, with underscores after it as needed. Case is ignored, as Spark does."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text (remainder 0)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0)) % modulus


def labelled_sample(labels: DataFrame, label_col: str, id_col: str, most: int) -> DataFrame:
    """(doc_id, label) of at most `most` documents outside the held-out fifth, picked by hash of the id.

    Null labels, and documents whose rows disagree, are left out.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(F.col(id_col), 5) != 0))
    one = one.groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("most")).where("label = most")
    return materialize(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("label").cast("int").alias("label")), "labelled")


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, label, text) of the documents of a labelled sample, one for each id: its smallest text, null as empty."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


# --- Arrow text columns as byte buffers ---------------------------------------------------------------------------

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are handled at once; larger texts are cut at white space.
BLOCK_BYTES = 1 << 20


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. Memory that earlier batches freed goes back first."""
    pa.default_memory_pool().release_unused()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def give_back() -> None:
    """Return the memory that a task's batches freed to the machine: a Python worker is kept for the next task and counts meanwhile."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def doc_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """(first, last) ranges of documents of about `limit` bytes together, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.multiply.accumulate(np.full(4096, _BASE, np.uint64))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.full(max(n, 2 * len(_powers)), _BASE, np.uint64))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of some whole documents: per document the number, per word a 64-bit hash, its tail, and the hash of its stem.

    A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. `tails` packs the last three
    bytes; `stems`, if asked for, hashes the first `STEM` bytes.
    """

    STEM = 5

    def __init__(self, data: np.ndarray, cuts: np.ndarray, stems: bool = False):
        """data: bytes of consecutive documents, document i at cuts[i]:cuts[i + 1]."""
        self.stems = np.empty(0, np.uint64)
        if len(data) > 8 * BLOCK_BYTES and len(cuts) == 2:
            parts = [Words(data[a:b], np.array([0, b - a]), stems) for a, b in _segments(data)]
            self.counts = np.array([sum(int(p.counts[0]) for p in parts)])
            self.hashes, self.stems, self.tails = (np.concatenate([getattr(p, k) for p in parts]) for k in ("hashes", "stems", "tails"))
            return
        word = ~SPACE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = cuts[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = word[inner]
        where = np.flatnonzero(word)
        starts_at = np.flatnonzero(begins)
        self.counts = np.diff(np.searchsorted(starts_at, cuts))
        if not len(where):
            self.hashes = np.empty(0, np.uint64)
            self.tails = np.empty(0, np.int64)
            return
        low = LOWER[data[where]]
        first = np.searchsorted(where, starts_at)
        lens = np.diff(np.append(first, len(where)))
        k = np.arange(len(where)) - np.repeat(first, lens)
        values = _BYTE[low] * _power_table(int(lens.max()))[k]
        self.hashes = mix(np.add.reduceat(values, first) + lens.astype(np.uint64))
        if stems:
            values[k >= self.STEM] = 0
            self.stems = mix(np.add.reduceat(values, first) + np.uint64(0x5EED))
        last = first + lens - 1
        tail = low[last].astype(np.int64)
        for back in (1, 2):
            tail = tail * 256 + np.where(lens > back, low[np.maximum(last - back, 0)], 0)
        self.tails = tail


def _segments(data: np.ndarray):
    """Cut a very long text at white space into segments of about BLOCK_BYTES; a longer word stays whole."""
    gaps = np.flatnonzero(SPACE[data])
    a = 0
    while a < len(data):
        at = np.searchsorted(gaps, a + BLOCK_BYTES)
        b = int(gaps[at]) if at < len(gaps) else len(data)
        yield a, b
        a = b + 1 if b < len(data) else b


def word_blocks(column: pa.Array, stems: bool = False):
    """(first, last, Words) for each block of documents of a string column."""
    data, offsets = text_buffers(column)
    for i, j in doc_blocks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        yield i, j, Words(data[lo:hi], np.asarray(offsets[i : j + 1] - lo), stems)
