"""A store of keyed rows that polls merge into without rescanning it: hashed buckets, and a Bloom filter and time span for each file.

Layout: rows/poll=<n> and merged/<level> hold files by bucket, index/<name> one entry for each of their files and filter
segment. A poll counts once its index is there, so one that died half-way leaves nothing that is read, and running it again
replaces what it wrote. An updated row is a newer version of its key; readers take the newest.
"""

from __future__ import annotations

import math
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter segment (those of a bitmap), filter bits for each key, and hash functions: about 1 % of absent keys are taken for present.
SEGMENT_BITS, KEY_BITS, HASHES = 32768, 10, 4
_INDEX = "file string, bucket int, segments int, segment int, lo bigint, hi bigint, keys bigint, bits binary, level int, replaces array<string>"


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class PollStore:
    """Rows by `key` (no nulls in it) with an instant `time`, one of a key's columns; `content` are the columns whose change makes a new version.

    A poll hashes its rows to buckets and reads, of the files of those buckets, only those whose time span and Bloom
    filter admit one of its keys. A bucket's files are merged, `fan` of a level into one of the next, so that their number
    grows with the logarithm of the store, and superseded versions go.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], time: str, content: list[str], buckets: int = 8, fan: int = 8):
        self.spark, self.path, self.key, self.time, self.content, self.buckets, self.fan = spark, path.rstrip("/"), key, time, content, buckets, fan

    def _there(self, name: str) -> bool:
        place, system = _place(self.spark, f"{self.path}/{name}")
        return system.exists(place)

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(_INDEX).option("recursiveFileLookup", "true").parquet(f"{self.path}/index")

    def index(self) -> DataFrame:
        """Entries of the files that count: those that no merge has replaced."""
        if not self._there("index"):
            return self.spark.createDataFrame([], _INDEX)
        every = self._entries()
        gone = every.select(F.explode("replaces").alias("file")).distinct()
        return every.where("file is not null").join(gone, "file", "left_anti")

    def files(self, index: DataFrame | None = None) -> list[str]:
        """Paths only: their number is that of buckets times the logarithm of the polls."""
        return [r[0] for r in (self.index() if index is None else index).select("file").distinct().collect()]

    def _hash(self) -> Column:
        return F.xxhash64(*[F.col(k) for k in self.key])

    def _instant(self, rows: DataFrame) -> Column:
        return F.col(self.time).cast("bigint") if dict(rows.dtypes)[self.time] in ("bigint", "int") else F.unix_micros(F.col(self.time).cast("timestamp"))

    def _bits(self, h: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(h, F.lit(k)), F.lit(SEGMENT_BITS)).cast("int") for k in range(HASHES)]

    def candidates(self, rows: DataFrame) -> list[str]:
        """Files that may hold a key of rows (with `_bucket` and `_h`)."""
        asked = rows.select("_bucket", "_h", "_t").withColumn("_seg", F.pmod(F.xxhash64("_h", F.lit(-1)), F.lit(1 << 30)))
        held = self.index().withColumnRenamed("bucket", "_bucket")
        both = asked.join(held, "_bucket").where(F.col("_t").between(F.col("lo"), F.col("hi")) & (F.col("_seg") % F.col("segments") == F.col("segment")))
        for bit in self._bits(F.col("_h")):
            byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            both = both.where(F.bit_get(byte, (bit % 8).cast("int")) == 1)
        return self.files(both)

    def _write(self, rows: DataFrame, folder: str, name: str, level: int, replaces: list[str]) -> int:
        """Write rows (with `_bucket`, `_h`, `_t`) as files below folder, then their index under name; number of rows."""
        folder = f"{self.path}/{folder}"
        rows.repartition(self.buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        back = self.spark.read.schema(rows.schema).parquet(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_bucket").alias("bucket"), "_h", "_t")
        n = back.count()
        segments = max(1, math.ceil(n / self.buckets * KEY_BITS / SEGMENT_BITS))
        seg = (F.pmod(F.xxhash64("_h", F.lit(-1)), F.lit(1 << 30)) % segments).cast("int")
        bits = F.explode(F.array(*self._bits(F.col("_h")))).alias("bit")
        spans = back.groupBy("file", "bucket").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.count("*").alias("keys"))
        marks = back.select("file", seg.alias("segment"), bits).groupBy("file", "segment").agg(F.bitmap_construct_agg("bit").alias("bits"))
        entries = spans.join(marks, "file").select("file", "bucket", F.lit(segments).alias("segments"), "segment", "lo", "hi", "keys", "bits", F.lit(level).alias("level"), F.lit(None).cast("array<string>").alias("replaces"))
        mark = self.spark.createDataFrame([(None, None, None, None, None, None, None, None, level, replaces)], _INDEX)
        entries.unionByName(mark).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index/{name}")
        return n

    def _read(self, files: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[unquote(f) for f in files])

    def merge(self, rows: DataFrame, poll: int, newer: Column | None = None) -> dict[str, int]:
        """Insert rows whose key is new, and those whose content differs from the version that stands as its next version.

        Of rows of one key in a poll the greatest by content stands. `newer` tells of a changed row whether it may replace
        what stands, in terms of old.<column> and new.<column>; where it doesn't, the row is a conflict and stays out. Returns the
        counts, the files that count and how many of them were opened.
        """
        name = f"poll-{poll:012d}"
        if self._there(f"index/{name}"):  # it counted already: run again, it gives the same
            place, system = _place(self.spark, f"{self.path}/index/{name}")
            system.delete(place, True)
        other = [c for c in rows.columns if c not in self.key]
        one = rows.groupBy(*self.key).agg(F.max(F.struct(*self.content, *[c for c in other if c not in self.content])).alias("_r")).select(*self.key, *[F.col("_r")[c].alias(c) for c in other])
        new = one.withColumns({"_h": self._hash(), "_bucket": F.pmod(self._hash(), F.lit(self.buckets)).cast("int"), "_poll": F.lit(poll).cast("bigint"), "_t": self._instant(one)}).persist()
        files = self.candidates(new)
        live = len(self.files())
        outcome, full = F.lit("INSERTED"), new
        if files:
            old = self.newest(self._read(files, new.schema).join(new.select(*self.key), self.key, "left_semi"))
            sign = lambda t: F.struct(*[F.col(f"{t}.{c}") for c in self.content])
            full = new.alias("new").join(old.alias("old"), [F.col(f"new.{k}") == F.col(f"old.{k}") for k in self.key], "left")
            outcome = F.when(F.col("old._h").isNull(), "INSERTED").when(sign("new").eqNullSafe(sign("old")), "UNCHANGED").when(newer if newer is not None else F.lit(True), "UPDATED").otherwise("CONFLICT")
            full = full.select("new.*", outcome.alias("_outcome")).persist()
        else:
            full = new.withColumn("_outcome", outcome)
        counts = {r["_outcome"]: r["count"] for r in full.groupBy("_outcome").count().collect()}
        if counts.get("INSERTED", 0) + counts.get("UPDATED", 0):
            self._write(full.where("_outcome in ('INSERTED', 'UPDATED')").drop("_outcome"), f"rows/poll={poll}", name, 0, [])
        full.unpersist()
        new.unpersist()
        return {k.lower(): counts.get(k, 0) for k in ("INSERTED", "UPDATED", "UNCHANGED", "CONFLICT")} | {"files": live, "opened": len(files)}

    def newest(self, rows: DataFrame) -> DataFrame:
        """The newest version of each key."""
        other = [c for c in rows.columns if c not in (*self.key, "_poll")]
        best = rows.groupBy(*self.key).agg(F.max(F.struct("_poll", *other)).alias("_r"))
        return best.select(*self.key, *[F.col("_r")[c].alias(c) for c in ("_poll", *other)])

    def read(self, schema) -> DataFrame:
        """The rows that stand; schema: that of the rows merged."""
        hidden = {"_h": F.lit(0).cast("bigint"), "_bucket": F.lit(0), "_poll": F.lit(0).cast("bigint"), "_t": F.lit(0).cast("bigint")}
        inner = self.spark.createDataFrame([], schema).withColumns(hidden).schema
        files = self.files()
        rows = self._read(files, inner) if files else self.spark.createDataFrame([], inner)
        return self.newest(rows).select(*[f.name for f in self.spark.createDataFrame([], schema).schema])

    def compact(self) -> int:
        """Merge the files of buckets that have `fan` of a level into one of the next; number of files that were replaced.

        Replaced files stay on disk until vacuum(), so that readers that know them finish.
        """
        full = self.index().select("bucket", "level", "file").distinct().groupBy("bucket", "level").agg(F.collect_set("file").alias("files")).where(F.size("files") >= self.fan)
        found = [(r["level"], r["files"]) for r in full.collect()]
        done = 0
        for level in sorted({x for x, _ in found}):
            files = sorted(f for x, fs in found if x == level for f in fs)
            schema = self.spark.read.parquet(unquote(files[0])).schema
            rows = self.newest(self._read(files, schema)).withColumn("_bucket", F.pmod(F.col("_h"), F.lit(self.buckets)).cast("int"))
            last = rows.agg(F.max("_poll")).first()[0]
            name = f"level-{level + 1:03d}-{last:012d}"
            self._write(rows, f"merged/{name}", name, level + 1, files)
            done += len(files)
        return done

    def vacuum(self) -> int:
        """Delete files that a merge has replaced; number of them."""
        if not self._there("index"):
            return 0
        gone = [r[0] for r in self._entries().select(F.explode("replaces")).distinct().collect()]
        for f in gone:
            place, system = _place(self.spark, unquote(f))
            system.delete(place, False)
        return len(gone)
