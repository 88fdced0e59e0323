"""Artifacts published whole or not at all, under the digest of their content, and verified when they are read."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolith.sources.digests import content_digest

#: File that holds an artifact's digest and metadata; Spark's readers pass over it.
CARD = "_artifact.json"


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _hadoop(spark, path)
    return system.exists(place)


def read_card(spark: SparkSession, path: str) -> dict:
    """Digest and metadata of an artifact; a ValueError where there is none."""
    if not exists(spark, f"{path}/{CARD}"):
        raise ValueError(f"{path} is no published artifact: {CARD} is missing")
    return json.loads(_text(spark, f"{path}/{CARD}"))


def _text(spark: SparkSession, path: str) -> str:
    place, system = _hadoop(spark, path)
    stream = system.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    place, system = _hadoop(spark, path)
    stream = system.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, write: Callable[[str], None], digest: Callable[[str], str], metadata: dict | None = None) -> tuple[str, bool]:
    """(digest, whether it was written): write(folder) makes an artifact, which appears at path whole, by a rename, or not at all.

    The digest is taken of what was written. Where path is taken, by this or a racing writer, the same content is no change and other
    content a ValueError; nothing is ever replaced. The file system's rename has to be atomic, as that of HDFS or a local disk is.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    draft = f"{parent}/.draft-{name}-{uuid.uuid4().hex}"
    place, system = _hadoop(spark, draft)
    try:
        write(draft)
        found = digest(draft)
        _write_text(spark, f"{draft}/{CARD}", json.dumps({"digest": found, "metadata": metadata or {}}, sort_keys=True, indent=1))
        jvm = spark.sparkContext._jvm
        target, _ = _hadoop(spark, path)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        keep = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(place, target, keep)
            return found, True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass()):
                raise
        if read_card(spark, path)["digest"] != found:
            raise ValueError(f"{path} holds other content")
        return found, False
    finally:
        if system.exists(place):
            system.delete(place, True)


def publish_table(df: DataFrame, path: str, metadata: dict | None = None, partition_by: tuple[str, ...] = ()) -> tuple[str, bool]:
    """Publish a table as Parquet; its digest is the root of its Merkle tree."""
    spark = df.sparkSession
    return publish(spark, path, lambda to: df.write.partitionBy(*partition_by).parquet(to), lambda at: content_digest(spark.read.schema(df.schema).parquet(at)), metadata)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A published table; a ValueError where its content is not what its digest says."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df, card = reader.parquet(path), read_card(spark, path)
    if content_digest(df) != card["digest"]:
        raise ValueError(f"{path} differs from its digest")
    return df


def files_digest(spark: SparkSession, path: str) -> str:
    """Digest of an artifact's files by their names and contents; files of the file system's own (dot files) and the card don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha"))
    place, system = _hadoop(spark, path)
    whole = system.makeQualified(place).toUri().getPath().rstrip("/")
    name = F.substring_index(F.col("path"), whole + "/", -1)
    lines = F.array_sort(F.collect_list(F.concat_ws(":", name, "sha")))
    return files.where(~name.rlike(r"(^|/)[.]") & (name != CARD)).agg(F.sha2(F.array_join(lines, "\n"), 256)).first()[0]


def save_model(model, root: str, metadata: dict | None = None) -> str:
    """Publish a fitted Spark ML model below root under the first 16 digits of its files' digest; the path."""
    spark = SparkSession.getActiveSession()
    draft = f"{root.rstrip('/')}/.model-{uuid.uuid4().hex}"
    model.write().save(draft)
    name = files_digest(spark, draft)[:16]
    path = f"{root.rstrip('/')}/{name}"
    place, system = _hadoop(spark, draft)

    def move(to: str) -> None:
        target, _ = _hadoop(spark, to)
        system.rename(place, target)

    try:
        publish(spark, path, move, lambda at: files_digest(spark, at), metadata)
    finally:
        if system.exists(place):
            system.delete(place, True)
    return path


def load_model(spark: SparkSession, path: str, allowed: tuple[str, ...] = ("org.apache.spark.ml.", "pyspark.ml.")) -> tuple[object, dict]:
    """(model, metadata) of a published model. A file that was changed, added or taken away, or a class from elsewhere, is refused before anything is loaded."""
    card = read_card(spark, path)
    if files_digest(spark, path) != card["digest"]:
        raise ValueError(f"{path} differs from its digest")
    kind = DefaultParamsReader.loadMetadata(path, spark)["class"]
    if not kind.startswith(allowed):
        raise ValueError(f"{path} is of class {kind}")
    return DefaultParamsReader.loadParamsInstance(path, spark), card["metadata"]
