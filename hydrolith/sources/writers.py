"""Write-once tables named by their content, canonical JSON lines, and an append-only manifest."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolith.sources import artifacts, digests


def content_version(df: DataFrame, digits: int = 16) -> str:
    """Hexadecimal version of a table's content, whatever the order of its rows: the root of its Merkle tree (see digests)."""
    return digests.content_digest(df)[:digits]


def write_once(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> tuple[str, bool]:
    """Write df below root/<version> unless that version is there; (path, whether it was written). It appears whole or not at all."""
    path = f"{root}/{content_version(df)}"
    if artifacts.exists(df.sparkSession, path):
        return path, False
    return path, artifacts.publish_table(df, path, partition_by=partition_by)[1]


def write_named(df: DataFrame, root: str, name: str) -> bool:
    """Write df as root/name once: the same content again is no change (False), other content under the name is an error, of a racing writer too."""
    path = f"{root}/{name}"
    if artifacts.exists(df.sparkSession, f"{path}/{artifacts.CARD}"):
        if artifacts.read_card(df.sparkSession, path)["digest"] != digests.content_digest(df):
            raise ValueError(f"{path} holds other content")
        return False
    return artifacts.publish_table(df, path)[1]


def json_lines(df: DataFrame) -> DataFrame:
    """One canonical JSON text a row: keys in order, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """All entries of a manifest, None before the first append."""
    return spark.read.parquet(path).drop("entry") if artifacts.exists(spark, path) else None


def append_manifest(spark: SparkSession, entries: DataFrame, path: str, seen: str | None = None) -> str:
    """Append entries and return the manifest's version. With `seen`, a manifest that has changed since that version is an error.

    An append is a numbered folder that appears by a rename, so of two racing writers one gets the number; the other takes the next,
    or where it gave `seen`, fails. Versions are chained digests of the appends, so none is read again but for its card.
    """
    place, system = artifacts._hadoop(spark, path)
    system.mkdirs(place)
    while True:
        names = sorted(s.getPath().getName() for s in system.listStatus(place) if s.getPath().getName().startswith("entry="))
        version = artifacts.read_card(spark, f"{path}/{names[-1]}")["metadata"]["version"] if names else ""
        if seen is not None and version != seen:
            raise ValueError(f"{path} was changed by another writer")
        mine = hashlib.sha256(f"{version}|{digests.content_digest(entries)}".encode()).hexdigest()[:16]
        number = int(names[-1].partition("=")[2]) + 1 if names else 0
        try:
            if artifacts.publish_table(entries, f"{path}/entry={number:08d}", {"version": mine})[1]:
                return mine
        except ValueError:
            pass  # the number went to another writer


def new_payloads(payloads: DataFrame, manifest: DataFrame) -> DataFrame:
    """Payloads (source, dataset, content) whose digest has no succeeded entry yet, with that digest."""
    named = payloads.withColumn("payload_sha256", F.sha2(F.col("content").cast("binary"), 256))
    done = manifest.where("status = 'SUCCEEDED'").select("source", "dataset", "payload_sha256").distinct()
    return named.join(done, ["source", "dataset", "payload_sha256"], "left_anti")
