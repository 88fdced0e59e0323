"""Digests of tables as Merkle trees: SHA-256 of canonical rows, combined over sorted ranges, alike however rows are ordered or partitioned."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a leaf, about, from which the depth of a tree follows; a node has 256 children.
LEAF_ROWS = 4096


def canonical_json(df: DataFrame, columns: list[str]):
    """One text for a row: its columns in order of their names, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})


def digest_tree(df: DataFrame, key: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """(level, prefix, digest, rows): the nodes of a table's tree, the root at level 0 with an empty prefix.

    A row belongs to the leaf whose prefix the SHA-256 of its key starts with (of the whole row without a key), so tables that
    have most keys in common differ in the leaves of those that changed alone. A leaf's digest is that of its rows' digests in
    order, with how often each occurs; a node's that of its children's. Equal rows are counted before they meet, so many
    copies of one row make no large leaf. depth: levels of two hexadecimal digits; by the number of rows where none is given.
    """
    if depth is None:
        depth = max(1, math.ceil(math.log(max(df.count() / LEAF_ROWS, 1), 256)))
    row = F.sha2(canonical_json(df, df.columns), 256)
    place = F.sha2(canonical_json(df, key), 256) if key else row
    rows = df.select(F.substring(place, 1, 2 * depth).alias("prefix"), row.alias("sha")).groupBy("prefix", "sha").agg(F.count("*").alias("n"))
    level = rows.groupBy("prefix").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sha", "n"))), lambda e: F.concat(e["sha"], F.lit(":"), e["n"].cast("string"))), "\n"), 256).alias("digest"), F.sum("n").alias("rows"))
    out = level.select(F.lit(depth).alias("level"), "prefix", "digest", "rows")
    for k in range(depth - 1, -1, -1):
        up = F.substring("prefix", 1, 2 * k) if k else F.lit("")
        children = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
        joined = F.array_join(F.transform(children, lambda e: F.concat(e["prefix"], F.lit(":"), e["digest"])), "\n")
        level = level.groupBy(up.alias("parent")).agg(F.sha2(joined, 256).alias("digest"), F.sum("rows").alias("rows")).withColumnRenamed("parent", "prefix")
        out = out.unionByName(level.select(F.lit(k).alias("level"), "prefix", "digest", "rows"))
    return out


def content_digest(df: DataFrame) -> str:
    """Root digest of a table with the names and types of its columns: 64 hexadecimal digits. An empty table has one too."""
    import hashlib

    tree = digest_tree(df)
    root = tree.where("level = 0").select("digest").first()
    shape = ",".join(f"{n}:{t}" for n, t in sorted(df.dtypes))
    return hashlib.sha256(f"{shape}|{root[0] if root else ''}".encode()).hexdigest()


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """(prefix): the leaves in which two stored trees of one depth differ, found from the trees alone, from the root down.

    Only nodes whose parents differ are compared; trees are small beside their tables.
    """
    depth = one.agg(F.max("level")).first()[0]
    if depth != other.agg(F.max("level")).first()[0]:
        raise ValueError("trees of different depths")
    a, b = one.select("level", "prefix", F.col("digest").alias("a")), other.select("level", "prefix", F.col("digest").alias("b"))
    both = a.join(b, ["level", "prefix"], "full").where("not (a <=> b)").select("level", "prefix")
    found = both.where("level = 0")
    for k in range(1, (depth or 0) + 1):
        up = F.substring("prefix", 1, 2 * (k - 1)) if k > 1 else F.lit("")
        found = both.where(F.col("level") == k).withColumn("_up", up).join(found.select(F.col("prefix").alias("_up")), "_up", "left_semi").drop("_up")
    return found.select("prefix")


def rows_of(df: DataFrame, key: list[str] | None, prefixes: DataFrame, depth: int) -> DataFrame:
    """The rows of a table in some leaves of its tree."""
    place = F.sha2(canonical_json(df, key or df.columns), 256)
    return df.withColumn("_leaf", F.substring(place, 1, 2 * depth)).join(prefixes.select(F.col("prefix").alias("_leaf")), "_leaf", "left_semi").drop("_leaf")
