"""Queries of digests over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.plans.catalog import _query, table
from hydrolith.sources import digests

KEY, DEPTH = ["o_orderkey"], 1
_TREE = """WITH {n}h AS (SELECT sha256('{{"o_orderkey":' || o_orderkey || '}}')[1:2] AS prefix, sha256('{{"o_custkey":' || {cust} || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}}') AS sha FROM orders),
{n}c AS (SELECT prefix, sha, count(*) AS n FROM {n}h GROUP BY 1, 2),
{n}l AS (SELECT prefix, sha256(string_agg(sha || ':' || n, chr(10) ORDER BY sha)) AS digest, sum(n)::BIGINT AS "rows" FROM {n}c GROUP BY 1)"""


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")


@_query(_TREE.format(n="a", cust="o_custkey") + """ SELECT 1 AS level, prefix, digest, "rows" FROM al UNION ALL SELECT 0, '', sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix)), sum("rows")::BIGINT FROM al""")
def dataset_digest(spark, sf_dir):
    return digests.digest_tree(_orders(spark, sf_dir), KEY, DEPTH)


@_query(_TREE.format(n="a", cust="o_custkey") + ", " + _TREE.format(n="b", cust="CASE WHEN o_orderkey % 1009 = 3 THEN 0 ELSE o_custkey END").removeprefix("WITH ") + """ SELECT o_orderkey FROM orders WHERE sha256('{"o_orderkey":' || o_orderkey || '}')[1:2] IN (SELECT prefix FROM al FULL JOIN bl USING (prefix) WHERE al.digest IS DISTINCT FROM bl.digest)""")
def differing_rows(spark, sf_dir):
    """Rows of the leaves in which a changed copy of the table differs, found from the two trees."""
    rows = _orders(spark, sf_dir)
    changed = rows.withColumn("o_custkey", F.when(F.col("o_orderkey") % 1009 == 3, F.lit(0).cast(dict(rows.dtypes)["o_custkey"])).otherwise(F.col("o_custkey")))
    leaves = digests.differing(digests.digest_tree(rows, KEY, DEPTH), digests.digest_tree(changed, KEY, DEPTH))
    return digests.rows_of(rows, KEY, leaves, DEPTH).select("o_orderkey")
