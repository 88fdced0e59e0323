"""Centroid clustering in Spark's own expressions: integer distances to literal centroids, sums of columns as updates."""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import Scratch

#: Integers below this fit decimals of 38 digits as sums of squared differences; wider components can't be told apart exactly.
WIDEST = 1 << 58


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    """(id, v): vectors with exactly `components` finite components as integers floor(scale * x), x as double."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fits = F.forall(x, lambda e: e.isNotNull() & (F.abs(e * scale) < float(WIDEST)))
    whole = vectors.where(F.coalesce((F.size(x) == components) & fits, F.lit(False)) & F.col(f"`{id_col}`").isNotNull())
    return whole.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.transform(x, lambda e: F.floor(e * scale).cast("bigint")).alias("v"))


def nearest_centroid(vector: Column, centroids: list[list[int]], kind: str) -> Column:
    """(distance, cluster) of the centroid at the least squared distance, the smaller number at a tie."""

    def away(c: list[int]) -> Column:
        there = F.expr(f"array({', '.join(f'{x}L' for x in c)})").cast(f"array<{kind}>")
        squares = F.zip_with(vector.cast(f"array<{kind}>"), there, lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast(kind), lambda total, d: (total + d).cast(kind))

    return F.array_min(F.array(*[F.struct(away(c).alias("distance"), F.lit(j).alias("cluster")) for j, c in enumerate(centroids)]))


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 64, scale: int = 1024, prefix: str = "3:") -> DataFrame:
    """Rows (id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each vector that takes part.

    Vectors become integers floor(scale * x). Centroids 0, 1, ... start as the k vectors of the smallest SHA-256 of `prefix`
    and id; each round assigns all vectors and sets every centroid that has some to the floor of their mean; then all are assigned once
    more. A round is one pass over a table of integers: distances are expressions over literal arrays, a centroid's new
    place is a sum for each component, and k rows of sums, whatever the input, reach the driver. Rounds end early only
    when no centroid moved, which gives the same result. The sums are exact: longs while the largest component and the
    number of vectors allow it, else decimals; a sum that no long holds is null.

    Null vectors, those with another number of components, a null or non-finite one, or one beyond 2^58 / scale, and
    rows with a null id take no part. Rows that repeat an id are vectors each; of the same id, the smaller vector starts
    first. With fewer than k vectors each starts a centroid; vectors that are alike start centroids alike, of which the first gets
    all. An empty table gives an empty result. Other columns are not read.
    """
    held = Scratch(vectors.sparkSession)
    rows = held.write(integer_vectors(vectors, id_col, vector_col, components, scale), "integer-vectors")
    n, widest = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    named = F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256)
    centroids = [list(r["v"]) for r in rows.orderBy(named, "id", "v").limit(k).collect()]
    if not centroids:
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    kind = "bigint" if widest <= isqrt((1 << 62) // max(components, 1)) // 2 else "decimal(38,0)"
    held_by = "bigint" if n * max(widest, 1) < 1 << 62 else "decimal(38,0)"
    for _ in range(rounds):
        sums = [F.expr(f"sum(cast(v[{i}] AS {held_by}))").alias(f"s{i}") for i in range(components)]
        new = [*centroids]
        for r in rows.select(nearest_centroid(F.col("v"), centroids, kind)["cluster"].alias("cluster"), "v").groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
            new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(components)]
        if new == centroids:
            break
        centroids = new
    last = nearest_centroid(F.col("v"), centroids, kind)
    out = Scratch(vectors.sparkSession).write(rows.select("id", last.alias("m")).select("id", "m.cluster", "m.distance"), "assigned")
    held.drop()
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    by_cluster = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1)
    long = lambda x: F.lit(x if x < 1 << 63 else None).cast("bigint")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return out.select(
        F.col("id").alias(id_col), "cluster", F.col("distance").try_cast("bigint").alias("distance"),
        by_cluster([long(inertia.get(j, 0)) for j in range(len(centroids))]).alias("cluster_inertia"), long(sum(inertia.values())).alias("inertia"), by_cluster(names).alias("centroid_sha256"),
    )


def cluster_oracle(k: int = 8, rounds: int = 10, components: int = 64, scale: int = 1024, prefix: str = "3:") -> str:
    """The same in SQL, a common table for each round."""
    sql = f"""WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS MATERIALIZED (SELECT vec_id, unnest(range({components})) AS i, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{prefix}' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))"""
    for r in range(rounds + 1):
        sql += f""",
a{r} AS MATERIALIZED (SELECT vec_id, min(d * {k} + c) AS m FROM (SELECT vec_id, c, sum((x - y) * (x - y)) AS d FROM comp JOIN (SELECT c, unnest(range({components})) AS i, unnest(v) AS y FROM c{r}) USING (i) GROUP BY 1, 2) GROUP BY 1)"""
        if r < rounds:
            sql += f""",
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.v, o.v) AS v FROM c{r} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT m % {k} AS c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN comp USING (vec_id) GROUP BY 1, 2) GROUP BY 1) w ON w.c = o.c)"""
    return sql + f"""
SELECT vec_id, (m % {k})::INT AS cluster, (m // {k})::BIGINT AS distance, sum(m // {k}) OVER (PARTITION BY m % {k})::BIGINT AS cluster_inertia, sum(m // {k}) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = m % {k}"""
