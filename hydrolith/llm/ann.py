"""Approximate nearest neighbours with a forest of hash prefixes over shards of the vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.llm.common import materialize

#: Vectors in a shard, about; queries that meet a shard in one task, about; and about as many tasks at least for small tables.
SHARD_ROWS, QUERY_ROWS, LEAST_TASKS = 16384, 8192, 8
#: Fewest queries of a task, so that few queries don't copy the vectors.
LEAST_QUERIES = 64
#: Trees of a forest, bits of a hash string, trees that go up a bit between two looks at whether a query is done, and what few entries go up at once.
TREES, BITS, STEP, FEW = 96, 32, 16, 256


def usable(vector: str) -> Column:
    """The vector is there, has a component other than zero, and all of them are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def usual_length(df: DataFrame, vector: str) -> int:
    """The most frequent number of components, the smaller at a tie; 0 for an empty table."""
    best = df.groupBy(F.size(vector).alias("k")).count().agg(F.max(F.struct("count", -F.col("k")))).first()[0]
    return -best[1] if best else 0


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column of equal lengths as a matrix of doubles."""
    n = len(column)
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]) if n else np.empty(0)
    return flat.astype(np.float64).reshape(n, -1)


class PrefixForest:
    """Trees of long hash strings; a tree is the sorted array of its strings, a node the range that shares a prefix.

    A string says on which side of each of a tree's random planes through the mean a vector lies, one bit a plane. A query
    goes down each tree to the longest prefix that some stored string shares with its own, of another length in each tree. Then all trees go up
    together, one bit at a time, and what joins the widened ranges becomes a candidate. Vectors at an angle share a bit with the
    chance 1 - angle / pi, so once the k-th best candidate so far is known, the chance that no tree has shown a vector as near
    as it at this length is known as well; the query ends when that falls below 1 - recall, at the root at the latest.
    """

    def __init__(self, vectors: np.ndarray, planes: np.ndarray, centre: np.ndarray):
        """planes: (TREES, components, BITS)."""
        self.vectors, self.planes, self.centre = vectors, planes, centre
        self.bits = planes.shape[2]
        keys = np.concatenate([self.strings(vectors[i : i + 1024]) for i in range(0, len(vectors), 1024)] or [np.empty((0, len(planes)), np.int64)])
        order = np.argsort(keys, axis=0, kind="stable")
        self.keys = np.take_along_axis(keys, order, axis=0)
        self.order = order.T.astype(np.int32).ravel()  # tree after tree
        self.usual = float(np.median(np.linalg.norm(vectors - centre, axis=1))) if len(vectors) else 0.0
        self.compared = np.zeros(self.bits + 1, np.int64)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """The hash string of each vector and tree as a number."""
        side = np.einsum("nd,tdk->ntk", (x - self.centre).astype(np.float32), self.planes, optimize=True) >= 0
        return side @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, recall: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the positions and distances of its k nearest candidates; position own[q] is no candidate."""
        n, out, trees = len(self.vectors), [], len(self.planes)
        reach = np.linalg.norm(queries - self.centre, axis=1)
        for q0 in range(0, len(queries), 256):
            keys = self.strings(queries[q0 : q0 + 256])
            spans = np.empty((self.bits + 1, 2, *keys.shape), np.int64)
            for s in range(self.bits + 1):  # the range of each tree's strings that share the first s bits
                low = keys >> (self.bits - s) << (self.bits - s)
                for t in range(trees):
                    spans[s, 0, :, t] = np.searchsorted(self.keys[:, t], low[:, t])
                    spans[s, 1, :, t] = np.searchsorted(self.keys[:, t], low[:, t] + (1 << (self.bits - s)))
            there = (spans[:, 1] > spans[:, 0]).any(axis=2)
            offset = np.arange(trees) * n
            width = (spans[:, 1] - spans[:, 0]).sum(axis=2)
            for q in range(len(keys)):
                point, at = queries[q0 + q], q0 + q
                seen = np.zeros(n, bool)
                if own[at] >= 0:
                    seen[own[at]] = True
                ids, dist = np.empty(0, np.int64), np.empty(0)
                # down to the longest prefix that any tree has of the query, then up again
                for s, group in self._steps(width[:, q], int(np.flatnonzero(there[:, q])[-1]) if n else -1):
                    some = slice(*group)
                    a, d = spans[s, :, q, some]
                    b, c = spans[s + 1, :, q, some] if s < self.bits else (d, d)
                    empty = c <= b
                    # what the ranges have gained on either side
                    first = np.concatenate([a + offset[some], np.where(empty, d, c) + offset[some]])
                    size = np.concatenate([np.where(empty, d, b) - a, np.where(empty, 0, d - c)])
                    gained = np.flatnonzero(size > 0)
                    if len(gained):
                        first, size = first[gained], size[gained]
                        new = self.order[np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)]
                        new = np.unique(new[~seen[new]])
                        seen[new] = True
                        self.compared[s] += len(new)
                        gap = self.vectors[new] - point
                        ids, dist = np.append(ids, new), np.append(dist, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
                        if len(ids) > 4 * k:
                            keep = np.argpartition(dist, k - 1)
                            keep = keep[dist[keep] <= dist[keep[k - 1]]]
                            ids, dist = ids[keep], dist[keep]
                    if len(dist) >= k and self._missed(np.partition(dist, k - 1)[k - 1], reach[at], s, min(group[1], trees)) <= 1 - recall:
                        break
                out.append((ids, dist))
        return out

    def _steps(self, width: np.ndarray, longest: int):
        """(bits, (first, end) of trees): the order in which trees go up. Levels that gain little are one step, others one for each STEP trees."""
        for s in range(longest, -1, -1):
            gain = width[s] - (width[s + 1] if s < self.bits else 0)
            step = STEP if gain > FEW else len(self.planes)
            if gain or s == 0:
                yield from ((s, (g, g + step)) for g in range(0, len(self.planes), step))

    def _missed(self, far: float, reach: float, shared: int, up: int) -> float:
        """Chance that no tree has shown a stored vector at distance `far`, of the usual length: `up` trees show those that share so many bits, the others one more."""
        if reach <= 0 or self.usual <= 0:
            return 0.0 if shared == 0 else 1.0
        cosine = (reach**2 + self.usual**2 - far**2) / (2 * reach * self.usual)
        alike = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
        return (1 - alike**shared) ** up * (1 - alike ** (shared + 1)) ** (len(self.planes) - up)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.93, seed: int = 17) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest vectors found for each query by Euclidean distance.

    The vectors are dealt by hash to shards of about SHARD_ROWS, the queries to blocks of about QUERY_ROWS; each block
    meets each shard in one task, where a forest over all the shard's rows is searched, and the best of all shards are
    ranked, ties by smaller id. `recall` is the chance at which a shard's search ends. Vectors that are null, zero, of
    another length than most, or hold null or non-finite components take no part, as rows with a null id; rows that
    repeat an id count as one candidate, by its nearest vector, and as one query, by its smallest vector. Fewer
    candidates than k give fewer rows; no candidates, none. Other columns are not read.
    """
    length = usual_length(vectors.where(usable(vector_col)), vector_col)
    pick = lambda df: df.where(usable(vector_col) & (F.size(vector_col) == length) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    base, asked = pick(vectors), pick(queries).groupBy("id").agg(F.min("v").alias("v"))
    n, m = base.count(), asked.count()
    schema = "query_id bigint, vec_id bigint, score double"
    shards = max(1, -(-n // SHARD_ROWS))
    blocks = max(1, -(-m // QUERY_ROWS), min(-(-LEAST_TASKS // shards), m // LEAST_QUERIES))
    centre = np.array([x or 0.0 for x in base.agg(*[F.avg(F.col("v")[i]) for i in range(length)]).first()]) if length and n else np.zeros(length)
    planes = np.random.default_rng(seed).normal(size=(TREES, max(length, 1), BITS)).astype(np.float32)
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    left = base.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), block.alias("block"), "id", "v")
    right = asked.select(shard.alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "id", "v")

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and wanted.num_rows:
            ids, asked_ids = rows["id"].to_numpy(), wanted["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            forest = PrefixForest(matrix(rows["v"])[order], planes, centre)
            first, last = np.searchsorted(ids, asked_ids, "left"), np.searchsorted(ids, asked_ids, "right")
            own = np.where(last > first, first, -1)
            for q, (at, dist) in enumerate(forest.search(matrix(wanted["v"]), own, k + int((last - first).max()), recall)):
                keep = ids[at] != asked_ids[q]
                at, dist = at[keep], dist[keep]
                best = np.lexsort((ids[at], dist))
                best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])][:k]
                found.append((np.full(len(best), asked_ids[q]), ids[at][best], dist[best]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("query_id", "vec_id", "score"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    found = materialize(left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, schema), "nearest")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
