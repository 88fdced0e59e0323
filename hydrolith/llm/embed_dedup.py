"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one vector kept a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.ann import matrix, usable, usual_length
from hydrolith.llm.common import materialize
from hydrolith.llm.components import connected_components, spanning_links

#: Distinct vectors in a cell, about; most cells (their centres and sizes are broadcast); most vectors that the centres are fitted on.
CELL_ROWS, MAX_CELLS, FIT_ROWS = 2048, 16384, 32768
#: Rows of each side of one block product.
BLOCK = 2048


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 13) -> np.ndarray:
    """k unit centres for unit rows x."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Cells:
    """Which cells a vector lies in or may have a partner in.

    Its home is the nearest centre. If x (home a) and y (home b) have a cosine of at least c, they are at most
    d = sqrt(2 - 2c) apart, the plane between a and b separates them, and one of the two is within d / 2 of it. So if
    each vector visits all cells whose plane is within d / 2, each pair meets in the home of one of the two: infinite
    deviations, the default, lose no pair, whatever the vectors are. Where gaps are known to point anywhere in n components,
    most are a step of about d / sqrt(n) towards a plane; finite deviations visit only the cells whose plane is within that many times half of
    it, d / 2 at most. They lose links of vectors near a subspace (0.88 of them found at 3 deviations near 3 of 64 dimensions).
    """

    def __init__(self, centres: np.ndarray, cosine: float, deviations: float):
        self.centres = centres
        self.reach = np.sqrt(2 - 2 * cosine) / 2 * min(1.0, deviations / np.sqrt(centres.shape[1])) + 1e-6

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home of each row; row and cell of each visit, ascending)."""
        homes, rows, cells = [], [], []
        step = max(1, (1 << 22) // len(self.centres))
        for i in range(0, len(x), step):
            s = x[i : i + step] @ self.centres.T
            home = s.argmax(axis=1)
            gap = s[np.arange(len(s)), home][:, None] - s
            row, cell = np.nonzero(gap <= 2 * self.reach)  # centres are at most 2 apart
            apart = np.linalg.norm(self.centres[home[row]] - self.centres[cell], axis=1)
            near = (gap[row, cell] <= self.reach * apart) & (home[row] != cell)
            homes.append(home)
            rows.append(row[near] + i)
            cells.append(cell[near])
        return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in (homes, rows, cells))


def close_pairs(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with cosine(a[i], b[j]) >= cosine in double precision; near the threshold each is computed by itself."""
    s = _unit(a) @ _unit(b).T
    i, j = np.nonzero(s >= cosine - 1e-9)
    edge = np.flatnonzero(s[i, j] < cosine + 1e-9)
    if len(edge):
        p, q = a[i[edge]], b[j[edge]]
        exact = np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))
        keep = np.ones(len(i), bool)
        keep[edge[exact < cosine]] = False
        i, j = i[keep], j[keep]
    return i, j


def embedding_components(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CELL_ROWS, block: int = BLOCK, deviations: float = float("inf")) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors; other columns are not read.

    n_links counts the other rows found at a cosine of at least `cosine`, none below it; component_id is the smallest
    vec_id reachable by links; kept is true for that one. Equal vectors are one class and compared once. Centres are
    fitted on at most FIT_ROWS distinct vectors, picked by hash; all vectors are compared, within their cell and with
    all that a link can reach over its planes; finite `deviations` look less far and lose links, see Cells. A cell is cut into blocks of at most `block` rows and
    each pair of blocks is one product; links of a product come back as counts and a spanning forest. Vectors that are
    null, zero, of another length than most, or hold null or non-finite components link with nothing and are kept, as rows
    with a null id (kept: false). Rows that share an id are one node. An empty table gives an empty result.
    """
    length = usual_length(vectors.where(usable(vector_col)), vector_col)
    good = usable(vector_col) & (F.size(vector_col) == length) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(good, F.col(vector_col)).alias("v"))
    rows = rows.withColumn("k1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("k2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), F.col("v"))))
    classes = rows.where("v is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = materialize(classes, "vectors")
    element = dict(classes.dtypes)["v"]
    total = classes.count()
    fit = classes.select("v").orderBy("k1", "k2").limit(FIT_ROWS).toArrow()["v"] if total else None
    cells = max(1, min(MAX_CELLS, round(total / cell_rows)))
    centres = spherical_kmeans(_unit(matrix(fit)), cells) if fit is not None else np.zeros((1, max(length, 1)))
    place = Cells(centres, cosine, deviations)

    def visit(batches):
        """Each vector's home and the cells that it visits, decided here once for all that follows."""
        for batch in batches:
            home, row, cell = place.of(_unit(matrix(pa.chunked_array([batch.column(2)]))))
            ends = np.searchsorted(row, np.arange(len(home) + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell))], ["rep", "n", "v", "home", "visits"])

    placed = materialize(classes.select("rep", "n", "v").mapInArrow(visit, f"rep bigint, n bigint, v {element}, home bigint, visits array<bigint>"), "placed")
    at_home = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("homes"))
    guests = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("guests"))
    sizes = at_home.join(guests, "cell", "left").select("cell", F.ceil(F.col("homes") / block).cast("int").alias("hb"), F.ceil(F.coalesce("guests", F.lit(0)) / (2 * block)).cast("int").alias("gb"))
    # a resident goes to every product of its cell that its block is in, a guest to those of its block with the residents'
    stays = placed.select("*", F.explode(F.concat(F.array("home"), "visits")).alias("cell")).join(F.broadcast(sizes), "cell")
    guest = F.col("cell") != F.col("home")
    own = F.pmod(F.xxhash64("rep"), F.when(guest, F.col("gb")).otherwise(F.col("hb"))).cast("int")
    homes = F.sequence(F.lit(0), F.col("hb") - 1)
    product = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    among = F.transform(homes, lambda i: product(F.least(i, own), F.greatest(i, own), i < own))
    with_guests = F.when(F.col("gb") > 0, F.transform(F.sequence(F.lit(0), F.col("gb") - 1), lambda i: product(own, F.col("hb") + i, F.lit(0)))).otherwise(F.slice(among, 1, 0))
    as_guest = F.transform(homes, lambda i: product(i, F.col("hb") + own, F.lit(1)))
    dealt = stays.withColumn("p", F.explode(F.when(guest, as_guest).otherwise(F.concat(among, with_guests)))).select("cell", "p.i", "p.j", "p.side", "rep", "n", "home", "visits", "v")

    def compare(table: pa.Table) -> pa.Table:
        side, cell = table["side"].to_numpy(), table["cell"][0].as_py()
        v, rep, n, home = matrix(table["v"]), table["rep"].to_numpy(), table["n"].to_numpy(), table["home"].to_numpy()
        left = np.flatnonzero(side == 0)
        within = table["i"][0] == table["j"][0]
        right = left if within else np.flatnonzero(side == 1)
        a, b, reps, counts = [], [], [], []
        if len(left) and len(right):
            calls = [set(c) for c in table["visits"].to_pylist()] if not within and home[right[0]] != cell else None
            for s in range(0, len(left), 1024):
                i, j = close_pairs(v[left[s : s + 1024]], v[right], cosine)
                i, j = left[s + i], right[j]
                if within:
                    i, j = i[i < j], j[i < j]
                elif calls is not None:
                    # a resident i and a guest j: if i visits j's home too, the pair counts in the lower of the two cells
                    keep = np.array([home[y] > cell or home[y] not in calls[x] for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
                    i, j = i[keep], j[keep]
                if len(i):
                    x, y = spanning_links(rep[i], rep[j])
                    a.append(x)
                    b.append(y)
                    weight = np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
                    hit = np.flatnonzero(weight)
                    reps.append(rep[hit])
                    counts.append(weight[hit].astype(np.int64))
        x, y, z, w = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (a, b, reps, counts))
        return pa.table({"a": pa.array(np.concatenate([x, z]), pa.int64()), "b": pa.array(np.concatenate([y, z]), pa.int64()), "n": pa.array(np.concatenate([np.zeros(len(x), np.int64), w]), pa.int64())})

    found = materialize(dealt.groupBy("cell", "i", "j").applyInArrow(compare, "a bigint, b bigint, n bigint"), "embedding-links")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("a <> b")).withColumnRenamed("node", "rep")
    known = classes.drop("v").join(links, "rep", "left").join(parts, "rep", "left")
    known = materialize(known.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "embedding-classes")
    linked = rows.where("v is not null").drop("v").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def drop_near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vectors with one representative of each group: the smallest id; rows that link with nothing stay, all columns kept."""
    gone = embedding_components(vectors, cosine, id_col, vector_col).where("not kept and vec_id is not null").select(F.col("vec_id").alias(id_col)).distinct()
    return vectors.join(gone, id_col, "left_anti").select(vectors.columns)
