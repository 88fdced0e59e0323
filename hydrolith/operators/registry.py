"""Experiments, lineage and model versions as tables: digests, exact filters, stage changes along an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The stage changes that a version may go through.
STAGE_EDGES = (("CANDIDATE", "VALIDATED"), ("VALIDATED", "PRODUCTION"), ("CANDIDATE", "ARCHIVED"), ("VALIDATED", "ARCHIVED"), ("PRODUCTION", "ARCHIVED"))


def digest(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, keys in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def log_runs(log: DataFrame, runs: DataFrame, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(log with the new runs and their digest, conflicts): a run_id that is there with another digest is a conflict, with the same one no change."""
    new = runs.select("run_id", *content, digest(*content).alias("digest"))
    both = new.join(log.select("run_id", F.col("digest").alias("_old")), "run_id", "left")
    return log.unionByName(both.where("_old is null").drop("_old")), both.where("_old <> digest").select("run_id", "digest", F.col("_old").alias("logged_digest"))


def audit(log: DataFrame, content: list[str]) -> DataFrame:
    """Logged runs whose content no longer has its digest, and run_ids that are logged more than once."""
    wrong = log.where(digest(*content) != F.col("digest")).select("run_id", F.lit("DIGEST_DIFFERS").alias("problem"))
    again = log.groupBy("run_id").agg(F.count("*").alias("n")).where("n > 1").select("run_id", F.lit("REPEATED_RUN").alias("problem"))
    return wrong.union(again)


def find_runs(log: DataFrame, **fields) -> DataFrame:
    """Runs whose fields have exactly these values; a field of None is not asked for."""
    out = log
    for name, value in fields.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def lineage(models: DataFrame, manifests: DataFrame) -> DataFrame:
    """models with status: VERIFIED if the dataset manifest that they name by version has the digest that they were trained on."""
    m = manifests.select("dataset_version", F.col("digest").alias("_found"))
    status = F.when(F.col("_found").isNull(), "NO_MANIFEST").when(F.col("_found") == F.col("dataset_digest"), "VERIFIED").otherwise("DIGEST_DIFFERS")
    return models.join(m, "dataset_version", "left").select(*models.columns, status.alias("status"))


def versions(registered: DataFrame, name: str = "name", order: str = "registered_us", run: str = "run_id") -> DataFrame:
    """registered with `version`: 1, 2, ... of each model name in the order of registration; versions sort as numbers."""
    return registered.withColumn("version", F.row_number().over(Window.partitionBy(name).orderBy(order, run)))


def stages(changes: DataFrame, edges: tuple[tuple[str, str], ...] = STAGE_EDGES) -> DataFrame:
    """changes (name, version, step, stage) with `allowed` and `reason`.

    Each change is held against the stage of the change before; the first must be CANDIDATE. A change to PRODUCTION needs
    a reason_text. Changes of a version are few, versions are many.
    """
    before = F.lag("stage").over(Window.partitionBy("name", "version").orderBy("step"))
    known = F.array(*[F.lit(f"{a}>{b}") for a, b in edges])
    rows = changes.withColumn("before", before)
    reason = (
        F.when(F.col("before").isNull() & (F.col("stage") != "CANDIDATE"), "MUST_START_AS_CANDIDATE")
        .when(F.col("before").isNotNull() & ~F.array_contains(known, F.concat_ws(">", "before", "stage")), "NO_SUCH_EDGE")
        .when((F.col("stage") == "PRODUCTION") & (F.coalesce(F.trim("reason_text"), F.lit("")) == ""), "REASON_NEEDED")
    )
    return rows.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def families(log: DataFrame) -> DataFrame:
    """Distinct model families, in order."""
    return log.where(F.col("model_family").isNotNull()).select("model_family").distinct().orderBy("model_family")


def permutation_contributions(rows: DataFrame, features: list[str], score, seed: int = 42) -> DataFrame:
    """(feature, contribution, rank): mean change of the score where a feature's values are dealt anew among the rows.

    score: a function from columns by feature name to a column. The dealing is a bijection: rows are numbered in the order
    of a hash of the seed, the feature and the row, by blocks of it, and each row gets the value of its number's row.
    """
    base = rows.select(F.col("row_id"), *features)
    plain = {f: F.col(f) for f in features}
    out = None
    for f in features:
        dealt = _numbered(base.select("row_id", F.col(f).alias("_v")), F.xxhash64(F.lit(seed), F.lit(f), "row_id")).select("_no", "_v")
        asked = _numbered(base, F.xxhash64(F.lit(seed + 1), F.lit(f), "row_id"))
        both = asked.join(dealt, "_no")
        part = both.agg(F.avg(F.abs(score(plain) - score(plain | {f: F.col("_v")}))).alias("contribution")).select(F.lit(f).alias("feature"), F.round("contribution", 6).alias("contribution"))
        out = part if out is None else out.union(part)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("contribution"), "feature")))


def _numbered(rows: DataFrame, by: Column, blocks: int = 4096) -> DataFrame:
    """rows with _no, from 0, in the order of a hash: numbered inside blocks of the hash, with the blocks' totals before."""
    cut = rows.withColumn("_h", by).withColumn("_b", F.pmod(F.shiftright("_h", 40), F.lit(blocks)))
    sizes = cut.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = cut.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy("_h", "row_id")) - 1)
    return inner.join(sizes.select("_b", "_base"), "_b").withColumn("_no", F.col("_base") + F.col("_k")).drop("_h", "_b", "_base", "_k")
