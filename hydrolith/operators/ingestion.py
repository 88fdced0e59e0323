"""Raw ingestion as batch functions: manifest, raw layout, verified reads, station mapping, quarantine, upserts, run history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE, first_of, round6

#: Fields of a manifest entry.
MANIFEST = ("source", "dataset", "partition", "payload_sha256", "status", "batch", "retrieved_us", "rows", "quarantined", "duplicates")


def manifest_problems(entries: DataFrame) -> DataFrame:
    """Entries that lack a field of MANIFEST or its value, and digests that succeeded more than once, with the problem."""
    lacking = [c for c in MANIFEST if c not in entries.columns]
    if lacking:
        raise ValueError("manifest without " + ", ".join(lacking))
    key = ["source", "dataset", "partition", "payload_sha256"]
    problem = first_of(*[(F.col(c).isNull(), f"NO_{c.upper()}") for c in MANIFEST if c != "partition"], (~F.col("payload_sha256").rlike("^[0-9a-f]{64}$"), "BAD_DIGEST"), (~F.col("status").isin("SUCCEEDED", "FAILED", "BLOCKED"), "UNKNOWN_STATUS"))
    rows = entries.select(*key, problem.alias("problem")).where("problem is not null")
    again = entries.where("status = 'SUCCEEDED'").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("SUCCEEDED_TWICE").alias("problem"))
    return rows.union(again)


def find_succeeded(manifest: DataFrame, source: str, dataset: str, partition: str | None, sha: str) -> DataFrame:
    """The first succeeded entry of a payload, by retrieval; a null partition finds null ones alone."""
    hit = manifest.where((F.col("source") == source) & (F.col("dataset") == dataset) & F.col("partition").eqNullSafe(F.lit(partition).cast("string")) & (F.col("payload_sha256") == sha) & (F.col("status") == "SUCCEEDED"))
    return hit.orderBy("retrieved_us", "batch").limit(1)


def succeeded(manifest: DataFrame) -> DataFrame:
    """Succeeded entries, one for each payload, in an order that doesn't depend on when they were ingested."""
    key = ["source", "dataset", "partition", "payload_sha256"]
    one = manifest.where("status = 'SUCCEEDED'").groupBy(*key).agg(F.min(F.struct("retrieved_us", "batch")).alias("first"))
    return one.select(*key, F.col("first.batch").alias("batch")).orderBy("source", "dataset", F.coalesce("partition", F.lit("")), "payload_sha256")


def raw_folder(source: Column, dataset: Column, partition: Column, day: Column) -> Column:
    """source/dataset[/partition]/YYYY/MM/DD."""
    return F.concat_ws("/", source, dataset, partition, F.date_format(day, "yyyy/MM/dd"))


def verified(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose content has the digest that the manifest names for their path, the others): files (path, content), manifest (path, payload_sha256)."""
    both = files.withColumn("_sha", F.sha2(F.col("content").cast("binary"), 256)).join(manifest.select("path", "payload_sha256"), "path", "left")
    good = F.col("_sha").eqNullSafe(F.col("payload_sha256"))
    return both.where(good).drop("_sha", "payload_sha256"), both.where(~good).select("path", F.when(F.col("payload_sha256").isNull(), "NOT_IN_MANIFEST").otherwise("DIGEST_DIFFERS").alias("problem"))


def resolve_stations(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows (source, station_id, sensor_type) with sensor_id and quarantine: why a row has none.

    Outer white space is stripped; an empty id or one with white space inside is invalid. mapping: (source, station_id,
    sensor_type, sensor_id). A station known under the other sensor type alone is a mismatch.
    """
    clean = rows.withColumn("_id", F.regexp_replace("station_id", r"^\s+|\s+$", ""))
    m = mapping.select(F.col("source").alias("_s"), F.col("station_id").alias("_k"), F.col("sensor_type").alias("_t"), F.col("sensor_id").alias("_sensor"))
    known = m.groupBy("_s", "_k").agg(F.map_from_entries(F.collect_list(F.struct("_t", "_sensor"))).alias("_types"))
    both = clean.join(known, (F.col("source") == F.col("_s")) & (F.col("_id") == F.col("_k")), "left")
    found = F.try_element_at(F.col("_types"), F.col("sensor_type"))
    invalid = F.coalesce(F.col("_id") == "", F.lit(True)) | F.col("_id").rlike(r"\s")
    reason = first_of((invalid, "INVALID_STATION_ID"), (F.col("_types").isNull(), "UNMAPPED_STATION"), (found.isNull(), "SENSOR_TYPE_MISMATCH"))
    return both.select(*rows.columns, F.when(reason.isNull(), found).alias("sensor_id"), reason.alias("quarantine"))


def mapping_problems(mapping: DataFrame, derived: Column) -> DataFrame:
    """Mapping rows whose sensor_id is not the one that their own fields give."""
    return mapping.withColumn("expected", derived).where("not (sensor_id <=> expected)")


def mapping_conflicts(rows: DataFrame, raw: str, derived: str) -> DataFrame:
    """Rows whose two ids are both there and differ."""
    return rows.where(F.col(raw) != F.col(derived))


def ingest(payloads: DataFrame, manifest: DataFrame, parse: Callable[[DataFrame], DataFrame], mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with quarantine reasons, new manifest entries) of payloads (source, dataset, partition, batch, retrieved_us, content).

    A payload whose digest succeeded before, or stands twice in this batch, is taken once. parse turns the new ones into
    rows with their batch, source, station_id and sensor_type; rows of a batch that are alike in all fields are counted as
    duplicates and stay. Payloads without rows succeed with 0.
    """
    named = payloads.withColumn("payload_sha256", F.sha2(F.col("content").cast("binary"), 256))
    key = ["source", "dataset", "payload_sha256"]
    done = manifest.where("status = 'SUCCEEDED'").select(*key, "partition")
    fresh = named.join(done, [named[k] == done[k] for k in key] + [named["partition"].eqNullSafe(done["partition"])], "left_anti")
    first = fresh.groupBy(*key, "partition").agg(F.min("batch").alias("batch"))
    fresh = fresh.join(first.select("batch"), "batch", "left_semi")
    records = resolve_stations(parse(fresh), mapping)
    alike = records.groupBy(*[c for c in records.columns if c not in ("quarantine", "sensor_id")]).agg(F.count("*").alias("n"), F.count_if(F.col("quarantine").isNotNull()).alias("q"))
    counts = alike.groupBy("batch").agg(F.sum("n").alias("rows"), F.sum("q").alias("quarantined"), F.sum(F.col("n") - 1).alias("duplicates"))
    entries = fresh.join(counts, "batch", "left").select("source", "dataset", "partition", "payload_sha256", F.lit("SUCCEEDED").alias("status"), "batch", "retrieved_us", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "quarantined", "duplicates")])
    return records, entries


def source_duplicates(rows: DataFrame, batch: str, content: list[str]) -> DataFrame:
    """(batch, rows, duplicates): rows of a payload beyond the first of each content."""
    return rows.groupBy(batch, *content).agg(F.count("*").alias("n")).groupBy(batch).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"))


def with_quarantined(accepted: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Accepted rows and those set aside as one table; columns that one side lacks are null there."""
    return accepted.withColumn("is_quarantined", F.lit(False)).unionByName(quarantined.withColumn("is_quarantined", F.lit(True)), allowMissingColumns=True)


def quantised(value: Column) -> Column:
    """Four decimals, as a database stores it."""
    return value.cast("decimal(12,4)")


def merge_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new whose key it lacks; of several, the first by their content. Late rows are taken like others, so a poll can run again."""
    other = [c for c in old.columns if c not in key]
    fresh = new.groupBy(*key).agg(F.min(F.struct(*other)).alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in other])
    return old.unionByName(fresh.join(old.select(*key), key, "left_anti").select(old.columns))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Counters over a table of runs (status, started_us, ended_us, received, inserted, duplicates, quarantined); open runs have no end."""
    ended = F.col("ended_us").isNotNull()
    minutes = (F.col("ended_us") - F.col("started_us")) / float(MINUTE)
    count = lambda s: F.count_if(ended & (F.col("status") == s))
    return runs.agg(
        F.count("*").alias("poll_attempts"), count("SUCCEEDED").alias("successful_polls"), count("FAILED").alias("failed_polls"), count("BLOCKED").alias("blocked_polls"),
        F.count_if(~ended).alias("incomplete"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("received", "inserted", "duplicates", "quarantined")],
        round6(F.avg(minutes)).alias("mean_minutes"), F.max(F.when(F.col("status") == "SUCCEEDED", F.col("ended_us"))).alias("last_success_us"),
    )


def each_target(targets: DataFrame, outcome: Column, failure: Column) -> DataFrame:
    """targets with the outcome of their poll; a target whose poll failed has its failure and holds up no other."""
    return targets.select("*", F.when(failure.isNull(), outcome).alias("outcome"), failure.alias("failure"))


def available_at(first_retrieved: Column, observed: Column) -> Column:
    """From when on a row could be known: as-of joins use it in place of its own time."""
    return F.greatest(first_retrieved, observed)


def live_inference(origins: DataFrame, eligible_models: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(sensor, origin_us, horizon, status, model): SCORED with the model of the horizon, SKIPPED_NO_ELIGIBLE_MODEL without one."""
    asked = origins.select("sensor", "origin_us", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    best = eligible_models.groupBy("horizon").agg(F.max(F.struct("version", "model")).alias("m")).select("horizon", "m.model")
    return asked.join(best, "horizon", "left").select("sensor", "origin_us", "horizon", F.when(F.col("model").isNull(), "SKIPPED_NO_ELIGIBLE_MODEL").otherwise("SCORED").alias("status"), "model")


def predictions(scored: DataFrame, value: Column, cut: float) -> DataFrame:
    """Prediction rows as they are stored: target instant, quantised value, and whether it exceeds the cut; an id of (sensor, origin, horizon, model)."""
    target = F.col("origin_us") + F.col("horizon").cast("bigint") * MINUTE
    name = F.concat_ws("/", "sensor", F.col("origin_us").cast("string"), F.col("horizon").cast("string"), "model")
    return scored.select(F.sha2(name, 256).alias("prediction_id"), "sensor", "origin_us", target.alias("target_us"), "horizon", "model", quantised(value).alias("value"), (value >= cut).alias("exceeds"))
