"""Places and stations: forecasts by place name, the station master, unit policies, shared days, sequences, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.functions.core import MINUTE
from hydrolith.operators.joins import as_of, complete_lags


def contained(needles: DataFrame, haystacks: DataFrame, grams: int = 3) -> DataFrame:
    """(needle, hay) of each two texts of needles (text) and haystacks (text) where hay holds needle; both distinct, empty and null texts match nothing.

    Haystacks are indexed by their runs of up to `grams` characters. A needle is looked up by the rarest of its own runs, of
    full length where it is long enough, so only haystacks with that run are compared, and each pair is met once; a needle with a
    run that no haystack has is dropped at once. No pair of texts is made that shares no run.
    """
    runs = lambda lengths: F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, n)))))
    some = lambda df: df.select("text").where("text <> ''").distinct()
    full = F.least(F.lit(grams), F.length("text"))
    index = some(haystacks).select(F.col("text").alias("hay"), F.explode(runs(F.sequence(F.lit(1), full))).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    asked = some(needles).select(F.col("text").alias("needle"), F.explode(runs(F.array(full))).alias("gram"))
    rarest = asked.join(often, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    return rarest.select("needle", "r.gram").join(index, "gram").where(F.col("hay").contains(F.col("needle"))).select("needle", "hay")


def forecast_by_place(origins: DataFrame, forecasts: DataFrame, carry: list[str]) -> DataFrame:
    """origins (place, day, at, ...) with `carry` of a forecast (place, day, retrieved, ...) and whether its place matched.

    Counts: the latest forecast for the same day, retrieved at or before the origin, whose lower-cased place holds the
    origin's or is held by it; without one, the latest of any place. Places are matched as distinct names, then both
    look-ups are as-of joins on equal keys, cut into hours. Distinct names are few beside rows, and matched by rare runs of letters, see contained. A null or empty place matches none.
    """
    name = lambda c: F.lower(F.trim(c))
    left = origins.withColumn("_place", name(F.col("place")))
    right = forecasts.select(name(F.col("place")).alias("_theirs"), "day", F.col("retrieved").alias("_at"), *carry)
    ours, theirs = left.select(F.col("_place").alias("text")), right.select(F.col("_theirs").alias("text"))
    match = contained(ours, theirs).toDF("_ours", "_name").union(contained(theirs, ours).select("hay", "needle")).distinct()
    near = right.join(match, F.col("_theirs") == F.col("_name")).select(F.col("_ours").alias("_place"), "day", "_at", F.struct(*carry).alias("_near"))
    got = as_of(as_of(left, near, ["_place", "day"], "at", "_at", ["_near"], 60), right.select("day", "_at", F.struct(*carry).alias("_any")), ["day"], "at", "_at", ["_any"], 60)
    found = F.coalesce("_near", "_any")
    return got.select(*origins.columns, *[found[c].alias(c) for c in carry], F.when(found.isNotNull(), F.col("_near").isNotNull()).alias("place_matched"))


def station_master(sensors: DataFrame, coordinates: DataFrame, evidence: list[str]) -> DataFrame:
    """One row for each key of sensors (key, sensor_type, evidence...): its types, its place, and how far they agree.

    EVIDENCE_DIFFERS if the sensors of a key, or the key's coordinates (key, lon, lat, evidence...), name different
    evidence; NO_COORDINATES without any; REPEATED_TYPE if a type is listed twice; else MERGED. lon and lat are
    given for MERGED keys alone. A null key is no station.
    """
    sides = [sensors.select("key", *evidence, "sensor_type", F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.lit(False).alias("_place"))]
    sides.append(coordinates.select("key", *evidence, F.lit(None).cast("string").alias("sensor_type"), F.col("lon").cast("double"), F.col("lat").cast("double"), F.lit(True).alias("_place")))
    differs = F.lit(False)
    for c in evidence:
        differs = differs | (F.min(c) != F.max(c))
    types = F.array_sort(F.collect_set("sensor_type"))
    keyed = sides[0].unionByName(sides[1]).where(F.col("key").isNotNull()).groupBy("key")
    g = keyed.agg(types.alias("types"), F.count("sensor_type").alias("sensors"), F.coalesce(differs, F.lit(False)).alias("_differs"), F.bool_or("_place").alias("_has"), F.max("lon").alias("lon"), F.max("lat").alias("lat"))
    status = F.when(F.col("_differs"), "EVIDENCE_DIFFERS").when(~F.col("_has"), "NO_COORDINATES").when(F.size("types") < F.col("sensors"), "REPEATED_TYPE").otherwise("MERGED")
    kept = lambda c: F.when(F.col("status") == "MERGED", F.col(c)).alias(c)
    return g.where("sensors > 0").withColumn("status", status).select("key", F.array_join("types", "+").alias("types"), "sensors", "status", kept("lon"), kept("lat"))


def unit_policy(source: Column, field: Column, policies: list[tuple[str, str, str | None]]) -> Column:
    """Unit by the first policy (source, field pattern, unit) that fits the whole field; EXCLUDED for a policy without one.

    NO_POLICY if none fits. The policies are a short fixed list, so they become one expression and need no join.
    """
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern, unit in policies:
        out = out.when((source == name) & field.rlike(f"^(?:{pattern})$"), F.lit(unit or "EXCLUDED"))
    return out.otherwise("NO_POLICY")


def shared_days(covered: DataFrame) -> DataFrame:
    """(day, sensors, shared) of covered (sensor, day): how many sensors cover a day, and whether all that cover any do."""
    days = covered.groupBy("day").agg(F.count_distinct("sensor").alias("sensors"))
    total = covered.agg(F.count_distinct("sensor").alias("_all"))
    return days.crossJoin(F.broadcast(total)).select("day", "sensors", (F.col("sensors") == F.col("_all")).alias("shared"))


def sequences(rows: DataFrame, slots: int, step: int, horizon: int) -> DataFrame:
    """(sensor, origin_us, inputs, target): `slots` values up to the origin, newest first, and that of `horizon` minutes on.

    Only origins with all slots, the target, and every slot between usable are given. rows: one (sensor, t, value,
    usable) for each slot; horizon is a multiple of step.
    """
    ahead = horizon // step
    whole = complete_lags(rows, tuple(k * step for k in range(slots + ahead)))
    return whole.select("sensor", (F.col("origin_us") - horizon * MINUTE).alias("origin_us"), F.slice("inputs", ahead + 1, slots).alias("inputs"), F.col("inputs")[0].alias("target"))


def promotion(gates: dict[str, Column]) -> tuple[Column, Column]:
    """(verdict, blockers): PROMOTE if every gate holds, else BLOCKED with the names of those that don't, comma-joined; null fails."""
    failed = F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in gates.items()])))
    return F.when(F.size(failed) == 0, "PROMOTE").otherwise("BLOCKED"), F.array_join(failed, ",")
