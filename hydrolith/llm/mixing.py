"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.llm.common import fresh, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in one range of a running sum, about; so many ranges are summed up at once in turn.
RANGE_ROWS = 2048
LEAST_RANGES = 512
#: Buckets of one histogram of finish times, and the most entries that the last step of the cut sorts.
BUCKETS, LAST_ENTRIES = 4096, 8192


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (no_source, source, source_size) with their target: `share` of all sizes, split by weight under a cap.

    A source's target stops at `cap` times its size and the excess goes to the others by weight, until none is above.
    That is one water level: in the order of size by weight, the sources below the level that the others would reach
    without them are full. The table has a row for each source, so it is ordered in one task.
    """
    by_name = Window.orderBy("no_source", "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight)
    everything = Window.orderBy(F.col("source_size") / F.col("weight"), "no_source", "source")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    tried = ranked.withColumn("level", level).withColumn("full", F.lit(cap) * F.col("source_size") < F.col("level") * F.col("weight"))
    # the level of the first source that is not full holds for it and all after it
    first = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("weight")).alias("ratio"), "no_source", "source", "level"))).over(Window.partitionBy())
    return tried.withColumn("target", F.when(F.col("full"), F.lit(cap) * F.col("source_size")).otherwise(first["level"] * F.col("weight")).cast("double")).drop("level", "full")


def sums_before(rows: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """rows with `name`: the sum of `value` over the rows of the same keys with a smaller `at` (a whole number, once for each keys).

    Two levels: sums of RANGE_ROWS neighbours are added up first, so one task orders a 2048th of a key's rows.
    """
    block = F.floor(F.col(at) / RANGE_ROWS)
    held = rows.withColumn("_block", block)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = held.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before(*keys).orderBy("_block")), F.lit(0)))
    inside = F.coalesce(F.sum(value).over(before(*keys, "_block").orderBy(at)), F.lit(0))
    return held.withColumn("_inside", inside).join(blocks.drop("_sum"), [*keys, "_block"]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_block", "_start", "_inside")


def cut_at_budget(entries: DataFrame, budget: float) -> tuple[float, float, int] | None:
    """(lo, hi, taken) of the finish times `at` where the running sum of `size` passes the budget; None if it never does.

    All entries below lo fit and are `taken` in all; the cut lies from lo to hi, which hold LAST_ENTRIES entries or
    fewer, or one single time. Each step reads a histogram of BUCKETS sums of the bucket that the step before found.
    """
    lo, hi = entries.agg(F.min("at"), F.max("at")).first()
    taken = 0
    while lo is not None:
        bucket = F.least(F.lit(BUCKETS - 1), ((F.col("at") - lo) * (BUCKETS / (hi - lo))).cast("int")) if hi > lo else F.lit(0)
        steps = entries.where(F.col("at").between(lo, hi)).groupBy(bucket.alias("bucket")).agg(F.sum("size"), F.count("*"), F.min("at"), F.max("at")).collect()
        for _, size, n, first, last in sorted(steps):
            if taken + size > budget:
                break
            taken += size
        else:
            return None
        lo, hi = first, last
        if n <= LAST_ENTRIES or lo == hi:
            return lo, hi, taken
    return None


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, row_col: str | None = None) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, virtual_finish, taken), one for each row of docs.

    size is the text's number of words (null: 0). Each source is shuffled by the MD5 of the id; a document's virtual
    finish time is the running size of its source divided by the source's target, in `cap` passes over the source. All
    (document, pass) entries are ordered by finish time over all sources and taken until the next one would pass the
    total budget; taken is the size times the passes taken. So sources advance in step and end together, each within a
    document of its target. Running sums go by ranges of about RANGE_ROWS documents and then rows of a range, so no source
    is gathered in one task; rows that share an id are in one range. Ties go by id, then size; rows that agree in both are alike. A null source is a
    source of its own, the last. Null ids and empty texts take part, very long texts are counted whole. An empty table gives an empty result; other columns are not
    read.
    """
    sized = docs.select(
        (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("item"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("")).alias("key"),
    )
    sized = materialize(sized, "sized")
    own = ["no_source", "source"]
    sources = materialize(source_targets(sized.groupBy(*own).agg(F.sum("size").alias("source_size")), weights, share, cap), "sources")
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(LEAST_RANGES, -(-n // RANGE_ROWS))

    # running size of each source in shuffled order
    place = (F.coalesce(F.conv(F.substring("key", 1, 8), 16, 10), F.lit("0")).cast("double") * ranges / float(1 << 32)).cast("bigint")
    sized = sized.withColumn("range", place)
    starts = sums_before(sized.groupBy(*own, "range").agg(F.sum("size").alias("in_range")), own, "range", "in_range", "start")
    starts = starts.join(F.broadcast(sources) if sources.count() <= 4096 else sources, own).select(*own, "range", "start", "source_size", "target")
    inside = Window.partitionBy(*own, "range").orderBy("key", "doc_id", "size", "item").rowsBetween(Window.unboundedPreceding, 0)
    run = sized.join(starts, [*own, "range"]).withColumn("reached", F.col("start") + F.sum("size").over(inside))
    passes = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda p: F.when(F.col("target") > 0, (F.col("reached") + p * F.col("source_size")) / F.col("target")))
    run = materialize(run.withColumn("finish", passes).drop("range", "start", "reached"), "queue")

    # cut of the finish order at the budget
    entries = run.select("item", "doc_id", *own, "key", "size", F.posexplode("finish").alias("pass", "at")).where("size > 0 and at is not null")
    budget = share * total
    cut = cut_at_budget(entries, budget)
    if cut is None:
        passes = F.aggregate("finish", F.lit(0), lambda a, x: a + F.when(x.isNotNull(), 1).otherwise(0))
        out = run.withColumn("taken", F.when(F.col("size") > 0, F.col("size") * passes).otherwise(0).cast("bigint"))
    else:
        lo, hi, before = cut
        order = Window.orderBy("at", *own, "key", "doc_id", "size", "pass", "item").rowsBetween(Window.unboundedPreceding, 0)
        fits = entries.where(F.col("at").between(lo, hi)).withColumn("upto", F.sum("size").over(order) + before).where(F.col("upto").cast("double") <= budget)
        more = fits.groupBy("item").agg(F.count("*").alias("more"))
        sure = F.aggregate("finish", F.lit(0), lambda a, x: a + F.when(x < lo, 1).otherwise(0))
        out = run.join(more, "item", "left").withColumn("taken", (F.col("size") * (sure + F.coalesce("more", F.lit(0)))).cast("bigint"))
    return out.select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", F.element_at("finish", 1).alias("virtual_finish"), "taken", *([F.col("item").alias(row_col)] if row_col else []))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - 2::DOUBLE * coalesce(sum(source_size) OVER o, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level,
         row_number() OVER (ORDER BY source_size::DOUBLE / weight::DOUBLE, source NULLS LAST) AS place
  FROM sources
  WINDOW o AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN 2::DOUBLE * source_size < level * weight THEN 2::DOUBLE * source_size
              ELSE (SELECT arg_min(level, place) FROM levels WHERE NOT (2::DOUBLE * source_size < level * weight)) * weight END AS target
  FROM levels),
queue AS (
  SELECT s.doc_id, s.source, s.size, s.key, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS reached
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT *, (reached + p * source_size)::DOUBLE / target AS fin FROM queue, (VALUES (0), (1)) v(p) WHERE size > 0),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY fin, source IS NULL, source, key, doc_id, size, p ROWS UNBOUNDED PRECEDING) AS upto FROM entries),
chosen AS (
  SELECT doc_id, source, key, count(*) AS passes FROM cut
  WHERE upto::DOUBLE <= 1.5::DOUBLE * (SELECT sum(size) FROM sized)::DOUBLE GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(c.passes, 0))::BIGINT AS taken
FROM queue q LEFT JOIN chosen c ON q.doc_id = c.doc_id AND q.source IS NOT DISTINCT FROM c.source
"""


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kinds) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns kept, whatever their names. Rows without words are never taken.

    Rows are numbered in a written copy of docs, so that each meets its own decision even where ids repeat or are null.
    """
    row, times = fresh("_row", docs), fresh("_times", docs)
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    mixed = mix_sources(numbered, id_col, text_col, source_col, row_col=row, **kinds).where("taken > 0")
    often = mixed.select(row, (F.col("taken") / F.col("size")).cast("int").alias(times))
    return numbered.join(often, row).withColumn(times, F.explode(F.sequence(F.lit(1), times))).select([F.col(f"`{c}`") for c in docs.columns])
