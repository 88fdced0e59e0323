"""Quality rules whose cutoffs come from the corpus: mergeable quantile sketches by language and source give each its own fences."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.llm.common import BLOCK_BYTES, Scratch, _segments, doc_blocks, fresh, text_buffers

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: Statistics that rules bound: name, numerator and denominator (per 10,000; the length in thousandths), least spread, whether low values fail too.
STATISTICS = (
    ("word_length", "word_chars", "n_words", 1000, 400, True),
    ("symbols", "n_symbols", "word_chars", 10000, 60, False),
    ("dup_lines", "n_dup_lines", "n_lines", 10000, 800, False),
    ("repeats", "n_repeat_words", "n_words", 10000, 400, False),
    ("upper", "n_upper", "word_chars", 10000, 500, False),
)
#: A fence lies so many spreads (between the quartiles) beyond the quartile; groups of fewer documents use their language's fences.
SPREADS, LEAST_DOCS = 5, 100
#: A bucket of a sketch keeps so many leading bits of a value: quantiles are within 1 / 2^6 of their value.
KEPT_BITS = 7
#: Thresholds of at most so many groups are broadcast; more are joined with documents dealt over this many shares of a group.
BROADCAST_GROUPS, SHARES = 50_000, 32

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _codes(values: np.ndarray) -> tuple[np.ndarray, int]:
    codes, found = pd.factorize(values)
    return codes.astype(np.int64), max(len(found), 1)


def repeated_words(ids: np.ndarray, docs: np.ndarray, n_docs: int, width: int = 5) -> np.ndarray:
    """For each document its words in windows of `width` words (3 to 6) that it holds twice or more.

    ids: a number for each word, equal words alike; docs: the document of each word, ascending. Windows are named by
    pairs of names of shorter windows, so that equal names are equal words, without hashes.
    """
    starts = len(ids) - width + 1
    if starts < 1:
        return np.zeros(n_docs, np.int64)
    name, count = _codes(ids)
    single, singles = name, count
    for size in range(2, width + 1):
        name, count = _codes(name[: len(ids) - size + 1] * singles + single[size - 1 :])
    inside = docs[:starts] == docs[width - 1 :]
    at = np.flatnonzero(inside)
    keys, distinct = _codes(name[at] * n_docs + docs[at])
    again = at[np.bincount(keys, minlength=distinct)[keys] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return np.bincount(docs[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def block_counts(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rows of COUNTS of the documents data[cuts[i] : cuts[i + 1]] (UTF-8)."""
    n, number = len(cuts) - 1, {}
    ids, counts, lines = [], np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
    for i in range(n):
        doc = data[cuts[i] : cuts[i + 1]]
        for a, b in _segments(doc) if len(doc) > 8 * BLOCK_BYTES else ((0, len(doc)),):
            words = doc[a:b].tobytes().split()
            for w in words:
                number.setdefault(w, len(number))
            ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            counts[i] += len(words)
        seen, held = set(), 0
        for line in doc.tobytes().split(b"\n"):
            if line.strip():
                held += 1
                seen.add(line)
        lines[i] = held - len(seen), held
    docs = np.repeat(np.arange(n), counts)
    total = lambda mark: np.diff(np.concatenate([[0], np.cumsum(mark)])[cuts])
    chars = ~_SPACE[data] & ((data & 0xC0) != 0x80)
    repeats = repeated_words(np.concatenate(ids) if ids else np.empty(0, np.int64), docs, n)
    return np.stack([counts, total(chars), total(_SYMBOL[data]), lines[:, 0], repeats, lines[:, 1], total((data >= 65) & (data <= 90))], axis=1)


def document_counts(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with COUNTS of the whole text; `keep` holds none of these names."""
    text = fresh("text", docs.select(*[f"`{c}`" for c in keep]))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(text))
    schema = rows.drop(text)
    for c in COUNTS:
        schema = schema.withColumn(c, F.lit(0).cast("bigint"))

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.num_columns - 1))
            found = [block_counts(data[offsets[i] : offsets[j]], np.asarray(offsets[i : j + 1] - offsets[i])) for i, j in doc_blocks(offsets)]
            found = np.concatenate(found) if found else np.empty((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(np.ascontiguousarray(found[:, k]), pa.int64()) for k in range(len(COUNTS))]], names=[*batch.schema.names[:-1], *COUNTS])

    return rows.mapInArrow(run, schema.schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The bounded statistics as whole numbers, rounded down; null without a denominator."""
    return {name: F.when(F.col(d) > 0, F.expr(f"({n} * {unit}L) div {d}")) for name, n, d, unit, _, _ in STATISTICS}


def sketch(counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Quantile sketches (lang, source, statistic, bucket, n) of documents that pass the fixed rules.

    A bucket holds the values that share their leading KEPT_BITS bits, so a sketch has some thousands of buckets at most,
    its quantiles a relative error under 1 / 64, and sketches of parts of a corpus merge by adding: see merge().
    """
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("statistic"), c.alias("value")) for name, c in ratios().items()]))
    long = counts.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), values.alias("s")).select("lang", "source", "s.*").where("value is not null")
    cut = f"greatest(0, length(bin(value)) - {KEPT_BITS})"
    return long.groupBy("lang", "source", "statistic", F.expr(f"shiftleft(shiftright(value, {cut}), {cut})").alias("bucket")).agg(F.count("*").alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of all documents of several."""
    return reduce(DataFrame.unionByName, sketches).groupBy("lang", "source", "statistic", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame) -> DataFrame:
    """(lang, source, <statistic>_low, <statistic>_high...): the least and greatest values that pass in each language and source.

    A fence lies SPREADS spreads beyond the quartile; the spread is the distance of the quartiles, at least the
    statistic's least spread. A group of fewer than LEAST_DOCS documents takes the fences of its language, a language of
    fewer those of all: their sketches are merged from those of the groups. Null languages and sources are groups too.
    """
    groups = sketches.select("lang", "source").distinct()
    level = lambda lang, source: sketches.groupBy(lang.alias("lang"), source.alias("source"), "statistic", "bucket").agg(F.sum("n").alias("n"))
    nothing = F.lit(None).cast("string")

    def bounds(s: DataFrame) -> DataFrame:
        part = Window.partitionBy("lang", "source", "statistic")
        s = s.withColumn("docs", F.sum("n").over(part)).withColumn("upto", F.sum("n").over(part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("docs"), F.col("bucket")))
        q = s.groupBy("lang", "source", "statistic").agg(F.max("docs").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))
        wide = []
        for name, _, _, _, least, both in STATISTICS:
            spread = SPREADS * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
            mine = F.col("statistic") == name
            wide += [F.max(F.when(mine, F.col("q1") - spread)).alias(f"{name}_low")] if both else []
            wide += [F.max(F.when(mine, F.col("q3") + spread)).alias(f"{name}_high")]
        names = [f"{s[0]}_{e}" for s in STATISTICS for e in (("low", "high") if s[5] else ("high",))]
        return q.groupBy("lang", "source").agg(F.max("docs").alias("docs"), *wide).select("lang", "source", "docs", F.struct(*names).alias("f"))

    own = bounds(level(F.col("lang"), F.col("source")))
    by_lang = bounds(level(F.col("lang"), nothing)).select(F.col("lang").alias("_lang"), F.col("docs").alias("_lang_docs"), F.col("f").alias("_lang_f"))
    whole = bounds(level(nothing, nothing)).select(F.col("f").alias("_all_f"))
    # every group meets its one language and the one row of the whole
    both = groups.alias("g").join(own.alias("o"), F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source")))
    both = both.join(by_lang, F.col("g.lang").eqNullSafe(F.col("_lang"))).join(F.broadcast(whole))
    picked = F.when(F.col("docs") >= LEAST_DOCS, F.col("f")).when(F.col("_lang_docs") >= LEAST_DOCS, F.col("_lang_f")).otherwise(F.col("_all_f"))
    return both.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), picked.alias("f")).select("lang", "source", "f.*")


def with_verdict(counts: DataFrame, thresholds: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """counts with base_failed, broken (names of the rules that a document breaks, comma-joined) and kept.

    Thresholds are broadcast up to BROADCAST_GROUPS groups, which are counted; beyond, each is repeated for SHARES shares
    of its documents, so that a group with a third of all rows is met in as many tasks.
    """
    bounds = [c for c in thresholds.columns if c not in ("lang", "source")]
    names = {c: fresh(f"_{c}", counts) for c in ("lang", "source", "share", *bounds)}
    right = thresholds.select(*[F.col(c).alias(names[c]) for c in ("lang", "source", *bounds)])
    on = F.col(lang).eqNullSafe(F.col(names["lang"])) & F.col(source).eqNullSafe(F.col(names["source"]))
    if thresholds.count() <= BROADCAST_GROUPS:
        both = counts.join(F.broadcast(right), on, "left")
    else:
        right = right.withColumn(names["share"], F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        mine = fresh("_mine", counts, right)
        left = counts.withColumn(mine, F.pmod(F.xxhash64(*COUNTS, F.monotonically_increasing_id()), F.lit(SHARES)).cast("int"))
        both = left.join(right, on & (F.col(mine) == F.col(names["share"])), "left").drop(mine)
    checks = []
    for name, c in ratios().items():
        checks += [F.when(c < F.col(names[b]), F.lit(b)) for b in (f"{name}_low",) if b in bounds] + [F.when(c > F.col(names[f"{name}_high"]), F.lit(f"{name}_high"))]
    broken = F.array_join(F.array_compact(F.array(*checks)), ",")
    out = both.withColumns({"base_failed": base_failed(), "broken": broken}).withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))
    return out.drop(*[n for c, n in names.items() if c != "share"], names["share"])


def fit_fences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The fences of a corpus; null texts count as empty, which the fixed rules leave out."""
    counts = document_counts(docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text")), "text", ["lang", "source"])
    return fences(Scratch(docs.sparkSession).write(sketch(counts), "sketches"))


def rule_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (id_col, COUNTS, base_failed, broken, kept), one for each document, by fences of this very corpus.

    Counts are those of the whole text, worked out once and written without texts; sketches, fences and verdicts come from
    them. Null texts count as empty and fail the fixed rules, as texts of fewer than ten words do. Null languages and
    sources are groups like others. Rows that repeat, or share an id or have none, are judged each. An empty table gives
    an empty result; other columns are not read. A document without a fence (all of its group failed the fixed rules)
    fails them itself. One text is handled at once, in segments of a megabyte.
    """
    held = Scratch(docs.sparkSession)
    named = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{source_col}`").alias("_source"), F.col(f"`{text_col}`").alias("_text"))
    counts = held.write(document_counts(named, "_text", ["_id", "_lang", "_source"]), "document-counts")
    limits = held.write(fences(sketch(counts, "_lang", "_source")), "fences")
    return with_verdict(counts, limits, "_lang", "_source").select(F.col("_id").alias(id_col), *COUNTS, "base_failed", "broken", "kept")


def keep_good(docs: DataFrame, thresholds: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, that pass the fixed rules and the given fences; see rule_report for odd rows.

    A document of a language and source without a fence is judged by the fixed rules alone.
    """
    safe = [f"_d{k}" for k in range(len(docs.columns))]
    at = {c: safe[k] for k, c in enumerate(docs.columns)}
    counts = document_counts(docs.toDF(*safe), at[text_col], safe)
    return with_verdict(counts, thresholds, at[lang_col], at[source_col]).where("kept").select(*safe).toDF(*docs.columns)


def rules_oracle() -> str:
    """rule_report over documents in SQL."""
    stats = ", ".join(f"({n} * {unit}) // nullif({d}, 0) AS {name}" for name, n, d, unit, _, _ in STATISTICS)
    longs = " UNION ALL ".join(f"SELECT lang, source, '{s[0]}' AS statistic, {s[0]} AS value FROM st WHERE NOT base_failed" for s in STATISTICS)
    cut = f"greatest(0, length(bin(value)) - {KEPT_BITS})"
    wide, checks = [], []
    for name, _, _, _, least, both in STATISTICS:
        if both:
            wide.append(f"max(q1 - {SPREADS} * greatest(q3 - q1, {least})) FILTER (statistic = '{name}') AS {name}_low")
            checks.append(f"CASE WHEN {name} < {name}_low THEN '{name}_low' END")
        wide.append(f"max(q3 + {SPREADS} * greatest(q3 - q1, {least})) FILTER (statistic = '{name}') AS {name}_high")
        checks.append(f"CASE WHEN {name} > {name}_high THEN '{name}_high' END")
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT rid, pos, word, CASE WHEN lead(pos, 4) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS gram FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos, word, (gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1)::INT AS rep FROM g),
c AS (SELECT rid, word, max(rep) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM r),
wc AS (SELECT rid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, sum(m)::BIGINT AS n_repeat_words FROM c GROUP BY 1),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
ct AS (SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper FROM d LEFT JOIN wc USING (rid) LEFT JOIN lc USING (rid)),
st AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {stats} FROM ct),
sk AS (SELECT lang, source, statistic, (value >> {cut}) << {cut} AS bucket FROM ({longs}) WHERE value IS NOT NULL),
lv AS (SELECT 'own' AS lv, lang, source, statistic, bucket, count(*) AS n FROM sk GROUP BY ALL UNION ALL SELECT 'lang', lang, NULL, statistic, bucket, count(*) FROM sk GROUP BY ALL UNION ALL SELECT 'all', NULL, NULL, statistic, bucket, count(*) FROM sk GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, statistic) AS docs, sum(n) OVER (PARTITION BY lv, lang, source, statistic ORDER BY bucket) AS upto FROM lv),
qs AS (SELECT lv, lang, source, statistic, max(docs) AS docs, min(bucket) FILTER (4 * upto >= docs) AS q1, min(bucket) FILTER (4 * upto >= 3 * docs) AS q3 FROM cu GROUP BY ALL),
fe AS (SELECT lv, lang, source, max(docs) AS docs, {', '.join(wide)} FROM qs GROUP BY ALL),
pk AS (SELECT o.lang, o.source, CASE WHEN o.docs >= {LEAST_DOCS} THEN 'own' WHEN l.docs >= {LEAST_DOCS} THEN 'lang' ELSE 'all' END AS lv FROM fe o JOIN fe l ON l.lv = 'lang' AND o.lang IS NOT DISTINCT FROM l.lang WHERE o.lv = 'own'),
fs AS (SELECT p.lang AS _l, p.source AS _s, f.* EXCLUDE (lv, lang, source, docs) FROM pk p JOIN fe f ON f.lv = p.lv AND (p.lv = 'all' OR f.lang IS NOT DISTINCT FROM p.lang) AND (p.lv <> 'own' OR f.source IS NOT DISTINCT FROM p.source)),
vd AS (SELECT st.*, concat_ws(',', {', '.join(checks)}) AS broken FROM st LEFT JOIN fs ON lang IS NOT DISTINCT FROM _l AND source IS NOT DISTINCT FROM _s)
SELECT doc_id, {', '.join(COUNTS)}, base_failed, broken, NOT base_failed AND broken = '' AS kept FROM vd"""
