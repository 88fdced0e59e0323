"""Payload readers: JSON histories and forecasts, HTML listings, CSV station master, JSON-lines observations."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "struct<info:map<string,string>,values:array<map<string,string>>>"
FORECAST = "array<struct<location:struct<location_id:string,location_name:string>,date:string,summary_forecast:string,min_temp:string,max_temp:string>>"


def history_rows(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Rows of station-history JSON; all values stay text. A body that says "No result" has none."""
    parsed = payloads.where(~F.col(body).contains("No result")).withColumn("_p", F.from_json(body, HISTORY))
    return parsed.select(*payloads.columns, F.posexplode("_p.values").alias("source_row_index", "source_fields_raw"))


def forecast_rows(payloads: DataFrame, body: str = "body") -> DataFrame:
    rows = payloads.select(*[c for c in payloads.columns if c != body], F.explode(F.from_json(body, FORECAST)).alias("f"))
    return rows.select(*[c for c in payloads.columns if c != body], "f.location.*", F.to_date("f.date").alias("forecast_date"), F.col("f.min_temp").try_cast("double").alias("min_temp_c"), F.col("f.max_temp").try_cast("double").alias("max_temp_c"), "f.summary_forecast")


class _Cells(HTMLParser):
    """Rows of cells, with the first link of each row and its line in the source."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, list[str], list[str]]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append((self.getpos()[0], [], []))
        elif tag in ("td", "th") and self.rows:
            self.rows[-1][1].append("")
            self.open = True
        elif tag == "a" and self.rows:
            self.rows[-1][2].append(dict(attrs).get("href") or "")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open = False

    def handle_data(self, data):
        if self.open and self.rows and self.rows[-1][1]:
            self.rows[-1][1][-1] += data


def table_rows(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, row, line, cells, link) of every table row of HTML pages, cells with single spaces; link is the first of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = _Cells()
                cells.feed(text or "")
                for k, (line, row, links) in enumerate(cells.rows):
                    if row:
                        for col, v in zip(cols, (page, k, line, [" ".join(c.split()) for c in row], links[0] if links else None), strict=True):
                            col.append(v)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "row", "line", "cells", "link"])

    got = pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html")).mapInArrow(run, "key string, row int, line int, cells array<string>, link string")
    return got.withColumnRenamed("key", key)


def listing_rows(pages: DataFrame, headers: list[str], districts: list[str], html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, row_no, source_line, link_id, name, value_raw, quarantine) of listing pages (No, link, name, district, value).

    A page whose first row is not the expected header is one row that says so. A row with another number of cells, an
    unknown district, or no station in its link is set aside with that reason, its fields as they are.
    """
    rows = table_rows(pages, html, key)
    first = rows.groupBy(key).agg(F.min_by("cells", "row").alias("head"))
    good = F.col("head") == F.array(*map(F.lit, headers))
    both = rows.where("row > 0").join(first, key).where(good)
    cell = lambda k: F.try_element_at(F.col("cells"), F.lit(k))
    link = F.nullif(F.regexp_extract("link", r"[?&]stationid=([^&#]*)", 1), F.lit(""))
    reason = F.when(F.size("cells") != len(headers), "CELL_COUNT").when(~F.coalesce(cell(4).isin(*districts), F.lit(False)), "UNKNOWN_DISTRICT").when(link.isNull(), "NO_LINK_ID")
    out = both.select(key, cell(1).try_cast("int").alias("row_no"), F.col("line").alias("source_line"), link.alias("link_id"), cell(3).alias("name"), cell(5).alias("value_raw"), reason.alias("quarantine"))
    none = lambda t: F.lit(None).cast(t)
    bad = pages.select(F.col(key).cast("string").alias(key)).join(first.where(good).select(key), key, "left_anti")
    return out.union(bad.select(key, none("int"), none("int"), none("string"), none("string"), none("string"), F.lit("HEADER_DIFFERS")))


def listing_quarantine(cells: Column, width: int, districts: list[str] | None = None, district_at: int = 3) -> Column:
    """Reason why a listing row is set aside, null for a good row."""
    reason = F.when(F.size(cells) != width, "CELL_COUNT").when(F.trim(cells[0]) == "", "NO_ROW_NUMBER")
    return reason.when(~cells[district_at].isin(*districts), "UNKNOWN_DISTRICT") if districts else reason


def page_state(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, options, updated): the values of a page's select options, and the time in its footer."""
    text = F.coalesce(F.col(html), F.lit(""))
    return pages.select(key, F.regexp_extract_all(text, F.lit(r"<option[^>]*value=['\"]([^'\"]*)['\"]"), 1).alias("options"), F.nullif(F.regexp_extract(text, r"(\d{2}/\d{2}/\d{4} \d{2}:\d{2})", 1), F.lit("")).alias("updated"))


def read_csv_digested(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, str]:
    """(rows of the files, SHA-256 over their names and digests in order); a byte order mark is no part of the first header."""
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("sha"))
    digest = files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha"))), lambda f: F.concat_ws(":", f["name"], f["sha"])), ","), 256)).first()[0]
    rows = spark.read.option("header", True).option("nullValue", "").csv(paths)
    clean = {c: c.lstrip("\ufeff") for c in rows.columns}
    return rows.withColumnsRenamed(clean), digest


def origin_matches(origin: str, name: str, digest: str) -> bool:
    """Whether `<file>@sha256:<prefix>` names this file and the start of its digest; a prefix has 8 digits at least."""
    file, _, prefix = origin.partition("@sha256:")
    return file == name and len(prefix) >= 8 and digest.startswith(prefix)


def station_context(spark: SparkSession, root: str, origin: str) -> dict[str, DataFrame] | None:
    """The station master, if its sites file is the one that a dataset names as its origin, else None."""
    _, digest = read_csv_digested(spark, [f"{root}/sites.csv"])
    content = spark.read.format("binaryFile").load(f"{root}/sites.csv").select(F.sha2("content", 256)).first()[0]
    return read_station_master(spark, root) if origin_matches(origin, "sites.csv", content) and digest else None


def read_station_master(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """sites, sensors and thresholds, every column text, empty cells null."""
    return {n: spark.read.option("header", True).option("nullValue", "").csv(f"{root}/{n}.csv") for n in ("sites", "sensors", "thresholds")}


def read_observations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


# The field of a station history that is a sensor's value, and the sentinel for a missing one.
HISTORY_VALUES = {"rainfall": "raw", "water_level": "final"}
SENTINEL = "-9999"


def history_values(rows: DataFrame, time_field: str = "dt") -> DataFrame:
    """history_rows with `dataset`, `value_field`, `value_raw`, `time_raw` and `structural_error`: the value of a history by its sensor_type.

    Rainfall reads `raw`, the increment of an interval, water levels `final`. All texts stay as they are. A sensor type without a
    history, or a row without its value's or its time's field, is named as the error, with nulls for what is lacking; a null text is no error.
    """
    fields, kind = F.col("source_fields_raw"), F.col("sensor_type")
    field = F.element_at(F.create_map(*[F.lit(x) for pair in HISTORY_VALUES.items() for x in pair]), kind)
    has = lambda name: F.coalesce(F.map_contains_key(fields, name), F.lit(False))
    error = F.when(field.isNull(), "UNKNOWN_SENSOR_TYPE").when(~has(field), "MISSING_VALUE_FIELD").when(~has(F.lit(time_field)), "MISSING_TIME_FIELD")
    return rows.withColumns({"dataset": F.concat(kind, F.lit("_history")), "value_field": field, "value_raw": F.element_at(fields, field), "time_raw": F.element_at(fields, F.lit(time_field)), "structural_error": error})


def live_status(age_minutes: Column, value_raw: Column, fresh: int, delayed: int, ahead: int = 5) -> Column:
    """How fresh a listed value is: INVALID without a time or more than `ahead` minutes ahead of its retrieval, NO_DATA without a number, then FRESH, DELAYED or STALE."""
    text = F.trim(F.coalesce(value_raw, F.lit("")))
    number = (text != SENTINEL) & text.try_cast("double").isNotNull()
    return F.when(age_minutes.isNull() | (age_minutes < -ahead), "INVALID").when(~number, "NO_DATA").when(age_minutes <= fresh, "FRESH").when(age_minutes <= delayed, "DELAYED").otherwise("STALE")


def listed_observations(listing: DataFrame, time_format: str, retrieved_us: Column, fresh: int = 30, delayed: int = 180) -> DataFrame:
    """Rows of a listing (link_id, name, time_raw, value_raw, ...) with `observed_us`, `age_minutes` (whole, rounded down) and `live_status`; none is dropped.

    Times are those of the source's clock, as retrieved_us is.
    """
    at = F.unix_micros(F.try_to_timestamp(F.concat(F.trim("time_raw"), F.lit(" +00:00")), F.lit(f"{time_format} XXX")))
    out = listing.withColumn("observed_us", at).withColumn("age_minutes", F.floor((retrieved_us - F.col("observed_us")) / 60_000_000))
    return out.withColumn("live_status", live_status(F.col("age_minutes"), F.col("value_raw"), fresh, delayed))
