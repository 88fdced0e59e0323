"""Queries of local time texts in zones with daylight saving over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import core
from hydrolith.operators import timezones
from hydrolith.plans.catalog import US, _query, table

FORMATS = [("yyyy-MM-dd HH:mm:ss", "SECOND"), ("dd/MM/yyyy HH:mm", "MINUTE"), ("yyyy-MM-dd", "DATE"), ("yyyy-MM-dd'T'HH:mm:ssXXX", "SECOND")]
#: Berlin's clocks: an hour ahead, two from the last Sunday of March to that of October (of September until 1995), both at 01:00 UTC.
_SUNDAY = "make_timestamp({y}, {m}, {d}, 1, 0, 0) - to_days(isodow(make_timestamp({y}, {m}, {d}, 1, 0, 0)) % 7)"
_UP = _SUNDAY.format(y="y", m="3", d="31")
_DOWN = f"CASE WHEN y < 1996 THEN {_SUNDAY.format(y='y', m='9', d='30')} ELSE {_SUNDAY.format(y='y', m='10', d='31')} END"
_TIMES = f"""WITH raw AS (SELECT 'orders' AS tab, o_orderkey AS row, o_orderdate::TIMESTAMP + to_minutes(CASE WHEN o_orderkey % 3 = 0 THEN 105 + o_orderkey % 90 ELSE o_orderkey % 1440 END) AS lt, o_orderkey % 11 AS k, epoch_us(o_orderdate::TIMESTAMP) + {2880 * US} AS ref FROM orders
  UNION ALL SELECT 'events', event_id, date_trunc('second', ts), event_id % 11, epoch_us(ts) - {90 * US} FROM events),
tx AS (SELECT *, CASE k WHEN 0 THEN ' ' WHEN 1 THEN 'soon' WHEN 2 THEN strftime(lt, '%Y-%m-%d') WHEN 3 THEN strftime(lt, '%d/%m/%Y %H:%M') WHEN 4 THEN strftime(lt, '%Y-%m-%dT%H:%M:%S') || '+05:30' ELSE strftime(lt, '%Y-%m-%d %H:%M:%S') END AS raw,
  CASE WHEN k <> 5 THEN 'Europe/Berlin' END AS zone, CASE WHEN k = 3 THEN date_trunc('minute', lt) WHEN k = 2 THEN date_trunc('day', lt) ELSE lt END AS l, year(lt) AS y FROM raw),
ch AS (SELECT *, {_UP} AS up, {_DOWN} AS down FROM tx),
st AS (SELECT *, l >= up + INTERVAL 1 HOUR AND l < up + INTERVAL 2 HOUR AS gap, l >= down + INTERVAL 1 HOUR AND l < down + INTERVAL 2 HOUR AS fold, CASE WHEN l >= up + INTERVAL 2 HOUR AND l < down + INTERVAL 1 HOUR THEN 120 ELSE 60 END AS off FROM ch),
us AS (SELECT *, CASE WHEN k = 4 THEN epoch_us(l) - {330 * US} ELSE epoch_us(l) - off::BIGINT * {US} END AS inst, CASE WHEN k = 0 THEN 'MISSING' WHEN k = 1 THEN 'INVALID_FORMAT' WHEN k = 5 THEN 'UNSPECIFIED_TIMEZONE' WHEN k = 2 THEN 'VALID' WHEN k <> 4 AND (gap OR fold) THEN 'AMBIGUOUS' END AS s FROM st),
fin AS (SELECT *, coalesce(s, CASE WHEN inst > ref + {10 * US} THEN 'FUTURE' ELSE 'VALID' END) AS time_status FROM us)
"""


def local_texts(spark, sf_dir):
    """Local time texts made of orders and events: many about the hours at which clocks change, in several formats."""
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    key = F.col("o_orderkey")
    day = core.micros(F.col("o_orderdate"))
    rows = o.select(F.lit("orders").alias("tab"), key.alias("row"), (day + F.when(key % 3 == 0, 105 + key % 90).otherwise(key % 1440) * F.lit(US)).alias("us"), (key % 11).alias("k"), (day + 2880 * US).alias("ref"))
    at = core.micros(F.col("ts"))
    rows = rows.unionByName(e.select(F.lit("events").alias("tab"), F.col("event_id").alias("row"), (at - at % 1_000_000).alias("us"), (F.col("event_id") % 11).alias("k"), (at - 90 * US).alias("ref")))
    local = F.timestamp_add("MICROSECOND", F.col("us"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    said = lambda f: F.date_format(local, f)
    k = F.col("k")
    raw = F.when(k == 0, " ").when(k == 1, "soon").when(k == 2, said("yyyy-MM-dd")).when(k == 3, said("dd/MM/yyyy HH:mm")).when(k == 4, F.concat(said("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))).otherwise(said("yyyy-MM-dd HH:mm:ss"))
    return rows.select("tab", "row", raw.alias("raw"), F.when(k != 5, "Europe/Berlin").alias("zone"), "ref")


@_query(_TIMES + f"""SELECT tab, row, time_status, CASE WHEN time_status = 'AMBIGUOUS' THEN CASE WHEN fold THEN 'FOLD' ELSE 'GAP' END END AS time_detail, CASE WHEN k > 1 THEN CASE k WHEN 2 THEN 'DATE' WHEN 3 THEN 'MINUTE' ELSE 'SECOND' END END AS time_precision,
  CASE WHEN k <> 2 AND time_status IN ('VALID', 'FUTURE') THEN inst END AS time_us, CASE WHEN k = 2 THEN raw END AS local_date, CASE WHEN k NOT IN (2, 4) AND time_status IN ('VALID', 'FUTURE') THEN off END AS utc_offset_minutes,
  CASE WHEN k NOT IN (0, 1, 4, 5) THEN zone END AS timezone_name, CASE WHEN k = 4 THEN 'EXPLICIT_IN_SOURCE' WHEN k = 5 THEN 'UNSPECIFIED_NO_POLICY' WHEN k > 1 THEN 'UNSPECIFIED_ASSUMED' END AS timezone_status FROM fin""")
def zoned_times(spark, sf_dir):
    years = timezones.zone_years(spark, ["Europe/Berlin", "Asia/Kuala_Lumpur"], 1990, 2030)
    got = timezones.normalised_times(local_texts(spark, sf_dir), "raw", FORMATS, years, "zone", "ref")
    return got.drop("raw", "zone", "ref")


@_query(_TIMES + "SELECT tab, time_status, count(*) AS n, count(*) FILTER (time_status = 'AMBIGUOUS' AND fold) AS folds, count(*) FILTER (time_status = 'AMBIGUOUS' AND gap) AS gaps FROM fin GROUP BY 1, 2")
def zoned_time_counts(spark, sf_dir):
    got = zoned_times(spark, sf_dir)
    return got.groupBy("tab", "time_status").agg(F.count("*").alias("n"), F.count_if(F.col("time_detail") == "FOLD").alias("folds"), F.count_if(F.col("time_detail") == "GAP").alias("gaps"))
