"""Scalar column functions of the time-series model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000_000
# Flags that do not make a row unusable, source markers, order of thresholds, forecast words.
INFORMATIONAL = ("TIMEZONE_ASSUMED", "STATION_MASTER_CHANGED_SINCE_INGEST", "SOURCE_SEVERITY_ERROR", "DUPLICATE_IDENTICAL")
BREAKING = ("SOURCE_SEVERITY_ERROR",)
MARKERS = ("-9999", "ERROR", "Tiada Data")
THRESHOLDS = ("WASPADA", "AMARAN", "BAHAYA")


def round6(x: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def percent_of(part: Column, whole: Column, places: int = 2) -> Column:
    """100 * part / whole, null for an empty whole."""
    return F.when(whole != 0, F.round(100.0 * part / whole, places))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def floor_to(us: Column, minutes: int) -> Column:
    return us - F.pmod(us, F.lit(minutes * MINUTE))


def minutes_between(later_us: Column, earlier_us: Column) -> Column:
    return (later_us - earlier_us) / float(MINUTE)


def calendar(ts: Column) -> dict[str, Column]:
    """Hour, minute, weekday from Monday 0, month, weekend, and the circle of hour, month and weekday."""
    hour, month, day = F.hour(ts), F.month(ts), F.weekday(ts)
    part = hour + F.minute(ts) / 60.0
    turn = lambda x, n: 2 * math.pi * x / n
    return {
        "time_hour": hour,
        "time_minute": F.minute(ts),
        "time_weekday": day,
        "time_month": month,
        "time_is_weekend": (day >= 5).cast("int"),
        "time_hour_sin": round6(F.sin(turn(part, 24))),
        "time_hour_cos": round6(F.cos(turn(part, 24))),
        "time_month_sin": round6(F.sin(turn(month - 1, 12))),
        "time_month_cos": round6(F.cos(turn(month - 1, 12))),
        "time_weekday_sin": round6(F.sin(turn(day, 7))),
        "time_weekday_cos": round6(F.cos(turn(day, 7))),
    }


def value_status(text: Column) -> Column:
    """EMPTY, SOURCE_MARKER, NUMERIC or NON_NUMERIC; the sentinel counts as a marker however many zeros it ends in."""
    t = F.trim(text)
    return (
        F.when(text.isNull() | (t == ""), "EMPTY")
        .when(t.isin(*MARKERS) | t.rlike(r"^-9999(\.0+)?$"), "SOURCE_MARKER")
        .when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "NUMERIC")
        .otherwise("NON_NUMERIC")
    )


def parsed_value(text: Column) -> Column:
    return F.when(value_status(text) == "NUMERIC", F.trim(text).try_cast("double"))


def usable_flags(flags: Column) -> Column:
    """All flags are informational."""
    return F.size(F.array_except(flags, F.array(*map(F.lit, INFORMATIONAL)))) == 0


def is_usable_origin(usable: Column, flags: Column) -> Column:
    return usable & ~F.arrays_overlap(flags, F.array(*map(F.lit, BREAKING)))


def first_of(*cases: tuple[Column, str]) -> Column:
    """Name of the first condition that holds, null if none does."""
    out = F.when(*cases[0])
    for condition, name in cases[1:]:
        out = out.when(condition, name)
    return out


def forecast_has(summary: Column, words: tuple[str, ...]) -> Column:
    """1 if any word is in the lower-cased summary, 0 if none, null for an empty one."""
    low = F.lower(summary)
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word)
    return F.when(F.trim(summary) != "", hit.cast("int"))


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5 identifier of a name, from built-in functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(F.substring(variant, -1, 1), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def freshness(age_minutes: Column, fresh: int = 30, delayed: int = 180) -> Column:
    return F.when(age_minutes.isNull(), "NO_DATA").when(age_minutes < 0, "INVALID").when(age_minutes <= fresh, "FRESH").when(age_minutes <= delayed, "DELAYED").otherwise("STALE")


def staleness(age_minutes: Column, limit: int = 60) -> Column:
    return F.when(age_minutes.isNull(), "UNKNOWN").when(age_minutes < 0, "INVALID").when(age_minutes > limit, "STALE").otherwise("ACTIVE")


def url_parameter(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def wkt_point(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNotNull() & lat.isNotNull(), F.format_string("POINT (%s %s)", lon, lat))


def parse_wkt(text: Column) -> tuple[Column, Column]:
    """(lon, lat) of a point in well-known text, nulls for anything else."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    part = lambda k: F.nullif(F.regexp_extract(text, rf"^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$", k), F.lit("")).cast("double")
    return part(1), part(2)


def json_text(document: Column, path: str) -> Column:
    """A value of a JSON text as text: booleans in small letters, numbers in their shortest form, a nested value compact; JSON null is null."""
    return F.get_json_object(document, path)


def header_labels(first: Column, second: Column, at: int) -> Column:
    """Labels of a two-row table head: the second row's labels stand in for the one of the first at place `at` (from 0)."""
    parent = F.try_element_at(first, F.lit(at + 1))
    inner = F.transform(second, lambda x: F.concat_ws(" ", parent, x))
    return F.concat(F.slice(first, 1, at), inner, F.slice(first, at + 2, 1 << 20))
