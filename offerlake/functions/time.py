"""Publication time (J5), cutoffs (P5, P6) and run date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.functions.json import field, first_truthy, is_number, is_string

# ---------------------------------------------------------------------------
# Fixed values.
POSTED_KEYS = ("posted", "renewed", "publishedAt")
# Relative windows, in days back from "now".
SINCE_WINDOWS = {
    "last_week": 7,
    "last_month": 30,
    "last_quarter": 90,
    "last_half_year": 182,
    "last_year": 365,
}
# Epoch-millisecond values a Python datetime can hold (years 1..9999).
MIN_EPOCH_MS = -62135596800000
MAX_EPOCH_MS = 253402300799999
# ISO-8601 as Python's datetime.fromisoformat reads it: a date (YYYY-MM-DD or
# YYYYMMDD), then optionally any one separator character and a time (HH,
# HH:MM or HHMM, HH:MM:SS or HHMMSS, a fraction after '.' or ','), then an
# offset (+/-HH, HH:MM or HHMM, seconds and fraction allowed).  Groups:
# 1 year, 3 month, 4 day, 5 hour, 7 minute, 8 second, 9 fraction,
# 10 sign, 11 offset hours, 13 offset minutes, 14 offset seconds, 15 offset fraction.
# The common form, read by Spark's own cast (offsets Spark accepts: up to 18h).
ISO_COMMON = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:[+-](?:0\d|1[0-8]):[0-5]\d)?)?$"
ISO_PATTERN = (r"^(\d{4})(-?)(\d{2})\2(\d{2})"
               r"(?:.(\d{2})(?:(:?)(\d{2})(?:\6(\d{2}))?)?(?:[.,](\d+))?"
               r"(?:([+-])(\d{2})(?:(:?)(\d{2})(?:\12(\d{2}))?)?(?:[.,](\d+))?)?)?$")
# A week date: year, dash, week, and the weekday after the same dash or lack of one;
# only without a weekday can the text end there.
ISO_WEEK = r"^\d{4}-?W\d{2}"
ISO_WEEK_PATTERN = r"^(\d{4})(-?)W(\d{2})(?:\2([1-7])(.*)|)$"
# ---------------------------------------------------------------------------


def _from_week(s: Column) -> Column:
    """A week date with what follows it as a calendar date (YYYY-MM-DD) with the same; NULL if there is no such day."""
    def g(i: int) -> Column:
        return F.regexp_extract(s, ISO_WEEK_PATTERN, i)

    year, week = g(1).cast("int"), g(3).cast("int")
    day = F.coalesce(F.nullif(g(4), F.lit("")).cast("int"), F.lit(1))

    def monday(y: Column) -> Column:  # of week 1: the week of 4 January
        fourth = F.try_make_timestamp(y, F.lit(1), F.lit(4), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        return F.date_sub(fourth, F.weekday(fourth))

    date = F.date_add(monday(year), (week - 1) * 7 + day - 1)
    ok = s.rlike(ISO_WEEK_PATTERN) & (year > 0) & (week >= 1) & (F.date_add(monday(year), (week - 1) * 7) < monday(year + 1))
    return F.when(ok, F.concat(F.date_format(date, "yyyy-MM-dd"), g(5)))


def _from_epoch_ms(ms: Column) -> Column:
    ok = (ms >= F.lit(MIN_EPOCH_MS)) & (ms <= F.lit(MAX_EPOCH_MS))
    return F.when(ok, F.timestamp_micros(F.round(ms * F.lit(1000.0)).cast("bigint")))


def _iso_parts(x: Column) -> Column:
    """The pattern's groups of one string (each ``regexp_extract`` on the bound value)."""
    fields = [F.regexp_extract(x, ISO_PATTERN, i).alias(f"g{i}") for i in range(1, 16)]
    return F.struct(x.rlike(ISO_PATTERN).alias("ok"), *fields)


def _iso_instant(m: Column) -> Column:
    def g(i: int) -> Column:
        return F.coalesce(F.nullif(m[f"g{i}"], F.lit("")).cast("int"), F.lit(0))

    def micros(i: int) -> Column:  # first six digits of a fraction, as microseconds
        frac = m[f"g{i}"]
        return F.when(frac == "", F.lit(0)).otherwise(F.rpad(F.substring(frac, 1, 6), 6, "0").cast("int"))

    hh, mi, ss = g(5), g(7), g(8)
    # seconds with fraction, built from whole microseconds (fits: seconds < 100)
    secs = ((ss.cast("bigint") * 1000000 + micros(9)).cast("decimal(18,0)") / F.lit(1000000)).cast("decimal(10,6)")
    local = F.try_make_timestamp(g(1), g(3), g(4), hh, mi, secs, F.lit("UTC"))
    off = ((g(11).cast("bigint") * 3600 + g(13) * 60 + g(14)) * 1000000 + micros(15)).cast("bigint")
    off = F.when(m["g10"] == "-", -off).otherwise(off)
    valid = m["ok"] & (hh < 24) & (mi < 60) & (ss < 60) & (F.abs(off) < F.lit(86400 * 1000000))
    return F.when(valid, F.timestamp_micros(F.unix_micros(local) - off))


def _from_iso(s: Column) -> Column:
    """ISO text -> TIMESTAMP (UTC); NULL where Python's parser would fail.
    A trailing ``Z`` turns every ``Z`` into ``+00:00`` first, as the
    reference does; naive times are UTC (ours).  Other forms than the common
    one bind the string once (a one-element array), turn a week date into a
    calendar date and take it apart with the full pattern."""
    s = F.when(s.endswith("Z"), F.replace(s, F.lit("Z"), F.lit("+00:00"))).otherwise(s)
    dated = F.transform(F.array(s), lambda x: F.when(x.rlike(ISO_WEEK), _from_week(x)).otherwise(x))
    slow = F.transform(F.transform(dated, _iso_parts), _iso_instant)[0]
    return F.when(s.rlike(ISO_COMMON), s.try_cast("timestamp")).otherwise(slow)


def posted_value(v: Column) -> Column:
    """The raw value J5 reads: ``posted or renewed or publishedAt``."""
    return F.coalesce(first_truthy(v, POSTED_KEYS[:-1]), field(v, POSTED_KEYS[-1]))


def posted_from_value(ts: Column) -> Column:
    """J5 on the chosen value: a number is epoch ms, a string ISO-8601;
    anything unreadable is NULL.  Naive strings are UTC (ours)."""
    num = F.try_variant_get(ts, "$", "double")
    text = F.try_variant_get(ts, "$", "string")
    return (F.when(is_number(ts), _from_epoch_ms(num))
             .when(is_string(ts), _from_iso(text)))


def posted_at(v: Column) -> Column:
    """J5 as one expression (no fall-through once a value is chosen)."""
    return posted_from_value(posted_value(v))


def with_posted_at(df, v: str = "v", out: str = "posted_at", when: Column | None = None):
    """J5 as a column, with the chosen value staged once per row."""
    chosen = posted_value(F.col(v))
    if when is not None:
        chosen = F.when(when, chosen)
    keep = [c for c in df.columns if c != out]
    return df.withColumn("_ts", chosen).select(*keep, posted_from_value(F.col("_ts")).alias(out))


def keep_since(posted: Column, since: Column | None) -> Column:
    """P5: drop only postings known to be older than ``since``."""
    if since is None:
        return F.lit(True)
    return F.coalesce(posted >= since, F.lit(True))


def resolve_since(raw_since: str | None = None, window: str | None = None,
                  now: dt.datetime | None = None) -> dt.datetime | None:
    """Absolute ISO date (UTC midnight, ours) or a named window back from
    ``now``; both given is an error."""
    if raw_since and window:
        raise ValueError("use only one of since or since_window")
    if raw_since:
        d = dt.datetime.fromisoformat(raw_since)
        return d.replace(tzinfo=dt.timezone.utc) if d.tzinfo is None else d.astimezone(dt.timezone.utc)
    if window:
        if window not in SINCE_WINDOWS:
            raise ValueError(f"unknown window {window!r}")
        now = now or dt.datetime.now(dt.timezone.utc)
        return now - dt.timedelta(days=SINCE_WINDOWS[window])
    return None


def since_column(since: dt.datetime | None) -> Column | None:
    """A cutoff as a TIMESTAMP literal (session time zone is UTC)."""
    if since is None:
        return None
    if since.tzinfo is not None:
        since = since.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(since.isoformat(sep=" ")).cast("timestamp")


def resolve_date(raw_date: str | None = None) -> dt.date:
    """ISO date, or today in UTC."""
    if not raw_date:
        return dt.datetime.now(dt.timezone.utc).date()
    return dt.date.fromisoformat(raw_date)
