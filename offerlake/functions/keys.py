"""Posting keys: source ids, detail slugs and urls.

Each key is the first truthy value of an ordered list of JSON keys, as
``str(value)``.  Strings and integers print the same in Spark and Python and
stay on the JVM.  Every other case (a float, boolean or container as the
chosen value, or no usable key, which falls back to a content hash) is rare
and is computed by one small vectorised helper over the posting's JSON text;
the helper receives NULL for all other rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.functions.json import field, first_truthy, simple_str, truthy

# ---------------------------------------------------------------------------
# Key lists, in priority order.
SOURCE_ID_KEYS_A = ("reference", "url", "id", "postingId", "uuid", "slug")
SOURCE_ID_KEYS_B = ("id", "uuid", "slug", "hash_id", "offer_id")
JOB_SLUG_KEYS = ("reference", "url", "slug", "postingUrl", "id")
URL_KEYS_A = ("url", "postingUrl")
URL_KEYS_B = ("url", "slug")
# Content id: leading hex digits of SHA-256 over the key-sorted JSON text.
CONTENT_ID_HEX = 20
# ---------------------------------------------------------------------------


def content_id(obj) -> str:
    """J4 on a parsed posting: default ``json.dumps`` separators, ASCII escapes,
    sorted keys."""
    text = json.dumps(obj, sort_keys=True)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:CONTENT_ID_HEX]


def chosen_key(v: Column, keys: Sequence[str]) -> Column:
    """The name of the first of ``keys`` whose value is truthy; NULL if none is."""
    return F.coalesce(*[F.when(truthy(field(v, k)), F.lit(k)) for k in keys])


def print_value(posting: str, key: str | None) -> str | None:
    """What one posting's key prints: its value under ``key``, or the content id without one."""
    try:
        read = json.loads(posting)
    except ValueError:
        return None
    return str(read[key]) if key is not None else content_id(read)


@F.pandas_udf(T.StringType())
def _printed(posting: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else print_value(p, None if pd.isna(k) else k) for p, k in zip(posting, key)], dtype=object)


def _exact(v: Column, posting: Column, keys: Sequence[str], simple: Column) -> Column:
    """``simple`` where it is known; else what the chosen key prints (such rows only reach the helper)."""
    other = simple.isNull()
    return F.coalesce(simple, _printed(F.when(other, posting), F.when(other, chosen_key(v, keys))))


def posting_key(v: Column, posting: Column, keys: Sequence[str]) -> Column:
    """First truthy of ``keys`` as ``str()``; content hash if none.

    ``v`` is the parsed posting, ``posting`` its JSON text (needed only by the
    helper)."""
    return _exact(v, posting, tuple(keys), simple_str(first_truthy(v, keys)))


def source_id_a(v: Column, posting: Column) -> Column:
    """J1."""
    return posting_key(v, posting, SOURCE_ID_KEYS_A)


def source_id_b(v: Column, posting: Column) -> Column:
    """J2."""
    return posting_key(v, posting, SOURCE_ID_KEYS_B)


def job_slug(v: Column, posting: Column) -> Column:
    """J3 (both sources)."""
    return posting_key(v, posting, JOB_SLUG_KEYS)


def url_of(v: Column, keys: Sequence[str]) -> Column:
    """First truthy of ``keys`` as text; NULL when none is (ours: the
    reference returns the last falsy operand)."""
    return F.coalesce(*[F.when(truthy(field(v, k)), F.try_variant_get(field(v, k), "$", "string")) for k in keys])


def url_a(v: Column) -> Column:
    return url_of(v, URL_KEYS_A)


def url_b(v: Column) -> Column:
    return url_of(v, URL_KEYS_B)


def detail_key(slug: Column) -> Column:
    """Join key of a detail document: the slug without leading ``/``; an empty
    slug has no detail."""
    k = F.regexp_replace(slug, r"^/+", "")
    return F.when(k != "", k)


def with_keys(df, source_keys, url_keys, v: str = "v", posting: str = "posting",
              names: tuple[str, str, str] = ("source_id", "job_slug", "url")):
    """Add ``source_id``, ``job_slug`` and ``url`` to a frame of parsed postings.

    The chosen raw value of each key list is staged as its own column first,
    so the truthiness tests run once per key and row (an expression would
    repeat them at every reference)."""
    pv, pt = F.col(v), F.col(posting)
    sid_n, slug_n, url_n = names
    keep = [c for c in df.columns if c not in names]
    staged = df.withColumns({"_sid": first_truthy(pv, source_keys), "_slug": first_truthy(pv, JOB_SLUG_KEYS),
                             "_url": first_truthy(pv, url_keys)})
    staged = staged.withColumns({"_sid_s": simple_str(F.col("_sid")), "_slug_s": simple_str(F.col("_slug"))})
    return staged.select(
        *keep,
        _exact(pv, pt, source_keys, F.col("_sid_s")).alias(sid_n),
        _exact(pv, pt, JOB_SLUG_KEYS, F.col("_slug_s")).alias(slug_n),
        F.try_variant_get(F.col("_url"), "$", "string").alias(url_n))
