"""Locating postings inside landed listing bodies.

A landed page row carries one response body as JSON text.  A body counts only
if the whole of it is one JSON document, as a JSON parser of a crawler would
read it: single quotes, a second document or text after the document make the
page a failed one (``only_document``; ``from_json`` alone stops after the first
document).

The postings list is taken as ``array<string>``, which returns every element
as its own compact JSON text (key order kept) and NULL when the value is not a
list.  Only pages where that fails go to the document-order search (E2), a
small Python helper; it receives NULL for every other row.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.functions.json import field, is_array, is_object, truthy, walk

# ---------------------------------------------------------------------------
# Fixed values.
# A nested list counts as a postings list when it is non-empty, all items are
# objects and the first item has one of these keys.
POSTING_MARKER_KEYS = ("title", "postingId", "id", "slug", "company")
# Keys tried, in order, on a stored search result.
GENERIC_LIST_KEYS = ("postings", "content", "data")
# ---------------------------------------------------------------------------

ERR_NOT_JSON = "body is not JSON"
ERR_TOO_DEEP = "body is nested deeper than a JSON parser reads"
ERR_NOT_OBJECT = "body is not a JSON object"
ERR_NO_POSTINGS = "no postings list in body"
ERR_DATA_NOT_LIST = "data is not a list"
ERR_META = "meta or meta.next is not an object"
ERR_CURSOR = "meta.next.cursor is not a whole number"
ERR_NO_LIST = "none of the list keys holds a list"


def _is_posting_list(node) -> bool:
    return (isinstance(node, list) and len(node) > 0 and all(isinstance(item, dict) for item in node)
            and not node[0].keys().isdisjoint(POSTING_MARKER_KEYS))


def find_postings(body: str | None) -> tuple[list[str] | None, str | None]:
    """E1 + E2 on one body: (postings as JSON texts, error)."""
    if body is None:
        return None, None
    try:
        doc = json.loads(body)
        if not isinstance(doc, dict):
            return None, ERR_NOT_OBJECT
        found = doc["postings"] if isinstance(doc.get("postings"), list) else next(filter(_is_posting_list, walk(doc)), None)
    except ValueError:
        return None, ERR_NOT_JSON
    except RecursionError:  # the parser's own limit, some ten thousand levels
        return None, ERR_TOO_DEEP
    if found is None:
        return None, ERR_NO_POSTINGS
    return [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in found], None


_FOUND = T.StructType([
    T.StructField("postings", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])


@F.pandas_udf(_FOUND)
def _find_postings_udf(s: pd.Series) -> pd.DataFrame:
    out = [find_postings(b) for b in s]
    return pd.DataFrame({"postings": [o[0] for o in out], "error": [o[1] for o in out]})


def only_document(body: Column, kind: T.DataType) -> Column:
    """The body read as one JSON document of type ``kind``; NULL if the whole
    body is not exactly one.

    The body is the only element of an array, and the text's length stands
    after it: neither a second document nor a closing bracket too many can
    end the parse before the length is read."""
    length = F.length(body)
    around = T.StructType([T.StructField("only", T.ArrayType(kind)), T.StructField("length", T.IntegerType())])
    read = F.from_json(F.concat(F.lit('{"only":['), body, F.lit('],"length":'), length.cast("string"), F.lit("}")),
                       around, {"allowSingleQuotes": "false"})
    return F.when((F.size(read["only"]) == 1) & (read["length"] == length), read["only"][0])


_LIST = T.ArrayType(T.StringType())


def top_level_list(body: Column, key: str) -> Column:
    """``doc[key]`` when it is a list, as element JSON texts; else NULL."""
    return only_document(body, T.StructType([T.StructField(key, _LIST)]))[key]


def locate_postings(pages: DataFrame, body: str = "body") -> DataFrame:
    """S1 + E1 + E2: add ``postings ARRAY<STRING>`` and ``page_error STRING``.

    ``postings`` may be an empty list (a page with nothing on it).  A body
    that is not an object or has no posting-like list gets ``page_error``.
    """
    staged = pages.withColumn("_direct", top_level_list(F.col(body), "postings"))
    staged = staged.withColumn("_walk", _find_postings_udf(F.when(F.col("_direct").isNull(), F.col(body))))
    return (staged
            .withColumn("postings", F.coalesce("_direct", "_walk.postings"))
            .withColumn("page_error", F.when(F.col("postings").isNull(),
                                             F.coalesce(F.col("_walk.error"), F.lit(ERR_NO_POSTINGS))))
            .drop("_walk", "_direct"))


def first_list(pages: DataFrame, keys: Sequence[str] = GENERIC_LIST_KEYS, body: str = "body") -> DataFrame:
    """Add ``postings``, the first of ``keys`` whose value is a list, and
    ``page_error`` where none is; the body is parsed once."""
    doc = only_document(F.col(body), T.StructType([T.StructField(k, _LIST) for k in keys]))
    return (pages.withColumn("_doc", doc)
            .withColumn("postings", F.coalesce(*[F.col("_doc")[k] for k in keys])).drop("_doc")
            .withColumn("page_error", F.when(F.col("postings").isNull(), F.lit(ERR_NO_LIST))))


# the cursor as text: a number and a string that holds one look the same
_DATA_SCHEMA = T.StructType([
    T.StructField("data", _LIST),
    T.StructField("meta", T.StructType([T.StructField("next", T.StructType([
        T.StructField("cursor", T.StringType())]))])),
])
_WHOLE_NUMBER = r"^\s*([+-]?\d{1,18})(?:\.0*)?\s*$"


def locate_data_list(pages: DataFrame, body: str = "body") -> DataFrame:
    """S2 + E4 + E5 for cursor-paged responses.

    Adds ``postings`` (``data``; a falsy ``data`` is an empty list),
    ``next_cursor BIGINT`` (``meta.next.cursor``, NULL-safe; a whole number,
    or a text that holds one) and ``page_error`` (not one JSON document / not
    an object / truthy non-list ``data`` / truthy non-object ``meta`` or
    ``meta.next`` / any other non-null cursor).

    One ``from_json`` pass serves well-formed bodies (a mismatched field comes
    back NULL on its own); only rows where a field came back NULL are parsed
    again as VARIANT to tell "absent or falsy" from "wrong type".
    """
    b = F.col(body)
    p = F.col("_p")
    gate = (p["data"].isNull()
            | (p["meta"].isNull() & b.contains('"meta"'))
            | (p["meta"]["next"].isNull() & b.contains('"next"')))
    bv = F.col("_bv")
    data, meta = field(bv, "data"), field(bv, "meta")
    nxt = field(meta, "next")
    odd_cursor = field(nxt, "cursor")
    cursor = F.when(F.col("_gate"), F.when(F.to_json(odd_cursor) != "null", F.regexp_replace(F.to_json(odd_cursor), '^"|"$', ""))) \
              .otherwise(p["meta"]["next"]["cursor"])
    number = F.regexp_extract(F.col("_cursor"), _WHOLE_NUMBER, 1)
    shape = F.when(F.col("_gate"), F.when(bv.isNull(), F.lit(ERR_NOT_JSON))
                   .when(~is_object(bv), F.lit(ERR_NOT_OBJECT))
                   .when(truthy(data) & ~is_array(data), F.lit(ERR_DATA_NOT_LIST))
                   .when((truthy(meta) & ~is_object(meta)) | (truthy(nxt) & ~is_object(nxt)), F.lit(ERR_META)))
    error = F.coalesce(shape, F.when(F.col("_cursor").isNotNull() & (number == ""), F.lit(ERR_CURSOR)))
    return (pages
            .withColumn("_p", only_document(b, _DATA_SCHEMA))
            .withColumn("_gate", F.coalesce(gate, F.lit(True)))
            .withColumn("_bv", F.when(F.col("_gate"), only_document(b, T.VariantType())))
            .withColumn("_cursor", cursor)
            .withColumn("page_error", error)
            .withColumn("postings", F.when(F.col("page_error").isNull(),
                                           F.coalesce(F.col("_p.data"), F.array().cast("array<string>"))))
            .withColumn("next_cursor", F.when(F.col("page_error").isNull() & (number != ""), number.cast("bigint")))
            .drop("_p", "_gate", "_bv", "_cursor"))


def explode_postings(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per posting: ``pos`` (0-based position in the list),
    ``posting`` (JSON text) and ``v`` (parsed once, VARIANT)."""
    cols = [c for c in keep] + [F.posexplode("postings").alias("pos", "posting")]
    return (pages.select(*cols)
            .withColumn("pos", F.col("pos").cast("int"))
            .withColumn("v", F.try_parse_json("posting")))
