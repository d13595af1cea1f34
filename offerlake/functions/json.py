"""JSON value tests on VARIANT columns.

Postings are schemaless JSON.  Each posting is parsed once into a VARIANT
column and every rule below reads it with ``try_variant_get``; object key
order is not needed by any of these rules.  The rules follow Python's notion
of truthiness and ``isinstance`` on ``json.loads`` output:

* ``truthy``: null/absent, ``false``, ``0``, ``0.0``, ``""``, ``[]`` and ``{}``
  are false; everything else is true.
* ``is_number``: ints and floats, and booleans (a Python bool is an int);
  numeric strings are not numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(v: Column, key: str) -> Column:
    """Value under top-level ``key`` of a JSON object as VARIANT (NULL if absent
    or if ``v`` is not an object)."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def vtype(v: Column) -> Column:
    """Top-level JSON type name of a VARIANT (``STRING``, ``BIGINT``, ``OBJECT<..>``…)."""
    return F.schema_of_variant(v)


# JSON texts of falsy values: null, false, "", [], {} and any spelling of zero.
_FALSY_JSON = r'^(null|false|""|\[\]|\{\}|-?0*\.?0*([eE][+-]?[0-9]+)?)$'
# Type names of values that are Python ints or floats (booleans included).
_NUMBER_TYPES = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)$"


def is_object(v: Column) -> Column:
    return F.coalesce(vtype(v).startswith("OBJECT"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(vtype(v).startswith("ARRAY"), F.lit(False))


def is_string(v: Column) -> Column:
    return F.coalesce(vtype(v) == "STRING", F.lit(False))


def is_number(v: Column) -> Column:
    """``isinstance(x, (int, float))`` on the parsed value; booleans count."""
    return F.coalesce(vtype(v).rlike(_NUMBER_TYPES), F.lit(False))


def truthy(v: Column) -> Column:
    """Python truthiness of the parsed JSON value; never NULL.

    One test on the value's JSON text: falsy values print as ``null``,
    ``false``, ``""``, ``[]``, ``{}`` or a zero number.  (Tests by type repeat
    the value's expression in every branch; generated code then outgrows the
    JVM's method limit and falls back to interpretation.)"""
    return F.coalesce(~F.to_json(v).rlike(_FALSY_JSON), F.lit(False))


def first_truthy(v: Column, keys: Sequence[str]) -> Column:
    """Value of the first key whose value is truthy (``a.get(k1) or a.get(k2) …``),
    NULL when none is.  Unlike Python's ``or`` chain a falsy last operand is
    not returned; callers needing that use ``or_chain``."""
    return F.coalesce(*[F.when(truthy(field(v, k)), field(v, k)) for k in keys])


def as_array(v: Column) -> Column:
    """``ARRAY<VARIANT>`` if the value is a JSON list, else NULL."""
    return F.try_variant_get(v, "$", "array<variant>")


def simple_str(v: Column) -> Column:
    """``str(value)`` where Spark's text form equals Python's: strings and
    integers.  NULL for every other type (booleans, floats, containers), which
    callers send to the Python helper."""
    t = vtype(v)
    return F.when(t.isin("STRING", "BIGINT", "INT", "SMALLINT", "TINYINT"),
                  F.try_variant_get(v, "$", "string"))


def walk(doc) -> Iterator:
    """Every value of a parsed JSON document: a container before what it holds, of several the last first.

    What is still to come is a list of iterators, one per level: no recursion,
    and memory by depth."""
    levels = [iter((doc,))]
    while levels:
        for node in levels[-1]:
            yield node
            if isinstance(node, dict):
                levels.append(reversed(node.values()))
                break
            if isinstance(node, list):
                levels.append(reversed(node))
                break
        else:
            levels.pop()
