"""Salary normalisation (D1, the README's first declared stage).

The reference announces a normalize stage without code; this definition is
ours and reads only the fields its salary tests (P1/P2) look at.  One row
per (posting, salary entry):

* source A: the top-level ``salary`` / ``salaryRange`` (type NULL; an object's
  ``from`` / ``to``, or a number as ``from``), then each entry of ``employmentTypes`` (or
  ``employmentType`` when the first is falsy); amounts from ``salary``, else
  ``salaryRange``, else the entry's own ``from`` / ``to``;
* source B: each entry of ``employmentTypes`` (``from`` / ``to``), then the
  top-level ``salary_from`` / ``salary_to``, else a number ``salary`` as ``from`` (type NULL).

A posting without any such entry keeps one row with NULL amounts, so every
posting that a salary test accepts is in the result.

Amounts are DOUBLE (NULL when not numeric).  Currency and period are the
request settings of the crawl, fixed below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions.json import as_array, field, is_number, is_object, truthy
from offerlake.sources.tables import SOURCE_A

# ---------------------------------------------------------------------------
# The listing requests ask for salaries in PLN per month.
CURRENCY = "PLN"
PERIOD = "month"
# ---------------------------------------------------------------------------


_ENTRY_ARRAY = "array<struct<employment_type:string,salary_from:double,salary_to:double>>"


def _amount(v: Column) -> Column:
    return F.when(is_number(v), F.try_variant_get(v, "$", "double"))


def _entry_a(e: Column) -> Column:
    box = F.when(truthy(field(e, "salary")), field(e, "salary")).otherwise(field(e, "salaryRange"))
    src = F.when(is_object(box), box).otherwise(e)
    return F.struct(F.try_variant_get(e, "$.type", "string").alias("employment_type"),
                    _amount(field(src, "from")).alias("salary_from"),
                    _amount(field(src, "to")).alias("salary_to"))


def _entry_b(e: Column) -> Column:
    return F.struct(F.try_variant_get(e, "$.type", "string").alias("employment_type"),
                    _amount(field(e, "from")).alias("salary_from"),
                    _amount(field(e, "to")).alias("salary_to"))


def salary_entries(v: Column, source: str) -> Column:
    """``ARRAY<STRUCT<employment_type, salary_from, salary_to>>`` of one posting."""
    empty = F.array().cast("array<variant>")
    if source == SOURCE_A:
        top = F.when(truthy(field(v, "salary")), field(v, "salary")).otherwise(field(v, "salaryRange"))
        tops = F.when(is_object(top) | is_number(top), F.array(F.struct(
            F.lit(None).cast("string").alias("employment_type"),
            F.when(is_number(top), _amount(top)).otherwise(_amount(field(top, "from"))).alias("salary_from"),
            _amount(field(top, "to")).alias("salary_to"))))
        types = F.when(truthy(field(v, "employmentTypes")), field(v, "employmentTypes")).otherwise(field(v, "employmentType"))
        entries = F.transform(F.filter(F.coalesce(as_array(types), empty), is_object), _entry_a)
    else:
        tf, tt, one = field(v, "salary_from"), field(v, "salary_to"), field(v, "salary")
        tops = F.when(is_number(tf) | is_number(tt) | is_number(one), F.array(F.struct(
            F.lit(None).cast("string").alias("employment_type"),
            F.when(is_number(tf) | is_number(tt), _amount(tf)).otherwise(_amount(one)).alias("salary_from"),
            _amount(tt).alias("salary_to"))))
        entries = F.transform(F.filter(F.coalesce(as_array(field(v, "employmentTypes")), empty), is_object), _entry_b)
    return F.concat(F.coalesce(tops, F.array().cast(_ENTRY_ARRAY)), entries)


def normalize_salaries(records: DataFrame, source: str, listing: str = "listing",
                       keep: tuple[str, ...] = ("source", "source_id")) -> DataFrame:
    """One row per salary entry of each record, one at least; no shuffle (row-local)."""
    parsed = records.select(*keep, F.try_parse_json(F.col(listing)).alias("_v"))  # parsed once, referenced below
    return (parsed.select(*keep, F.explode_outer(salary_entries(F.col("_v"), source)).alias("e"))
            .select(*keep, "e.employment_type", "e.salary_from", "e.salary_to",
                    F.lit(CURRENCY).alias("currency"), F.lit(PERIOD).alias("period")))
